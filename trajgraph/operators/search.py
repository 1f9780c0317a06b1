"""Bounded search over a graph of moves: forced walks, collapsed steps, beams.

A move is an element or a composite action that leads from one page to another: ``moves(graph, src, move, tgt, weight)``. Elements and
actions count alike when a page's choices are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoints import kept

#: Bytes of the steps of all pages that are sent to every task; beyond it the frontier is joined level by level.
MAX_BROADCAST_BYTES = 32_000_000


def forced_walks(moves: DataFrame, max_length: int = 10) -> DataFrame:
    """Where each page with a single choice leads as long as there is no other choice.

    One row per such page: ``graph, start_page, end_page, forced`` (moves), ``pages`` (entered), ``weight`` (their sum) and ``stop``: ``loop``
    when the next page was there already, ``dead`` at a page without moves, ``length`` after ``max_length`` moves, else ``branch``. A move with
    several targets takes the smallest. A page whose only move leads back to itself has no row.

    Single choices are a function from pages to pages. Rounds of doubling join every stretch of walk with the one that starts where it
    ends, so a walk of n moves takes log n rounds; the first page met twice is cut off afterwards.
    """
    choices = moves.groupBy("graph", "src").agg(F.countDistinct("move").alias("n"), F.min(F.struct("move", "tgt", "weight")).alias("step"))
    choices = kept(choices, "choices")
    only = choices.filter("n = 1").select("graph", F.col("src").alias("page"), F.array("step").alias("steps"), F.col("step.tgt").alias("last"))
    stretch = kept(only.withColumn("whole", F.lit(True)), "stretches")
    length = 1
    while length < max_length:
        more = stretch.select("graph", F.col("page").alias("last"), F.col("steps").alias("more"), F.col("last").alias("end"), F.col("whole").alias("on"))
        joined = stretch.join(more, ["graph", "last"], "left")
        goes = F.col("whole") & F.col("more").isNotNull()
        stretch = kept(
            joined.select(
                "graph", "page",
                F.when(goes, F.concat("steps", "more")).otherwise(F.col("steps")).alias("steps"),
                F.when(goes, F.col("end")).otherwise(F.col("last")).alias("last"),
                F.coalesce(goes & F.col("on"), F.lit(False)).alias("whole"),
            ),
            "stretches",
        )
        length *= 2
    walk = stretch.select("graph", "page", F.slice("steps", 1, max_length).alias("steps"))
    been = F.concat(F.array("page"), F.col("steps.tgt"))
    walk = walk.withColumn("been", been)
    # The place of the first page that stands further left as well.
    again = F.filter(F.sequence(F.lit(1), F.size("steps")), lambda i: F.array_position("been", F.element_at("been", i + 1)) <= i)
    walk = walk.withColumn("again", F.get(again, F.lit(0))).withColumn("n", F.coalesce(F.col("again") - 1, F.size("steps"))).filter("n > 0")
    walk = walk.withColumn("steps", F.slice("steps", F.lit(1), F.col("n"))).withColumn("end_page", F.element_at("steps.tgt", -1))
    open_at_end = choices.select("graph", F.col("src").alias("end_page"), F.lit(True).alias("open"))
    stop = (
        F.when(F.col("again").isNotNull(), "loop").when(F.col("open").isNull(), "dead")
        .when(F.col("n") == max_length, "length").otherwise("branch")
    )
    return walk.join(open_at_end, ["graph", "end_page"], "left").select(
        "graph", F.col("page").alias("start_page"), "end_page", F.col("steps.move").alias("forced"), F.col("steps.tgt").alias("pages"),
        F.aggregate("steps.weight", F.lit(0.0), lambda a, w: a + w).alias("weight"), stop.alias("stop"),
    )


def collapsed_steps(moves: DataFrame, max_length: int = 10) -> DataFrame:
    """Steps of a search that walks forced stretches in one go: ``graph, src, path, pages, tgt, step_score``.

    From a page with several choices each move is a step. From a page with one choice the forced walk is taken first, and each choice at its
    end makes a step; a walk that ends dead or in a loop is a step of its own. A step never enters a page twice nor its own start.
    """
    moves = kept(moves.select("graph", "src", "move", "tgt", F.col("weight").cast("double").alias("weight")), "moves")
    walks = kept(forced_walks(moves, max_length), "walks")
    forced = walks.select("graph", F.col("start_page").alias("src"))
    single = moves.groupBy("graph", "src").agg(F.countDistinct("move").alias("n")).filter("n = 1").select("graph", "src")
    plain = moves.join(single, ["graph", "src"], "left_anti").select(
        "graph", "src", F.col("move").alias("path"), F.array("tgt").alias("pages"), "tgt", F.col("weight").alias("step_score")
    )
    on = walks.filter(F.col("stop").isin("branch", "length")).select(
        "graph", "start_page", F.col("end_page").alias("src"), "forced", "pages", F.col("weight").alias("before")
    )
    further = on.join(moves, ["graph", "src"]).select(
        "graph", F.col("start_page").alias("src"), F.array_join(F.concat("forced", F.array("move")), " ").alias("path"),
        F.concat("pages", F.array("tgt")).alias("pages"), "tgt", (F.col("before") + F.col("weight")).alias("step_score"),
    )
    alone = walks.filter(F.col("stop").isin("dead", "loop")).select(
        "graph", F.col("start_page").alias("src"), F.array_join("forced", " ").alias("path"), "pages", F.col("end_page").alias("tgt"),
        F.col("weight").alias("step_score"),
    )
    steps = plain.unionByName(further.join(forced.distinct(), ["graph", "src"], "left_semi")).unionByName(alone)
    entered = F.concat(F.array("src"), F.col("pages"))
    return steps.filter(F.size(F.array_distinct(entered)) == F.size(entered))


class _Steps:
    """Steps of all pages as arrays, those of a page next to each other."""

    def __init__(self, steps: pd.DataFrame):
        names = sorted({*steps["src"], *(p for pages in steps["pages"] for p in pages)})
        self.page = {p: i for i, p in enumerate(names)}
        steps = steps.sort_values(["src", "path"], kind="stable").reset_index(drop=True)
        src = steps["src"].map(self.page).to_numpy(dtype=np.int64)
        self.starts = np.searchsorted(src, np.arange(len(names) + 1))
        self.paths = steps["path"].to_numpy()
        # Python orders text by code points, which is the order of UTF-8 bytes.
        order = {p: i for i, p in enumerate(sorted(set(self.paths)))}
        self.place = np.array([order[p] for p in self.paths], np.int64)
        self.score = steps["step_score"].to_numpy(dtype=np.float64)
        self.tgt = steps["tgt"].map(self.page).to_numpy(dtype=np.int64)
        self.width = max((len(p) for p in steps["pages"]), default=1)
        self.pages = np.full((len(steps), self.width), len(names), np.int64)
        for i, pages in enumerate(steps["pages"]):
            self.pages[i, : len(pages)] = [self.page[p] for p in pages]
        self.n = len(names)
        # The largest score among the steps of a page that are not here.
        self.left_out = np.full(self.n, -np.inf)
        np.maximum.at(self.left_out, src, steps["left_out"].fillna(-np.inf).to_numpy(dtype=np.float64))

    def beam(self, starts: list[str], beam: int, depth: int) -> Iterator[tuple[int, int, str, float]]:
        """``depth, rank, path, score`` of the best paths from some pages together; :class:`LookupError` when a step left out might be among them."""
        front = []
        for start in starts:
            if start in self.page:
                first = np.zeros(self.n + 1, bool)
                first[self.page[start]] = True
                front.append((0.0, "", self.page[start], first))
        for d in range(1, depth + 1):
            found = []
            for parent, (score, path, page, been) in enumerate(front):
                rows = np.arange(self.starts[page], self.starts[page + 1])
                rows = rows[~been[self.pages[rows]].any(axis=1)] if len(rows) else rows
                if self.left_out[page] > -np.inf:
                    # Of equal scores those with the smaller paths are here, unless adding up made them equal.
                    own = np.partition(self.score[rows], len(rows) - beam)[len(rows) - beam] if len(rows) >= beam else -np.inf
                    if own < self.left_out[page] or own > self.left_out[page] and score + own <= score + self.left_out[page]:
                        raise LookupError(page)
                if len(rows):
                    total = score + self.score[rows]
                    if len(rows) > beam:
                        # The best of one parent by score, then path; among equal scores all are kept for the order of paths.
                        low = np.partition(total, len(total) - beam)[len(total) - beam]
                        keep = total >= low
                        rows, total = rows[keep], total[keep]
                    best = np.lexsort((self.place[rows], -total))[:beam]
                    found += [(-t, path + " " + self.paths[r] if path else self.paths[r], parent, r) for t, r in zip(total[best].tolist(), rows[best].tolist())]
            if not found:
                return
            found = sorted(found, key=lambda f: f[:2])[:beam]
            grown = []
            for rank, (score, path, parent, r) in enumerate(found, 1):
                yield d, rank, path, -score
                been = front[parent][3].copy()
                been[self.pages[r]] = True
                been[self.n] = False
                grown.append((-score, path, int(self.tgt[r]), been))
            front = grown


def beam_paths(starts: DataFrame, steps: DataFrame, beam: int = 5, depth: int = 60, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Best ``beam`` paths per task and depth, for all tasks at once: ``task, depth, rank, path, score``.

    ``starts(task, page_id)`` are the first pages of each task, ``steps(src, path, pages, tgt, step_score)`` come from :func:`collapsed_steps` or a
    scorer. A path's score is the sum of its steps; no page is entered twice; ties go to the smaller path. A task ends when no step is left.

    Steps whose bytes are counted first are sent to the tasks, where each start is searched to the end, so nothing is shuffled. Of more steps
    than that the best of each page are sent, as many as the bytes allow; tasks whose search might need another step are joined to all steps
    level by level. All routes give the same rows.
    """
    steps = kept(steps.select("src", "path", "pages", "tgt", "step_score"), "steps")
    bytes_of = F.octet_length("src") + 2 * F.octet_length("path") + F.size("pages") * 60 + 100
    size = steps.agg(F.sum(bytes_of).alias("n")).first()["n"] or 0
    held = steps.withColumn("left_out", F.lit(None).cast("double"))
    if size > max_broadcast_bytes:
        held = _best_steps(steps, bytes_of, beam, depth, max_broadcast_bytes)
    # The first pages of a task are few: one for each of its recordings at most.
    pages = starts.groupBy("task").agg(F.sort_array(F.collect_set("page_id")).alias("pages"))
    if held is None:
        return _by_levels(starts, steps, beam, depth)
    sent = steps.sparkSession.sparkContext.broadcast(_Steps(held.toPandas()))
    kind = starts.schema["task"].dataType.simpleString()
    tasks = int(starts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for task, pages in zip(pdf["task"], pdf["pages"]):
                try:
                    rows = list(sent.value.beam(list(pages), beam, depth))
                except LookupError:
                    rows = [(0, None, None, None)]
                if rows:
                    out = pd.DataFrame(rows, columns=["depth", "rank", "path", "score"])
                    out.insert(0, "task", task)
                    yield out

    # Dealt by a number of its own, so that the few bytes of the starts are not put into one task.
    found = pages.repartition(tasks, F.xxhash64("task")).mapInPandas(run, f"task {kind}, depth int, rank int, path string, score double")
    if size <= max_broadcast_bytes:
        return found
    found = kept(found, "beams")
    again = kept(found.filter("depth = 0").select("task"), "beams-again")
    found = found.filter("depth > 0")
    if again.isEmpty():
        return found
    return found.unionByName(_by_levels(starts.join(again, starts["task"].eqNullSafe(again["task"]), "left_semi"), steps, beam, depth))


def _best_steps(steps: DataFrame, bytes_of, beam: int, depth: int, most: int) -> DataFrame | None:
    """The best steps of every page in at most about ``most`` bytes, with the largest score ``left_out`` of its page; None if they are too few.

    With whole scores no more than ``beam`` steps of a page enter the same pages: others of them are never among the best of a path.
    """
    order = "ORDER BY step_score DESC, path"
    whole = steps.agg(
        F.coalesce(F.bool_and(F.col("step_score") == F.floor("step_score")), F.lit(False)).alias("w"), F.max(F.abs("step_score")).alias("m")
    ).first()
    if whole["w"] and whole["m"] * depth < 2**53:
        steps = steps.withColumn("n", F.expr(f"row_number() OVER (PARTITION BY src, pages {order})")).filter(F.col("n") <= beam).drop("n")
    steps = kept(steps, "best-steps")
    total = steps.agg(F.countDistinct("src").alias("pages"), F.avg(bytes_of).alias("bytes")).first()
    each = int(most / max(1.0, total["pages"] * total["bytes"])) if total["pages"] else 0
    if each < 4 * beam:
        return None
    ranked = steps.withColumn("n", F.expr(f"row_number() OVER (PARTITION BY src {order})")).filter(F.col("n") <= each + 1)
    last = F.when(F.col("n") == each, F.expr(f"lead(step_score) OVER (PARTITION BY src {order})"))
    return ranked.withColumn("left_out", last).filter(F.col("n") <= each).drop("n")


def _by_levels(starts: DataFrame, steps: DataFrame, beam: int, depth: int) -> DataFrame:
    """One join per level. A level stores its rows with the place of their parents; paths are put together once at the end.

    Paths of one level have the same number of steps, so their order is that of their parents' paths, then of their last step.
    """
    front = kept(
        starts.select("task", F.col("page_id").alias("src"), F.lit(0.0).alias("score"), F.array("page_id").alias("visited"), F.lit(1).alias("rank"), F.lit(1).alias("place")),
        "frontier",
    )
    levels = []
    for _ in range(depth):
        grown = front.join(steps, "src").filter(~F.arrays_overlap("visited", "pages")).select(
            "task", F.col("tgt").alias("src"), (F.col("score") + F.col("step_score")).alias("score"), F.col("rank").alias("parent"),
            F.col("place").alias("before"), "path", "pages", "visited",
        )
        rank = F.expr("row_number() OVER (PARTITION BY task ORDER BY score DESC, before, path)").cast("int")
        best = grown.withColumn("rank", rank).filter(F.col("rank") <= beam)
        # The order by path among the few that stay.
        best = best.withColumn("place", F.expr("row_number() OVER (PARTITION BY task ORDER BY before, path)").cast("int"))
        level = kept(best.withColumn("visited", F.concat("visited", "pages")).drop("pages", "before"), "level")
        if level.isEmpty():
            break
        levels.append(level.select("task", "rank", "parent", "path", "score"))
        front = level.select("task", "src", "score", "visited", "rank", "place")
    out = None
    so_far = None
    for d, level in enumerate(levels, 1):
        if so_far is None:
            so_far = level.select("task", "rank", "path", "score")
        else:
            before = so_far.select("task", F.col("rank").alias("parent"), F.col("path").alias("head"))
            so_far = level.join(before, ["task", "parent"]).select("task", "rank", F.concat_ws(" ", "head", "path").alias("path"), "score")
        if d % 8 == 0:
            so_far = kept(so_far, "paths")
        rows = so_far.select("task", F.lit(d).alias("depth"), "rank", "path", "score")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        kind = starts.schema["task"].dataType.simpleString()
        return starts.sparkSession.createDataFrame([], f"task {kind}, depth int, rank int, path string, score double")
    return out
