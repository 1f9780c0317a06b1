"""Frequent action-sequence mining over token chains.

A chain is a set of rows ``chain_id, pos, src, elem, tgt``.  Chains stay in
long form: one row per token, so neither a long chain nor a popular pair is
ever gathered into one task.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoints import kept
from ..plans.ordered import (
    group_limit,
    has_hot_group,
    lag,
    lead,
    ordered_columns,
    row_number,
    running_max,
)

CHAIN = ["chain_id"]


@dataclass(frozen=True)
class Merged:
    """A composite token: its components and level."""

    token: str
    full: str
    level: int

    @property
    def open(self) -> str:
        return self.full.rsplit("|", 1)[0] + "|*"


def atomic_frequencies(chains: DataFrame) -> DataFrame:
    """Count of every (src, elem, tgt) token over all chains."""
    return chains.groupBy("src", "elem", "tgt").agg(F.count(F.lit(1)).alias("frequency"))


def as_tokens(chains: DataFrame) -> DataFrame:
    """Chain rows with one text token ``src|elem|tgt`` each."""
    return chains.select(
        "chain_id",
        F.col("pos").cast("long").alias("pos"),
        F.concat_ws("|", "src", "elem", "tgt").alias("token"),
    )


def _is_merged(token: Column) -> Column:
    # Atomic tokens hold separators, merged ids do not.
    return ~token.contains("|")


def _looked_up(token: Column, values: dict[str, str], atomic: Column) -> Column:
    """Value of a merged token from the small vocabulary, else the atomic rule."""
    # One folded map literal: the generated code stays the same in every round.
    known = F.from_json(F.lit(json.dumps(values)), "map<string,string>")
    return F.when(_is_merged(token), F.try_element_at(known, token)).otherwise(atomic)


def _pair_key(vocab: list[Merged], strict: bool, token="token", nxt="next_token") -> Column:
    """Canonical key of a pair: all components, the last target replaced by ``*``.

    Pairs that differ only in that target count as one.  With ``strict`` a merged
    token adds no components, as observed in practice; otherwise it adds all of
    its own.
    """
    left, right = F.col(token), F.col(nxt)
    open_right = _looked_up(right, {m.token: m.open for m in vocab}, F.regexp_replace(right, r"\|[^|]*$", "|*"))
    if not strict:
        return F.concat_ws(";", _looked_up(left, {m.token: m.full for m in vocab}, left), open_right)
    return (
        F.when(_is_merged(left) & _is_merged(right), F.concat_ws(";", left, right))
        .when(_is_merged(left), open_right)
        .when(_is_merged(right), F.regexp_replace(left, r"\|[^|]*$", "|*"))
        .otherwise(F.concat_ws(";", left, open_right))
    )


def _with_next(tokens: DataFrame, hot: bool | None) -> DataFrame:
    return ordered_columns(tokens, CHAIN, ["pos"], [lead("next_token", "token")], hot=hot)


def _count_pairs(paired: DataFrame, vocab: list[Merged], strict: bool, order: Column) -> DataFrame:
    """Frequency and first-seen pair per canonical key.

    Rows are first combined per distinct pair, and only those get their key, so
    the long key strings never meet the rows.
    """
    distinct = (
        paired.filter(F.col("next_token").isNotNull())
        .groupBy("token", "next_token")
        .agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("seen"))
    )
    return (
        distinct.withColumn("pair_key", _pair_key(vocab, strict))
        .groupBy("pair_key")
        .agg(
            F.sum("n").alias("frequency"),
            F.min("seen").alias("first_seen"),
            F.min_by(F.struct("token", "next_token"), "seen").alias("pair"),
        )
    )


def pair_frequencies(chains: DataFrame, hot: bool | None = None) -> DataFrame:
    """Frequency of adjacent token pairs, with the first-seen pair of each group."""
    paired = _with_next(as_tokens(chains), hot)
    return _count_pairs(paired, [], False, F.struct("chain_id", "pos")).select(
        "pair_key",
        "frequency",
        F.col("pair.token").alias("first_token"),
        F.col("pair.next_token").alias("second_token"),
    )


def merge_pair(paired: DataFrame, hit: Column, merged_id: str, hot: bool) -> DataFrame:
    """Replace matching adjacent pairs, greedy from the left, without overlap.

    In a maximal run of consecutive match positions the greedy scan takes every
    other one, starting with the first; the run position is the distance to the
    last non-match before it.
    """
    marked = ordered_columns(
        paired.withColumn("hit", F.coalesce(hit, F.lit(False))), CHAIN, ["pos"], [row_number("idx")], hot=hot
    )
    marked = ordered_columns(
        marked, CHAIN, ["pos"],
        [running_max("miss", F.when(~F.col("hit"), F.col("idx")).otherwise(F.lit(0)))],
        hot=hot,
    )
    taken = F.col("hit") & ((F.col("idx") - F.col("miss")) % 2 == 1)
    marked = ordered_columns(
        marked.withColumn("taken", taken), CHAIN, ["pos"], [lag("after_taken", "taken")], hot=hot
    )
    return (
        marked.filter(~F.coalesce(F.col("after_taken"), F.lit(False)))
        .withColumn("token", F.when(F.col("taken"), F.lit(merged_id)).otherwise(F.col("token")))
        .drop("next_token", "hit", "idx", "miss", "taken", "after_taken")
    )


def _hot(chains: DataFrame) -> bool:
    return has_hot_group(chains, CHAIN, group_limit(chains))


def _top_pair(paired: DataFrame, vocab: list[Merged], strict: bool, order: Column):
    """The best pair of a round: one row comes back."""
    best = _count_pairs(paired, vocab, strict, order).orderBy(F.desc("frequency"), "first_seen").limit(1)
    rows = best.collect()
    return rows[0] if rows else None


def merge_top_pair(chains: DataFrame, merged_id: str = "M0", min_freq: int = 2) -> DataFrame:
    """One mining round: chains after replacing their most frequent pair."""
    tokens = kept(as_tokens(chains), "tokens")
    hot = _hot(tokens)
    paired = kept(_with_next(tokens, hot), "pairs")
    best = _top_pair(paired, [], False, F.struct("chain_id", "pos"))
    if best is None or best["frequency"] < min_freq:
        return paired.drop("next_token")
    return merge_pair(paired, _pair_key([], False) == F.lit(best["pair_key"]), merged_id, hot)


MERGE_SCHEMA = (
    "merge_order int, merged_id string, first_token string, second_token string, "
    "frequency long, level int, components array<string>"
)


#: Most different pairs whose counts the driver keeps, some 40 MB; beyond them chains are mined row by row.
MAX_PAIRS = 200_000
#: Tokens of the longest chain that is held as one row.
MAX_CHAIN = 100_000
#: Rounds after which the versions of chains are written together.
COMPACT = 8


def mine_sequences(
    chains: DataFrame, num_merges: int = 20, min_freq: int = 2, strict: bool = False, max_pairs: int = MAX_PAIRS, compact: int = COMPACT
) -> tuple[DataFrame, DataFrame]:
    """Repeatedly merge the most frequent adjacent pair.

    Returns the merge table (at most ``num_merges`` rows) and the rewritten
    chains.  Equal chains are one with a multiplicity.  A round rewrites only the
    chains that hold the pair and adds the differences to the pair counts (:class:`_Pairs`); nothing
    is shuffled but these differences.  When a chain is too long for a row, or pairs are too many for
    the driver, a round is a pass over the token rows instead (:func:`_mine_rows`).  Both give the same.
    """
    # Stored first, so that the checks below do not run the chains' own plan again.
    tokens = kept(as_tokens(chains), "mined-tokens")
    if not has_hot_group(tokens, CHAIN, min(group_limit(tokens), MAX_CHAIN)):
        whole = _collapsed(tokens)
        pairs = _Pairs(whole, max_pairs)
        if pairs.fit:
            return _mine_chains(tokens, whole, pairs, num_merges, min_freq, strict, compact)
    return _mine_rows(tokens, _hot(tokens), num_merges, min_freq, strict)


def _collapsed(tokens: DataFrame) -> DataFrame:
    """``rep, n, chains, toks, pos``: different chains with how many there are; ``rep`` is the smallest id among them."""
    rows = tokens.groupBy("chain_id").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("t"))
    rows = rows.select("chain_id", F.col("t.token").alias("toks"), F.col("t.pos").alias("pos"))
    first = F.min(F.struct("chain_id", "pos")).alias("f")
    same = rows.groupBy("toks").agg(F.count(F.lit(1)).alias("n"), first)
    return kept(same.select(F.col("f.chain_id").alias("rep"), "n", "toks", F.col("f.pos").alias("pos")), "mined-chains")


def _occurrences(toks: str, pos: str) -> Column:
    """Neighbours in a chain as an array of ``(a, b, pos)``."""
    here = F.expr(f"slice({toks}, 1, greatest(size({toks}) - 1, 0))")
    after = F.expr(f"slice({toks}, 2, greatest(size({toks}) - 1, 0))")
    at = F.expr(f"slice({pos}, 1, greatest(size({toks}) - 1, 0))")
    return F.arrays_zip(here.alias("a"), after.alias("b"), at.alias("pos"))


class _Pairs:
    """Frequency and first place of every pair of neighbours, on the driver, bounded by ``max_pairs``."""

    def __init__(self, chains: DataFrame, max_pairs: int):
        rows = chains.select("rep", "n", F.explode(_occurrences("toks", "pos")).alias("o"))
        counts = rows.groupBy("o.a", "o.b").agg(F.sum("n").alias("n"), F.min(F.struct("rep", "o.pos")).alias("seen"))
        found = counts.limit(max_pairs + 1).collect()
        self.fit = len(found) <= max_pairs
        self.count = {(r.a, r.b): r.n for r in found}
        self.seen = {(r.a, r.b): (r.seen.rep, r.seen.pos) for r in found}

    def update(self, changed: DataFrame) -> None:
        """Adds the difference between the old and the new form of the rewritten chains."""
        old = changed.select("rep", (-F.col("n")).alias("n"), F.explode(_occurrences("old_toks", "old_pos")).alias("o"))
        new = changed.select("rep", "n", F.explode(_occurrences("toks", "pos")).alias("o"))
        place = F.struct("rep", "o.pos")
        rows = old.unionByName(new).groupBy("o.a", "o.b").agg(
            F.sum("n").alias("n"), F.min(F.when(F.col("n") < 0, place)).alias("gone"), F.min(F.when(F.col("n") > 0, place)).alias("come")
        )
        for r in rows.collect():
            pair = (r.a, r.b)
            self.count[pair] = self.count.get(pair, 0) + r.n
            if not self.count[pair]:
                del self.count[pair]
                self.seen.pop(pair, None)
                continue
            gone, come = (tuple(x) if x else None for x in (r.gone, r.come))
            known = self.seen.get(pair, come)
            if known is not None and known == gone and come != gone:
                self.seen[pair] = None  # its first place was in a rewritten chain: looked up when it matters
            elif known is not None:
                self.seen[pair] = min(known, come) if come else known

    def places(self, wanted: list[tuple[str, str]], live: DataFrame) -> None:
        """Looks up the first places that are not known."""
        missing = [p for p in wanted if self.seen.get(p) is None]
        if not missing:
            return
        asked = live.sparkSession.createDataFrame(missing, "a string, b string")
        rows = live.select("rep", F.explode(_occurrences("toks", "pos")).alias("o")).select("rep", "o.a", "o.b", "o.pos")
        found = rows.join(asked, ["a", "b"]).groupBy("a", "b").agg(F.min(F.struct("rep", "pos")).alias("seen"))
        for r in found.collect():
            self.seen[(r.a, r.b)] = (r.seen.rep, r.seen.pos)

    def best(self, key, live: DataFrame):
        """``(frequency, first pair, pairs)`` of the most frequent key, ties to the first place."""
        keys: dict = {}
        for pair, n in self.count.items():
            keys.setdefault(key(*pair), []).append(pair)
        if not keys:
            return None
        total = {k: sum(self.count[p] for p in pairs) for k, pairs in keys.items()}
        top = max(total.values())
        tied = [k for k, n in total.items() if n == top]
        if len(tied) > 1 or len(keys[tied[0]]) > 1:
            self.places([p for k in tied for p in keys[k]], live)
            first = {k: min(keys[k], key=self.seen.__getitem__) for k in tied}
            won = min(tied, key=lambda k: self.seen[first[k]])
            return top, first[won], keys[won]
        return top, keys[tied[0]][0], keys[tied[0]]


def _plain_key(vocab: list[Merged], strict: bool):
    """:func:`_pair_key` for two tokens on the driver."""
    known = {m.token: m for m in vocab}
    opened = lambda t: known[t].open if t in known else t.rsplit("|", 1)[0] + "|*"

    def key(left: str, right: str) -> str:
        if not strict:
            return (known[left].full if left in known else left) + ";" + opened(right)
        if left in known:
            return f"{left};{right}" if right in known else opened(right)
        return opened(left) if right in known else left + ";" + opened(right)

    return key


def _mine_chains(tokens, whole, pairs, num_merges, min_freq, strict, compact):
    spark = tokens.sparkSession
    # Versions of chains: a version no longer counts where a later pair has been found in it.
    versions = [whole.select("rep", "n", "toks", "pos")]
    first_id = tokens.select("token").distinct().count()
    vocab: list[Merged] = []
    records = []

    def live() -> DataFrame:
        out = versions[0]
        for v in versions[1:]:
            out = out.unionByName(v)
        return out

    for i in range(num_merges):
        best = pairs.best(_plain_key(vocab, strict), live())
        if best is None or best[0] < min_freq:
            break
        frequency, parts, same = best
        known = {m.token: m for m in vocab}
        full = ";".join(known[p].full if p in known else p for p in parts)
        level = max(known[p].level if p in known else 1 for p in parts) + 1
        merged = Merged(f"M{first_id + i}", full, level)
        records.append((i + 1, merged.token, *parts, int(frequency), level, full.split(";")))
        vocab.append(merged)
        # Tokens hold no control characters, so a pair is one text.
        wanted = F.array(*[F.lit(f"{a}\x01{b}") for a, b in same])
        holds = F.arrays_overlap(F.transform(_occurrences("toks", "pos"), lambda o: F.concat_ws("\x01", o["a"], o["b"])), wanted)
        changed = kept(_rewritten(live().filter(holds), set(same), merged.token), "mined-version")
        pairs.update(changed)
        versions = [v.filter(~holds) for v in versions] + [changed.select("rep", "n", "toks", "pos")]
        if len(versions) > compact:
            versions = [kept(live(), "mined-chains")]
    final = live().select("rep", F.explode(F.arrays_zip("pos", "toks")).alias("t")).select("rep", F.col("t.pos").alias("pos"), F.col("t.toks").alias("token"))
    return spark.createDataFrame(records, MERGE_SCHEMA), _all_chains(tokens, whole, final)


def _all_chains(tokens: DataFrame, whole: DataFrame, final: DataFrame) -> DataFrame:
    """The rewritten rows of every chain from those of one of its equals, whose row numbers stand for its own positions."""
    rows = tokens.groupBy("chain_id").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("t"))
    rows = rows.select("chain_id", F.col("t.token").alias("toks"), F.col("t.pos").alias("own"))
    equal = rows.join(whole.select("rep", "toks", "pos"), "toks").select("chain_id", "rep", F.explode(F.arrays_zip("own", "pos")).alias("p"))
    return equal.select("chain_id", "rep", F.col("p.own").alias("own"), F.col("p.pos").alias("pos")).join(final, ["rep", "pos"]).select(
        "chain_id", F.col("own").alias("pos"), "token"
    )


def _rewritten(chains: DataFrame, same: set[tuple[str, str]], merged: str) -> DataFrame:
    """Chains with matching neighbours replaced, greedy from the left, next to their old form."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for toks, pos in zip(pdf["toks"], pdf["pos"]):
                new, at, i = [], [], 0
                while i < len(toks):
                    at.append(pos[i])
                    if i + 1 < len(toks) and (toks[i], toks[i + 1]) in same:
                        new.append(merged)
                        i += 2
                    else:
                        new.append(toks[i])
                        i += 1
                out.append((new, at))
            yield pd.DataFrame(
                {"rep": pdf["rep"], "n": pdf["n"], "old_toks": pdf["toks"], "old_pos": pdf["pos"], "toks": [o[0] for o in out], "pos": [o[1] for o in out]}
            )

    kind = chains.schema["rep"].dataType.simpleString()
    return chains.mapInPandas(
        run, f"rep {kind}, n long, old_toks array<string>, old_pos array<long>, toks array<string>, pos array<long>"
    )


def _mine_rows(tokens: DataFrame, hot: bool, num_merges: int, min_freq: int, strict: bool) -> tuple[DataFrame, DataFrame]:
    """One pass over the token rows a round: it replaces the last pair and looks up the next neighbours in the same partitioning."""
    spark = tokens.sparkSession
    # Rows are numbered once, so that "first seen" is one number in every round.
    numbered = ordered_columns(tokens, [], ["chain_id", "pos"], [row_number("seq")])
    paired = kept(_with_next(numbered, hot), "mined-pairs")
    first_id = tokens.select("token").distinct().count()
    vocab: list[Merged] = []
    records = []
    for i in range(num_merges):
        best = _top_pair(paired, vocab, strict, F.col("seq"))
        if best is None or best["frequency"] < min_freq:
            break
        parts = (best["pair"]["token"], best["pair"]["next_token"])
        known = {m.token: m for m in vocab}
        full = ";".join(known[p].full if p in known else p for p in parts)
        level = max(known[p].level if p in known else 1 for p in parts) + 1
        merged = Merged(f"M{first_id + i}", full, level)
        records.append((i + 1, merged.token, *parts, int(best["frequency"]), level, full.split(";")))
        hit = F.col("next_token").isNotNull() & (_pair_key(vocab, strict) == F.lit(best["pair_key"]))
        vocab.append(merged)
        paired = kept(_with_next(merge_pair(paired, hit, merged.token, hot), hot), "mined-pairs")
    return spark.createDataFrame(records, MERGE_SCHEMA), paired.select("chain_id", "pos", "token")


def rank_composites(merges: DataFrame) -> DataFrame:
    """Merges ordered by (frequency, level), named and previewed with short ids."""
    short = F.transform(
        "components",
        lambda c: F.concat(
            F.lit("("),
            F.array_join(
                F.transform(F.split(c, r"\|"), lambda p: F.concat(F.substring(p, 1, 8), F.lit("..."))),
                ", ",
            ),
            F.lit(")"),
        ),
    )
    # The merge table has one row per round, so a global order is cheap.
    ranked = merges.filter(F.col("level") >= 2).select(
        F.expr("row_number() OVER (ORDER BY frequency DESC, level DESC, merge_order)").alias("rank"),
        "*",
    )
    return ranked.select(
        # Fixed value: the names of composite actions.
        F.concat(F.lit("HighLevelAction_"), F.col("rank").cast("string")).alias("name"),
        F.col("merged_id").alias("id"),
        "frequency",
        "level",
        F.size("components").alias("num_components"),
        short.alias("components_preview"),
    )
