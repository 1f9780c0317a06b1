"""Joins with a shape of their own: spatial, interval, lookup with fallback, fuzzy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.udfs import FUZZY_RATIO, fuzzy_equal, fuzzy_match
from ..plans.checkpoints import kept
from ..plans.ordered import ordered_columns, row_number
from ..plans.spread import spread


def nearest_coords(points: DataFrame, places: DataFrame, delta: float = 0.001) -> DataFrame:
    """Pairs less than ``delta`` apart in both coordinates.

    ``points(point_id, lat, lon)``, ``places(place_id, p_lat, p_lon)``.  Both fall into grid cells of
    side ``delta``; a place is listed in its cell and the eight around it, which turns
    the range condition into an equi join.
    """
    cell = lambda c: F.floor(F.col(c) / delta)
    around = F.expr("sequence(-1, 1)")
    grid = (
        places.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
        .withColumns({"_cx": cell("p_lat") + F.col("_dx"), "_cy": cell("p_lon") + F.col("_dy")})
        .drop("_dx", "_dy")
    )
    close = (F.abs(F.col("lat") - F.col("p_lat")) < delta) & (F.abs(F.col("lon") - F.col("p_lon")) < delta)
    return (
        points.withColumns({"_cx": cell("lat"), "_cy": cell("lon")})
        .join(grid, ["_cx", "_cy"])
        .filter(close)
        .drop("_cx", "_cy")
    )


def interval_overlap(events: DataFrame, points: DataFrame, bucket_seconds: int = 86400) -> DataFrame:
    """Events whose [start, end] holds the point; times are epoch seconds.

    ``events(event_id, start_s, end_s)``, ``points(point_id, at_s)``.  Buckets double in width from
    level to level, and an event uses the first level whose buckets are as wide as it is long: it
    is listed twice at most, however long it lasts.  A point lies in one bucket of each level that
    occurs, and there are at most 64 of those, so each pair meets once.
    """
    events = events.filter(F.col("end_s") >= F.col("start_s"))
    length = (F.col("end_s") - F.col("start_s") + 1) / bucket_seconds
    level = F.greatest(F.lit(0), F.ceil(F.log2(length))).cast("int")
    leveled = events.withColumn("_l", level)
    levels = [r["_l"] for r in leveled.select("_l").filter(F.col("_l").isNotNull()).distinct().collect()]
    bucket = lambda c: F.floor(F.col(c) / (F.pow(F.lit(2), F.col("_l")) * bucket_seconds))
    spread = leveled.withColumn("_b", F.explode(F.array_distinct(F.array(bucket("start_s"), bucket("end_s")))))
    at = points.withColumn("_l", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumn("_b", bucket("at_s"))
    return (
        spread.join(at, ["_l", "_b"])
        .filter((F.col("start_s") <= F.col("at_s")) & (F.col("end_s") >= F.col("at_s")))
        .drop("_l", "_b")
    )


def label_below(fields: DataFrame, elements: DataFrame) -> DataFrame:
    """First element with the field's label directly below it.

    ``fields(screen_id, field_id, label, y_min, y_max)``, ``elements(screen_id, idx, text, e_min)``.  Below means
    its top lies between the field's bottom and one field height further.
    """
    f = fields.select("screen_id", "field_id", F.col("label").alias("text"), "y_min", "y_max")
    height = F.col("y_max") - F.col("y_min")
    hit = f.join(elements, ["screen_id", "text"]).filter(
        (F.col("e_min") >= F.col("y_max")) & (F.col("e_min") <= F.col("y_max") + height)
    )
    return hit.groupBy("screen_id", "field_id").agg(F.min("idx").alias("label_idx"))


def playlist_join(playlists: DataFrame, relation: DataFrame, media: DataFrame) -> DataFrame:
    """Playlist contents: name, file, position."""
    return (
        playlists.join(relation, "id_playlist")
        .join(media, "id_media")
        .select(
            F.col("name").alias("playlist_name"),
            F.col("filename").alias("media_file_name"),
            F.col("position").alias("order_in_playlist"),
        )
    )


def playlist_rownum_join(playlists: DataFrame, songs: DataFrame) -> DataFrame:
    """Playlist contents numbered from 0 inside each playlist name by song key."""
    rows = playlists.join(songs, playlists["playlist_id"] == songs["playlist_creator_id"]).select(
        "playlist_name", "title", "duration", "song_key"
    )
    out = ordered_columns(rows, ["playlist_name"], ["song_key"], [row_number("rn")])
    return out.select(
        "playlist_name",
        F.col("title").alias("media_file_name"),
        F.col("duration").alias("duration_ms"),
        (F.col("rn") - 1).alias("order_in_playlist"),
    )


def normalise_app(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), " ", "-")


def resolve_app(rows: DataFrame, packages: DataFrame, tasks: DataFrame, strict: bool = True) -> DataFrame:
    """App of each row: by package, else by task; an unknown one is an error.

    ``rows(package, task)``, ``packages(package, app)``, ``tasks(task, task_app)``.
    """
    out = rows.join(packages, "package", "left").join(tasks, "task", "left")
    app = F.coalesce("app", normalise_app(F.col("task_app")))
    if strict:
        app = F.coalesce(app, F.raise_error(F.concat(F.lit("no app for task "), F.coalesce("task", F.lit("?")))))
    return out.withColumn("app_key", app).drop("app", "task_app")


def referred_element(actions: DataFrame, elements: DataFrame) -> DataFrame:
    """Element a model's letter refers to, for actions that take one.

    ``actions(screen_id, action, letter)``, ``elements(screen_id, letter, idx)``.
    """
    # The actions that name an element.
    kinds = ["CLICK", "LONG PRESS", "INPUT TEXT", "SWIPE"]
    takes = actions.filter(F.col("action").isin(kinds) & F.col("letter").isNotNull())
    return takes.join(elements, ["screen_id", "letter"])


# ----------------------------------------------------------------- fuzzy join

# Bytes of the largest right side that is broadcast; its profiles take some 9 KB a text beside them.
MAX_BROADCAST_BYTES = 32_000_000
PROFILE_BYTES = 9_000
BLOCK_ROWS = 2048
_GRAM = 3
_CHAR_BINS, _GRAM_BINS = 64, 1024


def _profile(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Binned character and trigram counts; merging bins can only raise an overlap."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    chars = np.bincount(codes % _CHAR_BINS, minlength=_CHAR_BINS)
    if len(codes) < _GRAM:
        return chars, np.zeros(_GRAM_BINS, dtype=np.int64)
    mixed = codes[:-2] * 31 * 31 + codes[1:-1] * 31 + codes[2:]
    return chars, np.bincount(mixed % _GRAM_BINS, minlength=_GRAM_BINS)


class _TextBlock:
    """Right-hand texts sorted by length, with their profiles."""

    def __init__(self, ids, texts):
        texts = [t.lower() for t in texts]
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        self.ids = [ids[i] for i in order]
        self.texts = [texts[i] for i in order]
        self.sizes = np.array([len(t) for t in self.texts])
        profiles = [_profile(t) for t in self.texts]
        self.chars = np.array([p[0] for p in profiles])
        self.grams = np.array([p[1] for p in profiles])

    def matches(self, text: str):
        """Ids of the texts whose ratio reaches the gate; every bound is exact.

        With M matched characters, 2·M ≥ r·(n+m) bounds the lengths and the shared
        characters.  At most e = n+m−2·M characters are unmatched and each spoils at
        most three trigrams, so at least n−2−3·e trigrams are shared.
        """
        text = text.lower()
        n = len(text)
        lo = np.searchsorted(self.sizes, n * FUZZY_RATIO / (2 - FUZZY_RATIO) - 1e-9)
        hi = np.searchsorted(self.sizes, n * (2 - FUZZY_RATIO) / FUZZY_RATIO + 1e-9, side="right")
        if lo >= hi:
            return
        chars, grams = _profile(text)
        total = n + self.sizes[lo:hi]
        shared = np.minimum(self.chars[lo:hi], chars).sum(axis=1)
        keep = np.flatnonzero(2 * shared >= FUZZY_RATIO * total - 1e-9)
        if not len(keep):
            return
        spoiled = _GRAM * np.floor((1 - FUZZY_RATIO) * total[keep] + 1e-9)
        common = np.minimum(self.grams[lo:hi][keep], grams).sum(axis=1)
        for i in keep[common >= n - (_GRAM - 1) - spoiled]:
            j = lo + int(i)
            if fuzzy_equal(text, self.texts[j], ignore_case=False):
                yield self.ids[j]


def fuzzy_join(
    left: DataFrame,
    right: DataFrame,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """All pairs of texts with a sequence-matcher ratio of at least 0.9, ignoring case.

    ``left(left_id, left_text)``, ``right(right_id, right_text)``.  Texts that are equal but for case are one on
    either side.  A right side whose bytes are counted first is broadcast and the left side is read once, without a shuffle.
    A larger one meets the left side by shared rare trigrams (:func:`_by_grams`).  Exact bounds on lengths,
    characters and trigrams leave few pairs for the ratio; only matches are emitted.
    """
    left = left.select("left_id", F.lower("left_text").alias("left_text")).filter(F.col("left_text").isNotNull())
    right = right.select("right_id", F.lower("right_text").alias("right_text")).filter(F.col("right_text").isNotNull())
    left, right = kept(left, "fuzzy-left"), kept(right, "fuzzy-right")
    texts = kept(left.select(F.col("left_text").alias("l")).distinct(), "fuzzy-left-texts")
    others = kept(right.select(F.col("right_text").alias("r")).distinct(), "fuzzy-right-texts")
    size = others.agg(F.coalesce(F.sum(F.octet_length("r") + PROFILE_BYTES), F.lit(0)).alias("n")).first()["n"]
    if size > max_broadcast_bytes:
        found = _by_grams(texts, others, block_rows)
    else:
        head = [r.r for r in others.collect()]
        shared = left.sparkSession.sparkContext.broadcast((head, head))

        def scan(batches):
            block = _TextBlock(*shared.value)
            for pdf in batches:
                yield _pairs(pdf["l"], pdf["l"], block)

        found = spread(texts, "l").mapInPandas(scan, "l string, r string")
    pairs = left.join(found.withColumnRenamed("l", "left_text"), "left_text").withColumnRenamed("r", "right_text")
    return pairs.join(right, "right_text").select("left_id", "right_id")


def _grams(text: Column) -> Column:
    """The different trigrams of a text."""
    n = F.length(text)
    return F.when(
        n >= _GRAM, F.array_distinct(F.transform(F.sequence(F.lit(1), n - (_GRAM - 1)), lambda i: F.substr(text, i, F.lit(_GRAM))))
    ).otherwise(F.array().cast("array<string>"))


def _by_grams(texts: DataFrame, others: DataFrame, block_rows: int) -> DataFrame:
    """``l, r``: pairs of different lower-case texts that match, for two large sides.

    With T the characters of both texts, at most 0.1 T are unmatched, and each spoils three trigrams.  Below T = 20 that leaves
    equal texts and those that differ by one character more: the longer one without that character is the
    shorter one.  Else, with ``s`` the most that a partner of a text can spoil, two texts of more than ``s`` different trigrams share
    one among the ``s + 1`` rarest of each: an equi join, whose survivors meet the count of common trigrams and then the ratio.
    Texts of few different trigrams post all of them, which finds their pairs with the others; among themselves they meet in
    blocks by length.
    """
    reach = (2 - FUZZY_RATIO) / FUZZY_RATIO
    spoil = (_GRAM * F.floor((1 - FUZZY_RATIO) * (1 + reach) * F.length("t") + 1e-9)).cast("int")
    sides = texts.select(F.lit(0).alias("side"), F.col("l").alias("t")).unionByName(others.select(F.lit(1).alias("side"), F.col("r").alias("t")))
    sides = kept(sides.withColumn("grams", _grams(F.col("t"))).withColumn("spoil", spoil), "fuzzy-grams")
    loose = F.size("grams") <= F.col("spoil")
    posted = sides.select("side", "t", "spoil", F.explode("grams").alias("gram"))
    often = posted.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    ranked = posted.join(often, "gram").groupBy("side", "t", "spoil").agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("by"))
    prefix = kept(ranked.select("side", "t", F.explode(F.slice("by.gram", F.lit(1), F.col("spoil") + 1)).alias("gram")), "fuzzy-prefix")
    one = prefix.filter("side = 0").select("gram", F.col("t").alias("l"))
    two = prefix.filter("side = 1").select("gram", F.col("t").alias("r"))
    total = F.length("l") + F.length("r")
    fits = 2 * F.least(F.length("l"), F.length("r")) >= FUZZY_RATIO * total - 1e-9
    met = one.join(two, "gram").filter(fits).select("l", "r").distinct()
    shared = F.size(F.array_intersect(_grams(F.col("l")), _grams(F.col("r"))))
    least = F.greatest(F.size(_grams(F.col("l"))), F.size(_grams(F.col("r")))) - _GRAM * F.floor((1 - FUZZY_RATIO) * total + 1e-9)
    met = met.filter(shared >= least)

    # Short pairs: a text is a key as it is and without each of its characters.
    def keys(df: DataFrame, name: str) -> DataFrame:
        n = F.length(name)
        cut = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substr(name, F.lit(1), i - 1), F.substr(name, i + 1)))
        return df.filter(n < 20).select(name, F.explode(F.array_distinct(F.concat(F.array(name), cut))).alias("key"))

    short = keys(texts, "l").join(keys(others, "r"), "key").filter((total < 20) & ((F.col("key") == F.col("l")) | (F.col("key") == F.col("r"))))
    few = [sides.filter(loose & (F.col("side") == i)) for i in (0, 1)]
    blocks = _fuzzy_blocks(
        few[0].select(F.col("t").alias("left_id"), F.col("t").alias("left_text")),
        few[1].select(F.col("t").alias("right_id"), F.col("t").alias("right_text")),
        block_rows,
        "left_id string, right_id string",
    )
    candidates = met.unionByName(short.select("l", "r")).distinct().filter(fuzzy_match(F.col("l"), F.col("r")))
    return candidates.unionByName(blocks.toDF("l", "r")).distinct()


def _pairs(ids, texts, block) -> pd.DataFrame:
    found = [(i, m) for i, t in zip(ids, texts) for m in block.matches(t)]
    return pd.DataFrame([f[:2] for f in found], columns=["l", "r"])


def _fuzzy_blocks(left, right, block_rows, schema):
    step = float(np.log((2 - FUZZY_RATIO) / FUZZY_RATIO))
    band = lambda c: F.floor(F.log(F.greatest(F.length(F.lower(c)), F.lit(1)).cast("double")) / step).cast("int")
    lefts = left.withColumn("band", band("left_text"))
    # Lengths of a matching pair differ by less than one band ratio.
    rights = right.withColumn("band", F.explode(F.transform(F.expr("array(-1, 0, 1)"), lambda d: band("right_text") + d)))
    n_l = lefts.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("nl"))
    n_r = rights.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("nr"))
    cuts = n_l.join(n_r, "band")
    lefts = lefts.join(cuts, "band").select(
        "band", F.pmod(F.xxhash64("left_id"), F.col("nl")).cast("int").alias("bl"),
        F.explode(F.expr("sequence(0, nr - 1)")).alias("br"), "left_id", "left_text",
    )
    rights = rights.join(cuts, "band").select(
        F.col("band").alias("band2"), F.explode(F.expr("sequence(0, nl - 1)")).alias("bl2"),
        F.pmod(F.xxhash64("right_id"), F.col("nr")).cast("int").alias("br2"), "right_id", "right_text",
    )

    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"left_id": [], "right_id": []})
        found = _pairs(a["left_id"], a["left_text"], _TextBlock(b["right_id"].tolist(), b["right_text"].tolist()))
        return found.set_axis(["left_id", "right_id"], axis=1)

    return lefts.groupBy("band", "bl", "br").cogroup(rights.groupBy("band2", "bl2", "br2")).applyInPandas(match, schema)
