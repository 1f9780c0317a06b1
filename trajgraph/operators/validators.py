"""Graders: compare tables before and after, for all episodes in one job.

Every table carries ``episode_id``.  Row sets are compared by grouping the tagged
union of both sides, which is null-safe, combines map-side and never gathers an
episode's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.udfs import fuzzy_match
from ..plans.matching import ordered_match

EP = "episode_id"


def _sides(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows with their number of copies on each side."""
    one, zero = F.lit(1), F.lit(0)
    both = before.select(EP, *columns, one.alias("_b"), zero.alias("_a")).unionByName(
        after.select(EP, *columns, zero.alias("_b"), one.alias("_a"))
    )
    return both.groupBy(EP, *columns).agg(F.sum("_b").alias("n_before"), F.sum("_a").alias("n_after"))


def rows_in(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows of ``left`` that occur in ``right`` (set membership)."""
    s = _sides(left, right, columns)
    return s.filter((F.col("n_before") > 0) & (F.col("n_after") > 0)).select(EP, *columns)


def rows_not_in(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    s = _sides(left, right, columns)
    return s.filter((F.col("n_before") > 0) & (F.col("n_after") == 0)).select(EP, *columns)


def removal_integrity(before: DataFrame, after: DataFrame, targets: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Were exactly the target rows removed?

    ``targets(episode_id, key)``.  Counts per episode: targets still there, other rows
    missing or altered, rows that were not there before, and targets that never
    existed (an error of the check, so ``ok`` is null).
    """
    want = targets.select(EP, key).distinct()
    rows = _sides(before, after, columns).join(want.withColumn("_target", F.lit(True)), [EP, key], "left")
    target = F.coalesce("_target", F.lit(False))
    was, is_ = F.col("n_before") > 0, F.col("n_after") > 0
    counts = rows.groupBy(EP).agg(
        F.count_if(target & was & is_).alias("n_left"),
        F.count_if(~target & was & ~is_).alias("n_missing"),
        F.count_if(~was & is_).alias("n_extra"),
    )
    unknown = (
        want.join(before.select(EP, key), [EP, key], "left_anti").groupBy(EP).agg(F.count(F.lit(1)).alias("n_unknown"))
    )
    zero = F.lit(0).cast("long")
    out = counts.join(unknown, EP, "full").na.fill(0, ["n_left", "n_missing", "n_extra", "n_unknown"])
    bad = F.col("n_left") + F.col("n_missing") + F.col("n_extra") + zero
    return out.withColumn("ok", F.when(F.col("n_unknown") == 0, bad == 0))


def reference_match(refs: DataFrame, after: DataFrame, exact: list[str], fuzzy: list[str]) -> DataFrame:
    """Reference rows with a match: equal on ``exact`` columns, fuzzy on ``fuzzy`` ones.

    ``refs`` also has ``ref_id``, unique in its episode.
    """
    if not exact and not fuzzy:
        raise ValueError("compare at least one field")
    found = after.select(EP, *exact, *[F.col(c).alias(f"_{c}") for c in fuzzy])
    hits = refs.join(found, [EP, *exact])
    for c in fuzzy:
        hits = hits.filter(fuzzy_match(F.col(c), F.col(f"_{c}")))
    return hits.select(EP, "ref_id").distinct()


def addition_integrity(
    before: DataFrame, after: DataFrame, refs: DataFrame, columns: list[str], exact: list[str], fuzzy: list[str]
) -> DataFrame:
    """Were the reference rows added, and nothing else changed?"""
    missing = refs.join(reference_match(refs, after, exact, fuzzy), [EP, "ref_id"], "left_anti")
    missing = missing.groupBy(EP).agg(F.count(F.lit(1)).alias("n_missing"))
    expected = refs.groupBy(EP).agg(F.count(F.lit(1)).alias("_refs"))
    sides = _sides(before, after, columns).groupBy(EP).agg(
        F.sum("n_before").alias("_before"),
        F.sum("n_after").alias("_after"),
        F.count_if((F.col("n_before") > 0) & (F.col("n_after") == 0)).alias("n_changed"),
    )
    names = ["n_missing", "_refs", "_before", "_after", "n_changed"]
    out = sides.join(expected, EP, "full").join(missing, EP, "left").na.fill(0, names)
    extra = F.col("_after") - F.col("_before") - F.col("_refs")
    return out.select(
        EP,
        ((F.col("n_missing") == 0) & (extra == 0) & (F.col("n_changed") == 0)).alias("ok"),
        "n_missing",
        extra.alias("n_extra"),
        "n_changed",
    )


def duplicates(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Contents stored more than once, with their number and smallest key."""
    return (
        rows.groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("keep"))
        .filter(F.col("copies") > 1)
    )


def without_duplicates(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per content, the one with the smallest key."""
    return rows.groupBy(*columns).agg(F.min(key).alias(key))


def duplicate_removal(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Is one copy of every content left?  Either copy may go; kept keys must be old ones."""
    one = _sides(before, after, columns)
    content = one.groupBy(EP).agg(
        F.count_if((F.col("n_before") > 0) & (F.col("n_after") == 0)).alias("n_missing"),
        F.count_if(F.col("n_after") > 1).alias("n_left"),
    )
    foreign = _sides(before, after, [key, *columns]).groupBy(EP).agg(
        F.count_if((F.col("n_before") == 0) & (F.col("n_after") > 0)).alias("n_extra")
    )
    out = content.join(foreign, EP)
    return out.withColumn("ok", (F.col("n_missing") == 0) & (F.col("n_left") == 0) & (F.col("n_extra") == 0))


def playlist_verify(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """Playlist check: fuzzy name, same size, every file at its position.

    ``rows(episode_id, playlist_name, file, position)``, ``expected(episode_id, name, files ARRAY)``.
    """
    named = rows.join(expected.select(EP, "name"), EP).filter(fuzzy_match(F.col("playlist_name"), F.col("name")))
    size = named.groupBy(EP).agg(F.count(F.lit(1)).alias("n_rows"))
    want = expected.select(EP, F.posexplode("files").alias("position", "file"))
    hit = (
        want.join(named.select(EP, "file", "position").distinct(), [EP, "file", "position"], "left_semi")
        .groupBy(EP).agg(F.count(F.lit(1)).alias("n_hit"))
    )
    out = expected.select(EP, F.size("files").alias("n_files")).join(size, EP, "left").join(hit, EP, "left")
    out = out.na.fill(0, ["n_rows", "n_hit"])
    return out.select(
        EP, "n_rows", "n_hit",
        ((F.col("n_rows") == F.col("n_files")) & (F.col("n_hit") == F.col("n_files"))).alias("ok"),
    )


def newest_deleted(before: DataFrame, after: DataFrame) -> DataFrame:
    """Is exactly the newest file gone?  Both sides hold ``episode_id, file, changed``."""
    newest = before.groupBy(EP).agg(F.max(F.struct("changed", "file")).alias("_n"))
    diff = _sides(before, after, ["file", "changed"]).filter(F.col("n_before") != F.col("n_after"))
    right = (
        (F.col("file") == F.col("_n.file")) & (F.col("changed") == F.col("_n.changed"))
        & (F.col("n_before") - F.col("n_after") == 1)
    )
    counts = diff.join(newest, EP).groupBy(EP).agg(
        F.count(F.lit(1)).alias("n_diff"), F.count_if(right).alias("n_right")
    )
    return newest.select(EP).join(counts, EP, "left").na.fill(0, ["n_diff", "n_right"]).select(
        EP, ((F.col("n_diff") == 1) & (F.col("n_right") == 1)).alias("ok"), "n_diff"
    )


def file_moved(moves: DataFrame, files: DataFrame) -> DataFrame:
    """Absent at the source and present at the target; ``moves(episode_id, file, src, dst)``,
    ``files(episode_id, folder, file)``."""
    here = files.distinct()
    src = here.select(EP, F.col("folder").alias("src"), "file", F.lit(True).alias("_src"))
    dst = here.select(EP, F.col("folder").alias("dst"), "file", F.lit(True).alias("_dst"))
    return moves.join(src, [EP, "src", "file"], "left").join(dst, [EP, "dst", "file"], "left").select(
        EP, "file", (F.col("_src").isNull() & F.col("_dst").isNotNull()).alias("ok")
    )


def initial_state(before: DataFrame, expected: DataFrame) -> DataFrame:
    """Row counts that are not targets + noise; ``expected(episode_id, n_targets, n_noise)``."""
    n = before.groupBy(EP).agg(F.count(F.lit(1)).alias("n_rows"))
    want = expected.select(EP, (F.col("n_targets") + F.col("n_noise")).alias("n_expected"))
    out = want.join(n, EP, "left").na.fill(0, ["n_rows"])
    return out.filter(F.col("n_rows") != F.col("n_expected"))


def candidates_equal(candidates: DataFrame, columns: list[str]) -> DataFrame:
    """Are the duplicate candidates of an episode equal in everything but the key?"""
    content = F.struct(*columns)
    return candidates.groupBy(EP).agg((F.min(content).eqNullSafe(F.max(content))).alias("ok"))


def message_sent(messages: DataFrame, checks: DataFrame, minutes: int = 5) -> DataFrame:
    """Was the message sent to the number within the last minutes?

    ``messages(episode_id, address, body, date_ms)``, ``checks(episode_id, number, body, now_ms)``.
    A message dated after the check passes too, as observed.
    """
    m = messages.select(
        EP, F.regexp_replace("address", "[- ]", "").alias("number"), F.col("body").alias("_body"), "date_ms"
    )
    fresh = F.col("now_ms") - F.col("date_ms") <= minutes * 60 * 1000
    hit = (
        m.join(checks, [EP, "number"])
        .filter(fresh)
        .filter(fuzzy_match(F.col("_body"), F.col("body")))
        .select(EP).distinct().withColumn("_hit", F.lit(True))
    )
    return checks.select(EP).join(hit, EP, "left").select(EP, F.coalesce("_hit", F.lit(False)).alias("ok"))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def contact_exists(contacts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Exact name and digits-only number; both hold ``episode_id, name, number``."""
    have = contacts.select(EP, "name", digits(F.col("number")).alias("_n"), F.lit(True).alias("_hit")).distinct()
    return wanted.withColumn("_n", digits(F.col("number"))).join(have, [EP, "name", "_n"], "left").select(
        EP, "name", F.coalesce("_hit", F.lit(False)).alias("ok")
    )


def number_on_screen(elements: DataFrame, screens: DataFrame) -> DataFrame:
    """Does an element show the number while the dialer is in front?

    ``elements(episode_id, text)``, ``screens(episode_id, activity, number)``.
    """
    # Fixed value: the dialer's package.
    dialer = F.col("activity").startswith("com.google.android.dialer")
    texts = elements.filter(F.coalesce("text", F.lit("")) != "").select(EP, digits(F.col("text")).alias("_n"))
    hit = screens.select(EP, digits(F.col("number")).alias("_n")).join(texts, [EP, "_n"], "left_semi").select(
        EP, F.lit(True).alias("_hit")
    ).distinct()
    return screens.join(hit, EP, "left").select(EP, (dialer & F.coalesce("_hit", F.lit(False))).alias("ok"))


def answer_values(answer: Column) -> Column:
    """Comma-split, trimmed answer list."""
    return F.transform(F.split(answer, ","), lambda a: F.trim(a))


def answer_check(answers: DataFrame, expected: DataFrame) -> DataFrame:
    """Does each given answer equal some expected one, and are there as many?

    ``answers(episode_id, answer, match_type, tolerance)``, ``expected(episode_id, expected ARRAY)``.
    Types: string (fuzzy), number (within tolerance if there is one), date, time
    and datetime.  An answer that does not parse as its type gives null.
    """
    rows = answers.join(expected, EP).withColumn("given", answer_values(F.col("answer")))
    kind = F.col("match_type")

    def typed(x):
        return (
            F.when(kind == "number", x.try_cast("double"))
            .when(kind == "date", F.unix_seconds(F.try_to_timestamp(x, F.lit("MMMM d yyyy"))).cast("double"))
            .when(kind == "time", F.unix_seconds(F.try_to_timestamp(x, F.lit("H:mm"))).cast("double"))
            .when(kind == "datetime", F.unix_seconds(F.try_to_timestamp(x, F.lit("MMMM d yyyy H:mm"))).cast("double"))
        )

    rows = rows.withColumns(
        {
            "_g": F.transform("given", typed),
            "_e": F.transform("expected", typed),
            "_same_size": F.size("given") == F.size("expected"),
        }
    )
    equal = F.forall(
        "_g",
        lambda g: F.exists(
            "_e",
            lambda e: F.when(
                (kind == "number") & F.col("tolerance").isNotNull(), F.abs(g - e) < F.col("tolerance")
            ).otherwise(g == e),
        ),
    )
    bad = (kind != "string") & F.exists("_g", lambda g: g.isNull())
    text = rows.filter((kind == "string") & F.col("_same_size"))
    # Fuzzy pairs of one answer: as many as its few values allow.
    pairs = text.select(EP, F.posexplode("given").alias("i", "_a"), "expected").select(
        EP, "i", "_a", F.explode("expected").alias("_b")
    )
    matched = pairs.withColumn("_m", fuzzy_match(F.col("_a"), F.col("_b"))).groupBy(EP, "i").agg(F.max("_m").alias("_m"))
    strings = matched.groupBy(EP).agg(F.min("_m").alias("_text_ok"))
    return rows.join(strings, EP, "left").select(
        EP,
        F.when(bad, F.lit(None).cast("boolean"))
        .when(~F.col("_same_size"), False)
        .when(kind == "string", F.coalesce("_text_ok", F.lit(False)))
        .otherwise(equal)
        .alias("ok"),
    )


def near(a_lat: str, a_lon: str, b_lat: str, b_lon: str, delta: float) -> Column:
    return (F.abs(F.col(a_lat) - F.col(b_lat)) < delta) & (F.abs(F.col(a_lon) - F.col(b_lon)) < delta)


def track_visits(points: DataFrame, waypoints: DataFrame, delta: float = 0.001) -> DataFrame:
    """Do the waypoints occur in order along the track?

    ``points(episode_id, seq, lat, lon)``, ``waypoints(episode_id, i, lat, lon)`` with ``i`` from 0.  Points
    are read once: those near a waypoint go through one ordered pass, which never
    gathers a track.
    """
    total = waypoints.groupBy(EP).agg(F.count(F.lit(1)).alias("n"))
    want = waypoints.select(EP, "i", F.col("lat").alias("w_lat"), F.col("lon").alias("w_lon"))
    hits = points.join(want, EP).filter(near("lat", "lon", "w_lat", "w_lon", delta)).select(EP, "seq", "i")
    found = ordered_match(hits, EP, "seq", "i")
    matched = F.coalesce("matched", F.lit(0).cast("long"))
    return total.join(found, EP, "left").select(EP, matched.alias("matched"), (matched == F.col("n")).alias("ok"))


def track_visits_row(points: Column, targets: Column, delta: float = 0.001) -> Column:
    """The same test when a short track is an array of (lat, lon) on one row."""
    close = lambda p, t: (F.abs(p["lat"] - t["lat"]) < delta) & (F.abs(p["lon"] - t["lon"]) < delta)
    n = F.aggregate(
        points,
        F.lit(0),
        lambda i, p: F.when(F.coalesce(close(p, F.get(targets, i)), F.lit(False)), i + 1).otherwise(i),
    )
    return n == F.size(targets)


def merged_text_layout(text: Column) -> Column:
    """Merged notes have five lines of which the second and fourth are empty."""
    lines = F.split(text, "\n")
    return (F.size(lines) == 5) & (F.get(lines, F.lit(1)) == "") & (F.get(lines, F.lit(3)) == "")


def same_content(text: Column, wanted: Column, exact: bool = False) -> Column:
    """Equal file contents after dropping carriage returns, exactly or fuzzily."""
    a, b = F.regexp_replace(text, "\r", ""), F.regexp_replace(wanted, "\r", "")
    return (a == b) if exact else fuzzy_match(a, b)
