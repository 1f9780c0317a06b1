"""Before/after cases, playlists, messages, answers and tracks."""

import pytest
from pyspark.sql import functions as F
from trajgraph.functions import parsing as P
from trajgraph.operators import filters as X
from trajgraph.operators import rollups as R
from trajgraph.operators import validators as V

ROW = "episode_id string, id long, title string, place string"
DINNER, LUNCH, TEA = (1, "Dinner", "Soho"), (2, "Lunch", None), (3, "Tea", "Home")


def frame(spark, cases):
    return spark.createDataFrame([(e, *r) for e, rows in cases.items() for r in rows], ROW)


def verdict(df):
    return {r.episode_id: r.ok for r in df.collect()}


def test_removal_cases(spark):
    all3 = [DINNER, LUNCH, TEA]
    names = ["one", "none", "wrong", "many", "side", "extra", "unknown"]
    before = frame(spark, {e: all3 for e in names})
    after = frame(
        spark,
        {
            "one": [LUNCH, TEA], "none": all3, "wrong": [DINNER, TEA], "many": [TEA],
            "side": [LUNCH, (3, "Tea", "Else")], "extra": [LUNCH, TEA, (4, "New", None)], "unknown": all3,
        },
    )
    ids = {"one": [1], "none": [1], "wrong": [1], "many": [1, 2], "side": [1], "extra": [1], "unknown": [77]}
    targets = spark.createDataFrame([(e, i) for e, xs in ids.items() for i in xs], "episode_id string, id long")
    got = verdict(V.removal_integrity(before, after, targets, "id", ["id", "title", "place"]))
    assert got == {"one": True, "none": False, "wrong": False, "many": True, "side": False, "extra": False, "unknown": None}


def test_addition_cases(spark):
    before = frame(spark, {e: [DINNER] for e in ("one", "fuzzy", "none", "wrong", "dup", "extra", "lost")})
    new = (2, "Grand opening party", "Hall")
    after = frame(
        spark,
        {
            "one": [DINNER, new], "fuzzy": [DINNER, (2, "Grand opening PARTY!", "Hall")], "none": [DINNER],
            "wrong": [DINNER, (2, "Other", "Hall")], "dup": [DINNER, new, (3, *new[1:])],
            "extra": [DINNER, new, TEA], "lost": [new],
        },
    )
    refs = before.select("episode_id").distinct().select(
        "episode_id", F.lit(1).alias("ref_id"), F.lit("grand opening party").alias("title"), F.lit("Hall").alias("place")
    )
    got = verdict(V.addition_integrity(before, after, refs, ["id", "title", "place"], ["place"], ["title"]))
    assert got == {"one": True, "fuzzy": True, "none": False, "wrong": False, "dup": False, "extra": False, "lost": False}


def test_either_copy_of_a_duplicate_may_go(spark):
    two = [(1, "Soup", "x"), (2, "Soup", "x"), TEA]
    before = frame(spark, {e: two for e in "abcd"})
    after = frame(spark, {"a": [two[0], TEA], "b": [two[1], TEA], "c": two, "d": [TEA]})
    got = verdict(V.duplicate_removal(before, after, "id", ["title", "place"]))
    assert got == {"a": True, "b": True, "c": False, "d": False}


def test_playlist_cases(spark):
    rows = spark.createDataFrame(
        [(e, n, f, p) for e, n, fs in [("ok", "Test Playlist", "ab"), ("order", "Test Playlist", "ba"), ("name", "Completely else", "ab")]
         for p, f in enumerate(fs)],
        "episode_id string, playlist_name string, file string, position int",
    )
    expected = spark.createDataFrame(
        [(e, "test playlist", ["a", "b"]) for e in ("ok", "order", "name", "empty")] + [("nofiles", "x", [])],
        "episode_id string, name string, files array<string>",
    )
    assert verdict(V.playlist_verify(rows, expected)) == {
        "ok": True, "order": False, "name": False, "empty": False, "nofiles": True,
    }


def test_message_rows_and_recency(spark):
    raw = spark.createDataFrame(
        [("now", "Row: 0 _id=1, address=11-11, body=Hi, friend, date=1000000"), ("old", "Row: 0 _id=2, address=1111, body=Hi, friend, date=1"),
         ("future", "Row: 0 _id=2, address=1111, date=9000000, body=Hi, friend"), ("text", "Row: 1 _id=3, address=1111, body=Nope, date=1000000")],
        "episode_id string, raw string",
    )
    m = raw.select("episode_id", P.sms_fields(F.col("raw")).alias("m")).select("episode_id", "m.*")
    assert {r.body for r in m.collect()} == {"Hi, friend", "Nope"}
    checks = raw.select("episode_id", F.lit("1111").alias("number"), F.lit("hi, FRIEND").alias("body"), F.lit(1300000).cast("long").alias("now_ms"))
    assert verdict(V.message_sent(m, checks)) == {"now": True, "old": False, "future": True, "text": False}


def test_answers(spark):
    cases = [
        ("s", "library, Park", "string", None, ["park", "library"], True),
        ("short", "library", "string", None, ["park", "library"], False),
        ("n", "10.4", "number", 0.5, ["10"], True),
        ("edge", "10.5", "number", 0.5, ["10"], False),
        ("exact", "10", "number", None, ["10.0"], True),
        ("d", "October 15 2023, October 16 2023", "date", None, ["October 16 2023", "October 15 2023"], True),
        ("t", "15:30", "time", None, ["12:30"], False),
        ("bad", "ten", "number", None, ["10"], None),
    ]
    a = spark.createDataFrame([c[:4] for c in cases], "episode_id string, answer string, match_type string, tolerance double")
    e = spark.createDataFrame([(c[0], c[4]) for c in cases], "episode_id string, expected array<string>")
    assert verdict(V.answer_check(a, e)) == {c[0]: c[5] for c in cases}


def test_track_cases(spark):
    pts = [(0, 1), (2, 3), (4, 5), (6, 7), (8, 9)]
    want = {"between": [(2, 3), (8, 9)], "backwards": [(2, 3), (0, 1)], "same": pts, "missing": [(2, 3), (4, 4)]}
    points = spark.createDataFrame([(e, i, float(a), float(b)) for e in want for i, (a, b) in enumerate(pts)],
                                   "episode_id string, seq long, lat double, lon double")
    way = spark.createDataFrame([(e, i, float(a), float(b)) for e, ws in want.items() for i, (a, b) in enumerate(ws)],
                                "episode_id string, i int, lat double, lon double")
    truth = {"between": True, "backwards": False, "same": True, "missing": False}
    assert verdict(V.track_visits(points, way)) == truth
    pair = F.struct("lat", "lon").alias("p")
    rowp = points.groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("seq", pair)))["p"].alias("pts"))
    roww = way.groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("i", pair)))["p"].alias("w"))
    one = rowp.join(roww, "episode_id").select("episode_id", V.track_visits_row(F.col("pts"), F.col("w")).alias("ok"))
    assert verdict(one) == truth


def test_many_waypoints_in_one_pass(spark):
    import random

    rng = random.Random(3)
    tracks = {e: [rng.randrange(25) for _ in range(400)] for e in range(4)} | {9: list(range(20))}
    points = spark.createDataFrame([(e, i, float(p), 0.0) for e, t in tracks.items() for i, p in enumerate(t)], "episode_id long, seq long, lat double, lon double")
    way = spark.createDataFrame([(e, i, float(i), 0.0) for e in tracks for i in range(20)], "episode_id long, i int, lat double, lon double")
    out = V.track_visits(points, way)
    want = {}
    for e, t in tracks.items():
        n = 0
        for p in t:
            n += n < 20 and p == n
        want[e] = (n, n == 20)
    assert {r.episode_id: (r.matched, r.ok) for r in out.collect()} == want
    assert out._jdf.queryExecution().executedPlan().toString().count("Join") < 12


def test_unknown_conditions_count_as_met(spark, as_rows):
    df = spark.createDataFrame([("a", 1), ("b", 5)], "title string, n int")
    keep = lambda c: [r[0] for r in as_rows(X.exclusion_filter(df, c, text=("title",)), "title")]
    assert keep([]) == ["a", "b"]
    assert keep([("nothing", "=", 1)]) == []
    assert keep([("title", "=", "A"), ("nothing", "=", 1)]) == ["b"]
    assert keep([("n", ">=", 1), ("title", "contains", "B")]) == ["a"]
    with pytest.raises(ValueError):
        X.exclusion_filter(df, [("n", "~", 1)])


def test_letters(spark):
    got = [r[0] for r in spark.range(0, 60).select(X.letter_index(F.col("id"))).collect()]
    assert got[0] == "A" and got[25] == "Z" and got[26] == "AA" and got[27] == "AB" and got[52] == "BA"


def test_nested_fields(spark):
    df = spark.createDataFrame(
        [("e", {"app_name": "c", "events": [{"title": "x", "tags": ["t1", "t2"]}, {"title": None, "tags": []}]})],
        "k string, state struct<app_name:string,events:array<struct<title:string,tags:array<string>>>>",
    )
    values = lambda n: sorted(r.value for r in R.field_values(df, "k", "state", n).collect())
    assert (values("title"), values("tags"), values("app_name")) == (["x"], ["t1", "t2"], ["c"])
    with pytest.raises(ValueError):
        values("absent")


def test_resume_rule(spark):
    e = spark.createDataFrame([("a", None), ("b", "x"), ("c", None), ("c", "x")], "instance_name string, exception_info string")
    done = {r.instance_name: r.done for r in R.resume_sets(e).collect()}
    assert done == {"a": True, "b": False, "c": False}
    left = R.resume_remaining(spark.createDataFrame([("a",), ("c",), ("d",)], "instance_name string"), e)
    assert sorted(r.instance_name for r in left.collect()) == ["c", "d"]


def test_step_budget_needs_a_complexity(spark):
    df = spark.createDataFrame([(1.25,), (None,)], "c double")
    assert df.limit(1).select(R.step_budget(F.col("c"))).first()[0] == 12
    with pytest.raises(Exception, match="complexity"):
        df.select(R.step_budget(F.col("c"))).collect()
