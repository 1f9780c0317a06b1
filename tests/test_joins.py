import random

import pytest
from trajgraph.functions.udfs import fuzzy_equal
from trajgraph.operators import joins as J


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = "red blue small large ring bolt plate gear cold old brand".split()
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 8))) for _ in range(60)]

    def bend(t):
        t = list(t)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(t) + 1)
            if rng.random() < 0.5 and t:
                del t[min(i, len(t) - 1)]
            else:
                t.insert(i, rng.choice("abcXYZ "))
        return "".join(t)

    return [(i, t) for i, t in enumerate(base)], [(i, bend(rng.choice(base))) for i in range(60)] + [(100, ""), (101, "É")]


@pytest.mark.parametrize("cap", [10**9, 5])
def test_fuzzy_join_equals_all_pairs(spark, texts, cap):
    left, right = texts
    left = left + [(100, ""), (101, "é"), (102, "a" * 30), (103, "ab" * 20), (104, "ababababab"), (105, "x" * 9), (106, "Red bolt"), (107, "red bolt")]
    right = right + [(102, "A" * 33), (103, "ab" * 21 + "c"), (104, "abababababa"), (105, "x" * 10), (106, "redd bolt"), (107, "RED BOLT")]
    a = spark.createDataFrame(left, "left_id long, left_text string").repartition(4)
    b = spark.createDataFrame(right, "right_id long, right_text string")
    got = sorted(tuple(r) for r in J.fuzzy_join(a, b, max_broadcast_bytes=cap, block_rows=7).collect())
    want = sorted((i, j) for i, s in left for j, t in right if fuzzy_equal(s, t))
    assert got == want and len(want) > 20


def test_grid_join_finds_neighbours_across_cells(spark):
    pts = spark.createDataFrame([(1, 0.0009, 5.0), (2, 0.0011, 5.0), (3, -0.0001, 5.0)], "point_id long, lat double, lon double")
    place = spark.createDataFrame([(9, 0.00015, 5.0005)], "place_id long, p_lat double, p_lon double")
    assert sorted(r.point_id for r in J.nearest_coords(pts, place, 0.001).collect()) == [1, 2, 3]


def test_unknown_app_is_an_error(spark):
    rows = spark.createDataFrame([("p", "t")], "package string, task string")
    none = spark.createDataFrame([], "package string, app string")
    tasks = spark.createDataFrame([("other", "a b")], "task string, task_app string")
    with pytest.raises(Exception, match="no app for task"):
        J.resolve_app(rows, none, tasks).collect()


def test_intervals_of_any_length(spark):
    rng = random.Random(8)
    events = [(i, s, s + rng.choice([-5, 0, 1, 50, 3600, 86_400, 10**6, 10**9])) for i, s in enumerate(rng.randrange(-(10**9), 10**9) for _ in range(80))]
    points = [(i, rng.choice([e[1], e[2], e[1] + (e[2] - e[1]) // 2, rng.randrange(10**9)])) for i, e in enumerate(events)]
    e = spark.createDataFrame(events, "event_id long, start_s long, end_s long")
    p = spark.createDataFrame(points, "point_id long, at_s long")
    got = sorted((r.event_id, r.point_id) for r in J.interval_overlap(e, p, 3600).collect())
    want = sorted((i, k) for i, a, b in events for k, t in points if a <= t <= b)
    assert got == want and len(want) > 40
    assert J.interval_overlap(e.limit(0), p).count() == 0


def test_texts_of_few_trigrams_meet_the_others(spark):
    """Pairs of one text with many different trigrams and one with few, of two with few, and short ones, on the large route."""
    rng = random.Random(4)
    left = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(1, 40)))) for i in range(80)]
    right = [(i, t[:j] + rng.choice("abc") + t[j + rng.randint(0, 1) :]) for i, (_, t) in enumerate(left) for j in [rng.randrange(len(t))]]
    a = spark.createDataFrame(left, "left_id long, left_text string")
    b = spark.createDataFrame(right, "right_id long, right_text string")
    got = sorted(tuple(r) for r in J.fuzzy_join(a, b, max_broadcast_bytes=0, block_rows=9).collect())
    want = sorted((i, j) for i, s in left for j, t in right if fuzzy_equal(s, t))
    assert got == want and len(want) > 60


def test_suggested_names(spark):
    from trajgraph.functions import fuzzy as Z
    from trajgraph.operators import filters as X

    # Known answers of the weighted ratio, worked out by hand from its parts.
    assert Z.weighted_ratio("Add Contact!", "add contact") == 100
    assert Z.weighted_ratio("contact add", "add contact") == 95
    assert Z.weighted_ratio("add", "add a contact now") == 90
    assert Z.weighted_ratio("", "add") == 0 and Z.weighted_ratio("??", "add") == 0
    rng = random.Random(2)
    words = "add new contact delete note simple calendar event play music browser draw clock timer files move recipe expense".split()
    known = sorted({"".join(w.capitalize() for w in rng.sample(words, 3)) for _ in range(60)} | {" ".join(rng.sample(words, 3)) for _ in range(40)})
    bend = lambda t: "".join(c for c in t if rng.random() > 0.08) + rng.choice(["", "x", " now"])
    wanted = sorted({bend(rng.choice(known)) for _ in range(60)} | {"zz9", "", "add", "Delete"})
    df = lambda names: spark.createDataFrame([(n,) for n in names], "name string")
    want = {}
    for n in wanted:
        if n not in known:
            score, name = max(((Z.weighted_ratio(n, k), k) for k in known), key=lambda s: (s[0], [-ord(c) for c in s[1]]))
            top = [k for k in known if Z.weighted_ratio(n, k) == score]
            want[n] = min(top) if score >= 80 else None
    for most in (10**9, 20_000):
        got = {r.name: r.suggestion for r in X.unknown_names(df(wanted), df(known), name_bytes=most).collect()}
        assert got == want and sum(v is not None for v in want.values()) > 40
