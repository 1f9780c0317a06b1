"""Text, date and UI rules."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F
from trajgraph.functions import dates as D
from trajgraph.functions import parsing as P
from trajgraph.functions import ui as UI
from trajgraph.functions.udfs import embed, extract_json, parse_call, phash, phash_image
from trajgraph.operators import screens as S
from trajgraph.operators import synthetic as Y


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "text,seconds",
    [("10:00", 36000), ("15:30", 55800), ("10:00am", 36000), ("10:00pm", 79200), ("10pm", 79200), ("12am", 0),
     ("12:15PM", 44100), ("25:00", None), ("13pm", None), ("noon", None), ("10", None), (None, None)],
)
def test_times(spark, text, seconds):
    assert one(spark, D.parse_time, text) == seconds


@pytest.mark.parametrize("text,seconds", [("2h", 7200), ("1.5 hours", 5400), ("30m", 1800), ("30 minutes", 1800), ("x", None)])
def test_durations(spark, text, seconds):
    assert one(spark, D.parse_duration, text) == seconds


def test_dates_and_epochs(spark):
    assert one(spark, D.parse_date, "October 15 2023") == dt.date(2023, 10, 15)
    assert one(spark, D.parse_date, "2023-10-15") is None
    assert one(spark, lambda x: D.to_epoch(F.lit("October 15 2023"), x), "3:34pm") == 1697384040
    assert one(spark, lambda x: D.to_epoch(x, F.lit(None).cast("string"))) == 1697328000
    assert one(spark, lambda x: D.to_epoch(F.lit("October 15 2023"), x, "Europe/Berlin"), "2am") == 1697328000


@pytest.mark.parametrize(
    "day,words",
    [("2023-10-15", ["October 15", "October 15 2023", "today"]),
     ("2023-10-16", ["October 16", "October 16 2023", "tomorrow", "Monday", "this Monday"]),
     ("2023-10-14", ["October 14", "October 14 2023", "yesterday", "Saturday"]),
     ("2023-10-25", ["October 25", "October 25 2023", "the Wednesday after next"]),
     ("2023-11-25", ["November 25", "November 25 2023"])],
)
def test_date_wording(spark, day, words):
    assert sorted(one(spark, lambda x: D.date_options(F.to_date(x)), day)) == sorted(words)


def test_weekday_rule(spark):
    assert one(spark, lambda x: D.weekly_bitmask(x), 7, "int") == 64
    with pytest.raises(Exception, match="weekday"):
        one(spark, lambda x: D.weekly_bitmask(x), 8, "int")


def test_calls_and_json(spark):
    df = spark.createDataFrame(
        [('JSONAction(action_type="input_text", index=9, text="a, b", bad=name)',), ("broken(",), ("42",), (None,)], "x string"
    )
    got = [r[0] for r in df.select(parse_call("x")).collect()]
    assert got == [{"action_type": "input_text", "index": "9", "text": "a, b", "bad": None}, {}, {}, {}]
    df = spark.createDataFrame([('so {"a": {"b": 1}} end',), ("x {'k': True}",), ("none",), ("{bad",)], "x string")
    assert [r[0] for r in df.select(extract_json("x")).collect()] == ['{"a": {"b": 1}}', '{"k": true}', None, None]


def test_reply_parts(spark):
    text = "Reasoning: because\nof it \nAction: tap\nmore"
    assert tuple(one(spark, P.reason_action, text)) == ("because\nof it", "tap\nmore")
    assert tuple(one(spark, P.reason_action, "Action: x")) == (None, "x")
    assert one(spark, P.completion_flag, "result: TRUE") is True
    assert one(spark, P.completion_flag, "nothing") is None
    assert tuple(one(spark, P.state_evaluation, "Result: later")) == ("", "CONTINUE")
    assert tuple(one(spark, P.element_action_value, "ELEMENT: None\nACTION: CLICK\nVALUE: a.")) == (None, "CLICK", "a")
    assert one(spark, P.numbered_tasks, "1. a \n2... b") == ["a", "b"]
    assert one(spark, P.decision, "so DECISION: false, DECISION: true") is False
    assert tuple(one(spark, P.comparison_json, 'x {"a": 1} {"is_same_page": true, "matched_candidate_index": 2}')) == (True, 2)
    assert tuple(one(spark, P.comparison_json, "none")) == (False, None)


@pytest.mark.parametrize(
    "text,want", [("47.1, 9.5", (47.1, 9.5)), ("-.5 and 3", (-0.5, 3.0)), ("one 1", None), ("1 2 3", None)]
)
def test_coords(spark, text, want):
    got = one(spark, P.coords, text)
    assert (tuple(got) if got else None) == want


def test_steps_of(spark):
    steps = lambda v: one(spark, lambda x: P.steps_of(x, F.lit("T")), v)
    assert steps('{"T": [2, 0, 2]}') == [0, 2]
    assert (steps('["T"]'), steps('["U"]'), steps("x"), steps(None), steps('{"U": [1]}')) == ([0], [], [], [], [])


def test_dump_rows(spark):
    assert one(spark, P.split_rows, "Row: 0 a=1\nRow: 1 a=2") == ["Row: 0 a=1", "Row: 1 a=2"]
    assert one(spark, P.split_rows, "No result found.\r\n") == []
    listing = "-rw-rw---- 1 u0_a1 media_rw 12 2023-10-15 15:34:00.123456789 +0000 my file.md"
    name, size, changed = one(spark, P.file_listing, listing)
    assert (name, size, changed) == ("my file.md", 12, dt.datetime(2023, 10, 15, 15, 34, 0, 123456))
    assert one(spark, P.file_listing, "drwx " + listing[5:]) is None
    (c,) = one(spark, P.contact_rows, "Row: 0 display_name=A, B, number=+1 (2)3")
    assert tuple(c) == ("A, B", "123")


def test_xml_dump_both_ways(spark):
    xml = (
        '<?xml version="1.0"?><hierarchy><node text="a > b" class="c.Button" clickable="true" bounds="[0,10][20,30]">'
        "<node text='Tom &amp; \"Co\" &#38;lt; &#x1F642;' class='c.Text' clickable='true'/>"
        '<node text="" content-desc="d" class="c.View" bounds="[1,2][3,4]"/></node></hierarchy>'
    )
    df = spark.createDataFrame([(1, xml.split("?>")[1])], "screen_id int, xml string")
    got = S.xml_elements(df, "xml", "screen_id").orderBy("idx").collect()
    assert [(r.text, r.content_description, r.is_clickable, r.is_leaf) for r in got] == [
        ("a > b", None, True, False), ('Tom & "Co" &lt; 🙂', None, True, True), (None, "d", False, True)
    ]
    assert tuple(got[0].bbox_pixels) == (0, 20, 10, 30)
    S.register_udtf(spark)
    df.createOrReplaceTempView("dump")
    out = spark.sql("SELECT u.idx, u.class_name, u.text FROM dump, LATERAL ui_elements(xml) u ORDER BY 1").collect()
    assert [tuple(r) for r in out] == [(0, "c.Button", "a > b"), (1, "c.Text", 'Tom & "Co" &lt; 🙂'), (2, "c.View", "")]


@pytest.mark.parametrize("turn,want", [(0, (54, 120)), (1, (1026, 120)), (2, (1026, 2280)), (3, (54, 2280))])
def test_orientations(spark, turn, want):
    # A point 5 % along both logical axes, on a 1080 x 2400 portrait frame.
    got = one(
        spark,
        lambda t: UI.to_physical(F.lit(50), F.lit(100), (F.lit(1000), F.lit(2000)), (0, 0, 1080, 2400), t),
        turn, "int",
    )
    assert tuple(got) == want


def test_image_hash_and_embedding(spark):
    rng = np.random.default_rng(1)
    flat = rng.integers(0, 256, 1024, dtype=np.uint8)
    near = flat.copy()
    near[5] ^= 1
    other = rng.integers(0, 256, 1024, dtype=np.uint8)
    df = spark.createDataFrame([(bytearray(x.tobytes()),) for x in (flat, near, other)] + [(None,), (bytearray(1000),), (bytearray(),)], "p binary")
    a, b, c, d, odd, none = [r[0] for r in df.select(phash("p")).collect()]
    bits = lambda x, y: bin(int(x, 16) ^ int(y, 16)).count("1")
    assert bits(a, b) < 8 and bits(a, c) > 64 and d is None and odd is None and none is None and len(a) == 64
    wide = df.limit(1).select(*[phash_image("p", F.lit(w), F.lit(h)) for w, h in ((32, 32), (64, 16), (16, 64), (30, 30), (-32, -32))]).first()
    assert wide[0] == a and len({a, wide[1], wide[2]}) == 3 and wide[3] is None and wide[4] is None
    turned = bytearray(flat.reshape(64, 16).T.copy().tobytes())
    other_way = spark.createDataFrame([(turned,)], "p binary").select(phash_image("p", F.lit(64), F.lit(16))).first()[0]
    as_bits = lambda h: np.unpackbits(np.frombuffer(bytes.fromhex(h), np.uint8)).reshape(16, 16)
    assert (as_bits(other_way) == as_bits(wide[2]).T).all()
    v, w = [r[0] for r in spark.createDataFrame([("b a",), ("a B",)], "x string").select(embed("x")).collect()]
    assert v == w and abs(sum(x * x for x in v) - 1) < 1e-6


def test_generated_rows(spark):
    base = spark.range(500).withColumn("c", Y.pick(["r", "g", "b"], F.col("id"), "c", 1))
    base = base.withColumn("n", Y.pick_between(1, 4, F.col("id"), "n", 1))
    distinct = Y.random_rows(base, "id", ["c", "n"], 12).collect()
    assert len({(r.c, r.n) for r in distinct}) == 12
    assert Y.random_rows(base, "id", ["c", "n"], 200, replacement=True).count() == 200
    assert {r.c for r in Y.random_rows(base, "id", ["c", "n"], 4, keep=F.col("c") == "r").collect()} == {"r"}
    with pytest.raises(Exception, match="exhausted"):
        Y.random_rows(base, "id", ["c", "n"], 13).collect()
    again = spark.range(500).repartition(7).withColumn("c", Y.pick(["r", "g", "b"], F.col("id"), "c", 1))
    assert {(r.id, r.c) for r in again.collect()} == {(r.id, r.c) for r in base.collect()}
