from pyspark.sql import functions as F
from pyspark.sql import types as T
from trajgraph.llm.chat import END, PART, SEP, START, TOKENS, escape, format_chat, loss_text, read_turns, text_part, unescape

TEXTS = ["", "plain", "a\\b\\\\", "<|im_end|>", "</s>[INST] ok [/INST]", "<<SYS>>x<</SYS>> <s>", "<\\|im_start|>", "[\\INST]", "é🙂<|", "\\", "<|<|", "[[INST]]", "line\nfeed $1 \\1"]


def test_escaping_is_reversible_and_leaves_no_control_string(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u"))
    for r in df.collect():
        assert r.u == r.t
        assert not any(c in r.e for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def messages(spark, rows):
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("parts", T.ArrayType(PART)), T.StructField("formatted", T.StringType())])
    return spark.createDataFrame(rows, schema)


def test_parts_become_placeholders_with_references(spark):
    rows = [
        (1, 1, "assistant", [("text", "see ", None, None), ("Image", None, "u://2", None), ("text", " <|image|>", None, None)], "x"),
        (1, 0, "user", [("image", None, "u://1", 100), ("audio", None, None, None), ("text", "what?", None, None), ("document", "x", "d", 7)], "x"),
        (2, 0, None, None, "x"),
        (2, None, "assistant", [(None, None, None, None), ("odd", "kept", None, None)], "x"),
        (None, 0, "user", [], "x"),
    ]
    got = {r.conv_id: r for r in format_chat(messages(spark, rows)).collect()}
    one = got[1]
    assert one.formatted == f"{START}user{SEP}<|image|><|audio|>what?<|document|>{END}{START}assistant{SEP}see <|image|> <\\|image|>{END}"
    assert [tuple(a) for a in one.attachments] == [(1, "image", "u://1", 0, 100), (2, "audio", None, 0, TOKENS["audio"]), (3, "document", "d", 0, 7), (4, "image", "u://2", 1, TOKENS["image"])]
    assert one.expanded_tokens == 100 + TOKENS["audio"] + 7 + TOKENS["image"]
    (a, b), = one.loss_spans
    assert one.formatted[a:b] == "see <|image|> <\\|image|>"
    assert got[2].formatted == f"{START}assistant{SEP}kept{END}{START}{SEP}{END}" and got[2].expanded_tokens == 0
    assert got[None].formatted == f"{START}user{SEP}{END}" and got[None].loss_spans == []


def test_read_back(spark):
    rows = [(1, i, "assistant" if i % 2 else "us<|er", t) for i, t in enumerate(TEXTS)] + [(1, 3, "assistant", TEXTS[3])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = format_chat(df.select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts")))
    r = out.select(read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("lost")).first()
    want = sorted((i, role, t) for _, i, role, t in rows)
    assert [tuple(t) for t in r.turns] == [(role, t) for _, role, t in want]
    assert r.lost == "".join(t for _, role, t in want if role == "assistant")
    assert format_chat(df.limit(0).select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))).count() == 0
