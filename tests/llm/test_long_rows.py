"""Time of one very long row grows with its length, not with its square."""

import time

import pytest
from pyspark.sql import functions as F
from trajgraph.llm.chat import format_chat, loss_text, text_part
from trajgraph.llm.html_extract import main_text
from trajgraph.llm.secrets import find_secrets, redact


def seconds(run, *sizes):
    """Best of two runs at each size, after a warm-up."""
    run(sizes[0] // 4)
    out = []
    for n in sizes:
        times = []
        for _ in range(2):
            start = time.time()
            run(n)
            times.append(time.time() - start)
        out.append(min(times))
    return out


@pytest.mark.parametrize(
    "page",
    [
        lambda n: "<div>" + "<span>" * n + "x" + "</b>" * n,
        lambda n: "<form>" * n + "some text, and more" + "</form>" * n,
        lambda n: "<ul>" * n + "<li><a href=x>one</a></li>" * 3 + "</ul>" * n,
        lambda n: "<div class=menu>" * n + "words" + "<header>" * n,
    ],
)
def test_broken_pages(page):
    short, long = seconds(lambda n: main_text(page(n)), 6_000, 24_000)
    assert long < 8 * max(short, 0.05)


def test_many_hits(spark):
    def run(n):
        df = spark.createDataFrame([(1, "0123456789abcdef01234567 " * n, "s")], "doc_id long, text string, source string")
        assert find_secrets(df).select(F.size("base")).first()[0] == n
        assert redact(df).select(F.length("text")).first()[0] == n * 9

    short, long = seconds(run, 10_000, 40_000)
    assert long < 8 * max(short, 1.0)


def test_long_conversation(spark):
    def run(n):
        rows = spark.range(n).select(
            F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
            text_part(F.lit("some words of a turn")).alias("parts"),
        )
        out = format_chat(rows)
        assert out.select(F.length(loss_text(F.col("formatted"), F.col("loss_spans")))).first()[0] == n // 2 * 20

    short, long = seconds(run, 2_500, 10_000)
    assert long < 8 * max(short, 1.0)
