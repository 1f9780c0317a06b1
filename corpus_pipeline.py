"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

1. ``language_id``: documents whose language is rejected (no letters, or unlike every language learned) go.
2. ``exact_dedup``: of equal texts the row with the largest ``doc_id`` stays.
3. ``near_dedup``: of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the row with the smallest ``doc_id`` stays.
4. ``secret_scan``: live credentials are replaced by a mark; every document stays, and copied examples are left as they are.
5. ``packing``: the documents left become sequences of at most 2048 tokens, one row for each piece of a document.

The first four return the columns of ``documents``; a redacted text gets a new ``n_chars`` where that column exists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajgraph.llm.common import stored, table
from trajgraph.llm.exact_dedup import keep_one
from trajgraph.llm.langid import keep_known
from trajgraph.llm.packing import pack, word_vocabulary
from trajgraph.llm.secrets import redact
from trajgraph.llm.similar import keep_first


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Models are fitted on the labelled texts of ``docs`` itself."""
    return keep_known(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A source stands for an owner, and its documents of one language for a repository."""
    clean = redact(docs, repo=F.concat_ws("/", "source", "lang"), owner=F.col("source"))
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, word_vocabulary())


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: SQL states neither the language models nor the fingerprints nor the packing; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
