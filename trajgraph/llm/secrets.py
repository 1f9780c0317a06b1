"""Secret scan with corpus-wide ownership frequency.

Every whole text is matched against a few candidate patterns. The hashes of all candidate values are then counted over the corpus: in
how many repositories and by how many owners each value occurs. A value that several owners hold is a copied example (documentation,
a licence header's sample key); one that stays with one owner, or a few, and looks random is taken for a live credential.

Positions come from the pieces between the matches: ``split`` and ``regexp_extract_all`` walk the text alike, so the running sum of their
lengths gives starts and ends in code points. Counts are combined per (hash, owner, repository), then per owner, then per hash, so a
value that a third of all rows repeat is a few rows a task.

Main path: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunked, fresh, let, only, running, stored, table, text_of

# The base patterns (kind, pattern, group of the value, least length of the value).
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: How access keys and hex runs are searched: only those of full length, which gives the same spans as dropping the short ones.
_SEARCH = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
KINDS = ("assign", "access", "hex", "live", "copied")
#: A value held by more owners than this is a copied example.
MAX_OWNERS = 3
#: Different characters a random-looking value has at least.
MIN_CHARACTERS = 6

SPAN = "array<struct<start:int,kind:int,end:int,v_start:int,v_end:int,value:string>>"


def find_spans(text: Column, kind: int) -> Column:
    """All spans of one base kind in a text, leftmost and not overlapping, those with too short a value dropped."""
    name, pattern, group, least = BASE[kind]
    pattern = _SEARCH.get(name, pattern)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    between = F.split(text, pattern, -1)

    def step(acc, x):
        start = acc["pos"] + F.length(x["between"])
        end = start + F.length(x["hit"])
        span = F.struct(
            start.alias("start"),
            F.lit(kind).alias("kind"),
            end.alias("end"),
            (end - F.length(x["value"])).alias("v_start"),
            end.alias("v_end"),
            x["value"].alias("value"),
        )
        found = x["hit"].isNotNull() & (F.length(x["value"]) >= least)
        return F.struct(
            F.coalesce(end, start).alias("pos"),
            F.when(found, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).cast(SPAN).alias("spans"),
        )

    def spans(pieces):
        """Positions are summed piece by piece, so that a text of many hits takes time in proportion to it."""
        size = lambda x: F.length(x["between"]) + F.coalesce(F.length(x["hit"]), F.lit(0))
        totals = F.transform(pieces, lambda piece: F.aggregate(piece, F.lit(0), lambda a, x: (a + size(x)).cast("int")))
        zero = lambda at: F.struct(at.alias("pos"), F.array().cast(SPAN).alias("spans"))
        return let(running(totals, F.lit(0)), lambda before: F.flatten(F.zip_with(pieces, before, lambda piece, at: F.aggregate(piece, zero(at), step)["spans"])))

    zipped = F.arrays_zip(between.alias("between"), hits.alias("hit"), values.alias("value"))
    found = let(zipped, lambda z: let(chunked(z), spans))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def scan(docs: DataFrame, id_col="doc_id", text_col="text", repo: Column | str = "source", owner: Column | str = "source") -> DataFrame:
    """``row, doc_id, repo, owner, base`` per row, stored: ``base`` holds the spans of all base kinds by start, then kind.

    ``row`` numbers the rows, so that repeated or null ids stay rows of their own.
    """
    rows = only(docs, doc_id=id_col, repo=repo, owner=owner, text=text_of(text_col))
    base = F.sort_array(F.concat(*[find_spans(F.col("text"), k) for k in range(len(BASE))]))
    return stored(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "repo", "owner", base.alias("base")), "secret-scan")


def ownership(scanned: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """``value_hash, n_rows, n_repos, n_owners, live`` of every candidate value of the corpus.

    A null repository or owner counts as one of its own name. ``live``: at most ``max_owners`` owners hold the value, and it has at least
    ``MIN_CHARACTERS`` different characters and both a digit and a letter.
    """
    hits = scanned.select("repo", "owner", F.explode("base").alias("s")).select(
        _hash(F.col("s.value")).alias("value_hash"), "owner", "repo", _random_looking(F.col("s.value")).alias("random")
    )
    by_repo = hits.groupBy("value_hash", "owner", "repo").agg(F.count("*").alias("n"), F.max("random").alias("random"))
    by_owner = by_repo.groupBy("value_hash", "owner").agg(
        F.count("*").alias("repos"), F.sum("n").alias("n"), F.max("random").alias("random")
    )
    counts = by_owner.groupBy("value_hash").agg(
        F.sum("n").alias("n_rows"), F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"), F.max("random").alias("random")
    )
    return counts.select("value_hash", "n_rows", "n_repos", "n_owners", ((F.col("n_owners") <= max_owners) & F.col("random")).alias("live"))


def _hash(value: Column) -> Column:
    return F.sha2(value, 256)


def _random_looking(value: Column) -> Column:
    several = F.size(F.array_distinct(F.split(value, ""))) >= MIN_CHARACTERS
    return several & value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def judged(scanned: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """``row, added``: for rows with candidates, the value spans judged as live or copied, without repeats, by start, then kind."""
    verdicts = ownership(scanned, max_owners).select("value_hash", "live")
    hits = scanned.select("row", F.explode("base").alias("s")).select("row", "s", _hash(F.col("s.value")).alias("value_hash"))
    kind = F.when(F.col("live"), KINDS.index("live")).otherwise(KINDS.index("copied"))
    spans = hits.join(verdicts, "value_hash").select(
        "row", F.struct(F.col("s.v_start").alias("start"), kind.alias("kind"), F.col("s.v_end").alias("end")).alias("span")
    )
    return spans.groupBy("row").agg(F.sort_array(F.collect_set("span")).alias("added"))


def find_secrets(docs: DataFrame, max_owners: int = MAX_OWNERS, **columns) -> DataFrame:
    """``doc_id, base, added`` per row of ``docs``: base spans, and the value spans that ownership calls live or copied.

    Null texts count as empty and have no spans. Rows are judged one by one even if they repeat an id.
    """
    scanned = scan(docs, **columns)
    added = judged(scanned, max_owners)
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return scanned.join(added, "row", "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def redact(docs: DataFrame, mark: str = "[SECRET]", max_owners: int = MAX_OWNERS, text_col: str = "text", **columns) -> DataFrame:
    """``docs`` with the live values in ``text_col`` replaced by ``mark``; copied examples and all other text stay as they are.

    Every row stays. Null texts stay null. Only rows with candidates are shuffled.
    """
    row, added = fresh(docs, "row", "added")
    any_kind = "|".join(f"(?:{_SEARCH.get(name, pattern)})" for name, pattern, _, _ in BASE)
    suspect = F.coalesce(F.col(text_col).rlike(any_kind), F.lit(False))
    held = stored(docs.filter(suspect).withColumn(row, F.monotonically_increasing_id()), "secret-rows")
    scanned = scan(held, id_col=row, text_col=text_col, **columns)
    live = F.filter("added", lambda s: s["kind"] == KINDS.index("live"))
    spans = scanned.join(judged(scanned, max_owners).select("row", live.alias("added")), "row").select(
        F.col("doc_id").alias(row), F.col("added").alias(added)
    )
    marked = held.join(spans, row, "left")
    text = F.col(text_col)
    clean = let(chunked(F.col(added)), lambda pieces: _masked(text, pieces, mark))
    marked = marked.withColumn(text_col, F.when(F.size(added) > 0, clean).otherwise(text))
    return docs.filter(~suspect).unionByName(marked.select(*docs.columns))


def _masked(text: Column, pieces: Column, mark: str) -> Column:
    """``text`` with its spans replaced, in pieces of spans by start, each of which looks only at its own stretch of the text.

    A stretch reaches from the first span of a piece to that of the next one; ``done`` is the furthest end of all spans before.
    """
    first = lambda piece: F.get(piece, F.lit(0))["start"]
    furthest = lambda piece: F.array_max(F.transform(piece, lambda s: s["end"]))
    ends = F.transform(pieces, furthest)

    def stretch(piece, i):
        low = first(piece)
        high = F.coalesce(F.try_element_at(F.transform(pieces, first), i + 2), F.length(text))
        done = F.coalesce(F.array_max(F.slice(ends, F.lit(1), i)), F.lit(0))
        cut = F.substr(text, low + 1, high - low)

        def masked(c):
            own = lambda a, b: F.substr(c, a - low + 1, b - a)
            zero = F.struct(F.greatest(low, done).alias("pos"), F.lit("").alias("out"))

            def step(acc, s):
                new = F.when(s["start"] >= acc["pos"], F.concat(own(acc["pos"], s["start"]), F.lit(mark))).otherwise("")
                return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.concat(acc["out"], new).alias("out"))

            return let(F.aggregate(piece, zero, step), lambda a: F.concat(a["out"], F.when(a["pos"] < high, own(a["pos"], high)).otherwise("")))

        return let(cut, masked)

    head = F.substr(text, F.lit(1), first(F.get(pieces, F.lit(0))))
    return F.concat(head, F.array_join(F.transform(pieces, stretch), ""))


def _lines(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source stands for an owner, and its documents of one language for a repository."""
    docs = table(spark, sf_dir, "documents")
    found = find_secrets(docs, repo=F.concat_ws("/", "source", "lang"), owner=F.col("source"))
    short = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(_lines(F.col("base")), 256).alias("base_sha256"),
        _lines(F.sort_array(F.concat(short, "added"))).alias("spans"),
    )
