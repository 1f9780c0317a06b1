"""Language identification by interpolated Kneser-Ney character models, one for each language.

Counting: every training text is cut into words, and every word into character n-grams; a character beyond a word's border is the border
symbol. Counts of the highest order are summed over the corpus. Lower orders use continuation counts (how many different symbols
precede an n-gram; real counts where it starts at a border), and each order is interpolated with the next lower one, all as joins and
aggregations. For scoring, each order is one sorted array of packed n-grams, four whole 16-bit symbols each, with a column of
log-probabilities for each language, so no two n-grams share a value. What is broadcast grows with the different n-grams seen,
``16 + 16 * languages`` bytes for each; it is counted first, and more than ``MODEL_BYTES`` is an error instead of a cut.

A text's score is its cross-entropy in nats per character event under each model; the lowest wins. A tenth of the training documents is
left out of the counts and calibrates the answer: by the log-likelihood margin over the second best, the share of right answers gives
the score; answers of low score are rejected, and so are texts whose cross-entropy is far above that of nearly all rightly answered
calibration texts.

Words repeat, so a task scores each different word once.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, only, stored, table
from .words import REMEMBER, WordTable, chunks

by_value(__name__)

ORDER = 4
SYMBOL_BITS = 16
#: Letters beyond the first plane take the symbols of its private area, which hold no letters.
PLANE, PRIVATE, PRIVATE_SIZE = 0x10000, 0xE000, 6400
#: Most bytes of a model.
MODEL_BYTES = 600_000_000
UNKNOWN = "und"
#: Words whose n-grams are held at once: some 100 bytes for each of their characters.
SLICE = 30_000
#: Calibration: bins of the margin, 4 for each factor e; answers below this share of right ones are rejected.
BINS = 64
LEAST_SCORE = 0.5
#: A text is rejected when its cross-entropy exceeds this share of rightly answered calibration texts of so many events by this factor;
#: the share is read from a histogram of so many bins per nat.
LEAST_EVENTS = 20
USUAL = 0.99
SLACK = 2.0
PER_NAT, ENTROPIES = 20, 400

NGRAMS = "lang string, g long, n long"
SCORES = "doc_id long, lang string, score double, rejected boolean"


@cache
def _letters() -> np.ndarray:
    """Which characters of the first plane are letters."""
    return np.array([chr(c).isalpha() for c in range(PLANE)])


def symbols(text: str) -> np.ndarray:
    """A symbol for each character of a lower-cased text: its code, 0 where it is no letter."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    out = np.where(_letters()[np.minimum(codes, PLANE - 1)], codes, 0)
    high = codes >= PLANE
    if high.any():
        kinds, back = np.unique(codes[high], return_inverse=True)
        out[high] = np.array([PRIVATE + c % PRIVATE_SIZE if chr(c).isalpha() else 0 for c in kinds.tolist()])[back]
    return out


def events(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams (packed, highest order) of all words and the place of the word each belongs to."""
    joined = "\n".join([w.decode().lower() for w in words]) + "\n"
    code = symbols(joined)
    word = np.cumsum(np.frombuffer(joined.encode("utf-32-le"), "<u4") == 10)
    g = code.copy()
    before = code
    for n in range(1, ORDER):
        shifted = np.zeros_like(code)
        shifted[n:] = code[:-n]
        before = np.where(before != 0, shifted, 0) if n > 1 else shifted
        g |= before << (SYMBOL_BITS * n)
    previous = np.zeros_like(code)
    previous[1:] = code[:-1]
    real = (code != 0) | (previous != 0)
    place = word - (np.frombuffer(joined.encode("utf-32-le"), "<u4") == 10)
    return g[real], place[real]


def lower_bits(g, n: int):
    """The last ``n`` symbols of packed n-grams, alike for columns and arrays; all of them fill the 64 bits."""
    if n >= ORDER:
        return g
    mask = (1 << SYMBOL_BITS * n) - 1
    return g.bitwiseAND(mask) if isinstance(g, Column) else g & mask


def count_ngrams(docs: DataFrame) -> DataFrame:
    """``lang, g, n`` over all of ``docs(lang, text)``: partial counts a task, summed by Spark."""

    def run(batches):
        import pyarrow as pa
        from collections import Counter

        words: dict[str, Counter] = {}
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def fold():
            for lang, counter in words.items():
                listed = list(counter)
                for at in range(0, len(listed), SLICE):
                    some = listed[at : at + SLICE]
                    g, place = events(some)
                    weight = np.array([counter[w] for w in some], np.int64)[place]
                    held = total.get(lang, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    keys, back = np.unique(np.concatenate([held[0], g]), return_inverse=True)
                    sums = np.bincount(back, np.concatenate([held[1], weight]).astype(float), len(keys))
                    total[lang] = keys, sums.astype(np.int64)
            words.clear()

        for langs, texts in chunks(batches):
            for lang, text in zip(langs, texts):
                words.setdefault(lang, Counter()).update(text.split())
            if sum(map(len, words.values())) > REMEMBER // 3:
                fold()
        fold()
        for lang, (keys, sums) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(sums)], names=["lang", "g", "n"])

    return docs.select("lang", "text").mapInArrow(run, NGRAMS).groupBy("lang", "g").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For orders 1 to ``ORDER``: ``(lang, g, p)`` of every n-gram seen, and ``(lang, h, weight)``, the lower order's share by context."""
    types = {ORDER: counts.select("lang", "g", F.col("n").alias("raw"), F.col("n").alias("c"))}
    for n in range(ORDER - 1, 0, -1):
        suffix = lower_bits(F.col("g"), n).alias("g")
        lower = types[n + 1].groupBy("lang", suffix).agg(F.sum("raw").alias("raw"), F.count("*").alias("c"))
        at_border = F.lit(n > 1) & (F.shiftright("g", SYMBOL_BITS * (n - 1)) == 0)
        types[n] = stored(lower.withColumn("c", F.when(at_border, F.col("raw")).otherwise(F.col("c"))), "ngram-types")
    out = []
    below = None
    for n in range(1, ORDER + 1):
        ones, twos = (F.sum((F.col("c") == c).cast("double")) for c in (1, 2))
        once = F.try_divide(ones, ones + 2 * twos)
        discount = types[n].groupBy("lang").agg(F.greatest(F.lit(0.1), F.least(F.lit(0.95), F.coalesce(once, F.lit(0.5)))).alias("d"))
        h = F.shiftright("g", SYMBOL_BITS).alias("h")
        contexts = types[n].groupBy("lang", h).agg(F.sum("c").alias("total"), F.count("*").alias("kinds"))
        contexts = contexts.join(F.broadcast(discount), "lang")  # a row for each language
        contexts = contexts.select("lang", "h", "total", "d", (F.col("d") * F.col("kinds") / F.col("total")).alias("weight"))
        rows = types[n].withColumn("h", h).join(contexts, ["lang", "h"])
        if below is None:
            rows = rows.withColumn("lower", F.lit(1.0 / (1 << SYMBOL_BITS)))
        else:
            low = below.select("lang", F.col("g").alias("suffix"), F.col("p").alias("lower"))
            rows = rows.withColumn("suffix", lower_bits(F.col("g"), n - 1)).join(low, ["lang", "suffix"])
        p = F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("weight") * F.col("lower")
        below = stored(rows.select("lang", "g", p.alias("p")), "ngram-probabilities")
        out.append((below, contexts.select("lang", "h", "weight")))
    return out


class Model:
    """Sorted n-gram arrays of all orders; scores events of words."""

    def __init__(self, langs: list[str]):
        self.langs = langs
        self.grams: list[np.ndarray] = []
        self.logs: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.weights: list[np.ndarray] = []
        self.margins = np.zeros(BINS)
        self.limit = np.inf

    def lookup(self, keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def score(self, g: np.ndarray, n: int = ORDER) -> np.ndarray:
        """Log-probabilities (event, language); an n-gram no language has backs off to its suffix."""
        if n == 0:
            return np.full((len(g), len(self.langs)), -SYMBOL_BITS * np.log(2))
        g = lower_bits(g, n)
        at, found = self.lookup(self.grams[n - 1], g)
        out = self.logs[n - 1][at] if len(self.logs[n - 1]) else np.zeros((len(g), len(self.langs)))
        if not found.all():
            rest = g[~found]
            out[~found] = self.score(rest, n - 1) + self.weight(rest >> SYMBOL_BITS, n)
        return out

    def weight(self, h: np.ndarray, n: int) -> np.ndarray:
        at, found = self.lookup(self.contexts[n - 1], h)
        weights = self.weights[n - 1][at] if len(self.weights[n - 1]) else np.zeros((len(h), len(self.langs)))
        return np.where(found[:, None], weights, 0.0)

    def words(self, words: list[bytes]) -> np.ndarray:
        """For each word the summed log-probability under each language and the number of events."""
        out = np.zeros((len(words), len(self.langs) + 1))
        for at in range(0, len(words), SLICE):
            some = words[at : at + SLICE]
            g, place = events(some)
            logs = self.score(g)
            for i in range(len(self.langs)):
                out[at : at + SLICE, i] = np.bincount(place, logs[:, i], len(some))
            out[at : at + SLICE, -1] = np.bincount(place, minlength=len(some))
        return out

    def answer(self, sums: np.ndarray) -> tuple[int, float, float]:
        """The best language's place, the margin over the second in nats, and the cross-entropy of the best."""
        total = sums[:-1]
        best = int(total.argmax())
        rest = np.delete(total, best)
        margin = float(total[best] - rest.max()) if len(rest) else float(sums[-1])
        return best, margin, float(-total[best] / sums[-1])


def margin_bin(margin: float) -> int:
    return min(BINS - 1, int(4 * np.log1p(max(0.0, margin))))


def _document_sums(model: Model):
    """Summed word scores of each text of a chunk, words scored once a task."""
    rows = [np.zeros((0, len(model.langs) + 1))]

    def values(words):
        start = len(rows[0])
        rows[0] = np.concatenate([rows[0], model.words(words)])
        return range(start, len(rows[0]))

    def forget():
        rows[0] = rows[0][:0]

    known = WordTable(values, REMEMBER // 2, forget)

    def sums(texts):
        return [rows[0][found].sum(axis=0) for found in list(known.look_all([t.split() for t in texts]))]

    return sums


def _matrix(rows: DataFrame, key: str, value: str, langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and a (key, language) matrix of ``value``, NaN where a language lacks the key."""
    held = rows.select(F.col(key).alias("key"), "lang", F.col(value).alias("x")).toArrow()
    keys, back = np.unique(held.column("key").to_numpy(), return_inverse=True)
    out = np.full((len(keys), len(langs)), np.nan)
    column = {lang: i for i, lang in enumerate(langs)}
    out[back, [column[x] for x in held.column("lang").to_pylist()]] = held.column("x").to_numpy()
    return keys, out


def fit(training: DataFrame, calibration: DataFrame) -> Model:
    """The model of ``training(lang, text)``, calibrated on ``calibration(lang, text)``; rows without language or text are left out."""
    labelled = "lang IS NOT NULL AND text IS NOT NULL"
    counts = stored(count_ngrams(training.filter(labelled)), "ngram-counts")
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    model = Model(langs)
    orders = kneser_ney(counts)
    size = sum(p.select("g").distinct().count() for p, _ in orders) * (16 + 16 * len(langs))
    if size > MODEL_BYTES:
        raise ValueError(f"the language models take {size} bytes; raise MODEL_BYTES or lower ORDER")
    for n, (probabilities, contexts) in enumerate(orders, 1):
        grams, p = _matrix(probabilities, "g", "p", langs)
        where, w = _matrix(contexts, "h", "weight", langs)
        model.grams.append(grams)
        model.contexts.append(where)
        model.weights.append(np.nan_to_num(np.log(w), nan=0.0))
        # A language that lacks the n-gram backs off like at scoring.
        logs = np.log(p)
        back_off = model.score(grams, n - 1) + model.weight(grams >> SYMBOL_BITS, n) if len(grams) else logs
        model.logs.append(np.where(np.isnan(logs), back_off, logs))
    calibrate(model, calibration.filter(labelled))
    return model


def calibrate(model: Model, rows: DataFrame) -> None:
    """Sets the share of right answers by margin, never falling, and the cross-entropy that nearly all right answers stay below."""
    if not model.langs:
        return
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        sums = _document_sums(held.value)
        right, total, usual = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64), np.zeros(ENTROPIES, np.int64)
        for langs, texts in chunks(batches):
            for lang, s in zip(langs, sums(texts)):
                if s[-1]:
                    best, margin, entropy = held.value.answer(s)
                    i = margin_bin(margin)
                    total[i] += 1
                    right[i] += held.value.langs[best] == lang
                    if s[-1] >= LEAST_EVENTS and held.value.langs[best] == lang:
                        usual[min(ENTROPIES - 1, int(PER_NAT * entropy))] += 1
        kind, cell = np.repeat([0, 1, 2], [BINS, BINS, ENTROPIES]), np.concatenate([np.arange(BINS), np.arange(BINS), np.arange(ENTROPIES)])
        columns = [pa.array(kind), pa.array(cell), pa.array(np.concatenate([total, right, usual]))]
        yield pa.RecordBatch.from_arrays(columns, names=["kind", "cell", "n"])

    found = rows.select("lang", "text").mapInArrow(run, "kind long, cell long, n long").groupBy("kind", "cell").agg(F.sum("n").alias("n"))
    total, right, usual = np.zeros(BINS), np.zeros(BINS), np.zeros(ENTROPIES)
    for r in found.collect():  # a few hundred counts
        (total, right, usual)[r.kind][r.cell] = r.n
    pooled: list[list[float]] = []  # neighbouring bins are pooled until the shares never fall
    for t, c in zip(total, right):
        pooled.append([c + 1.0, t + 1.5, 1])
        while len(pooled) > 1 and pooled[-2][0] / pooled[-2][1] > pooled[-1][0] / pooled[-1][1]:
            last = pooled.pop()
            pooled[-1] = [a + b for a, b in zip(pooled[-1], last)]
    model.margins = np.array([min(1.0, a / b) for a, b, k in pooled for _ in range(k)])
    if usual.sum():
        place = int(np.searchsorted(np.cumsum(usual), USUAL * usual.sum()))
        model.limit = SLACK * (place + 1) / PER_NAT


def judge(model: Model, sums: np.ndarray) -> tuple[str, float, bool]:
    """Language, score and rejection of one text's summed word scores."""
    if not model.langs or not sums[-1]:
        return UNKNOWN, 0.0, True
    best, margin, entropy = model.answer(sums)
    score = float(model.margins[margin_bin(margin)])
    odd = sums[-1] >= LEAST_EVENTS and entropy > model.limit
    return model.langs[best], score, bool(score < LEAST_SCORE or odd)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang, score, rejected`` per row.

    Null texts and texts without a letter are ``und`` with score 0 and rejected, and so is everything when no language was learned. Ties go
    to the language first by name. A text of any length is scored whole.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        sums = _document_sums(held.value)
        for keys, texts in chunks(batches):
            langs, scores, rejected = zip(*[judge(held.value, s) for s in sums(texts)])
            columns = [pa.array(keys, pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang", "score", "rejected"])

    return only(docs, doc_id=F.col(id_col).cast("long"), text=text_col).mapInArrow(run, SCORES)


def remainder(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; null for null ids."""
    return F.crc32(F.col(id_col).cast("string")) % 3


def fit_on(docs: DataFrame, id_col: str = "doc_id") -> Model:
    """Fitted on the documents with a language that are not held out (remainder 1); a tenth of them calibrates."""
    rows = only(docs, id=id_col, lang="lang", text="text").filter(remainder("id") != 1)
    tenth = F.floor(F.crc32(F.col("id").cast("string")) / 3) % 10 == 0
    return fit(rows.filter(~tenth), rows.filter(tenth))


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, with all their columns; one pass without a shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(fit_on(docs, id_col))
    place = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        sums = _document_sums(held.value)
        for batch in batches:
            at = 0
            for _, texts in chunks([batch.select([place, place])]):
                good = [not judge(held.value, s)[2] for s in sums(texts)]
                yield batch.slice(at, len(texts)).filter(pa.array(good, pa.bool_()))
                at += len(texts)

    return docs.mapInArrow(run, docs.schema)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, fit_on(docs))
    held_out = F.coalesce(remainder() == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), F.col("lang").alias("lang_pred"), "score", "rejected")
