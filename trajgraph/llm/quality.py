"""Quality scores by a regularised quadratic discriminant over document statistics.

Every whole text becomes some twenty statistics (lengths, shares of kinds of characters, repetition, lines), each on a logarithmic or logit
scale. Statistics are standardised by the labelled rows and bent towards a bound, so that no single text rules a covariance. For each class
a mean and a covariance are summed over all labelled rows in Spark; a covariance is shrunk towards the pooled one and then towards a
multiple of the identity. The score of a text is the difference of its Mahalanobis log-densities under both classes, taken with Cholesky
factors that are worked out once and sent along. How far to shrink, and the two numbers that turn the difference into a probability, are
chosen out of fold.

Statistics are whole multiples of 1/1024, so all sums over the corpus are whole numbers and come out alike in any order of rows.
"""

from __future__ import annotations

import re
import zlib
from itertools import islice
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, only, stored, table
from .words import chunks

by_value(__name__)

#: Parts of one unit that a statistic is rounded to.
UNIT = 1024
#: Standard deviations at which a statistic is bent.
BEND = 4.0
#: Shrinkage towards the pooled covariance and towards the identity, all pairs of which are tried.
POOLED = (0.0, 0.2, 0.5, 0.9)
ROUND = (0.01, 0.05, 0.2)
#: Bins of the out-of-fold differences.
BINS = 400
FOLDS = 5
THRESHOLD = 0.3

_COMMON = np.frombuffer(b".,;:'\"!?-()", np.uint8)
_SYMBOLS = np.array([c for c in range(33, 127) if not chr(c).isalnum() and c not in _COMMON.tolist()])
_LONELY = re.compile(rb"(?:^|(?<=\s))[^\sA-Za-z0-9\x80-\xff]+(?=\s|$)")
_MIXED = re.compile(rb"[A-Za-z\x80-\xff](?![A-Za-z0-9.,;:'\"!?()-])[!-~]")


def _logit(part: float, whole: float) -> float:
    return float(np.log((part + 0.5) / (max(whole - part, 0) + 0.5)))


def statistics(text: bytes) -> list[float]:
    """The statistics of one text; an empty text has those of no characters, words and lines."""
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = len(text)
    chars = size - int(hist[128:192].sum())
    upper, lower, digits = int(hist[65:91].sum()), int(hist[97:123].sum()), int(hist[48:58].sum())
    letters = upper + lower + int(hist[192:].sum())
    common, symbols = int(hist[_COMMON].sum()), int(hist[_SYMBOLS].sum())
    words = text.split()
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    same = np.fromiter(map(eq, words, islice(words, 1, None)), np.int8, max(n - 1, 0))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], same, [0]])))
    run = int((edges[1::2] - edges[::2]).max()) if len(edges) else 0
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    top = max(counts.values(), default=0)
    lines = text.split(b"\n")
    share = hist[hist > 0] / max(size, 1)
    lonely, mixed = len(_LONELY.findall(text)), len(_MIXED.findall(text))
    packed = len(zlib.compress(text, 1)) if size else 0
    return [
        np.log1p(chars),
        np.log1p(n),
        np.log1p(float(lengths.mean()) if n else 0.0),
        np.log1p(float(lengths.std()) if n else 0.0),
        np.log1p(int(lengths.max()) if n else 0),
        _logit(letters, chars),
        _logit(upper, upper + lower),
        _logit(digits, chars),
        _logit(common, chars),
        _logit(symbols, chars),
        _logit(len(counts), n),
        _logit(top, n),
        _logit(int(same.sum()), n),
        np.log1p(run),
        _logit(lonely, n),
        _logit(mixed, n),
        np.log1p(symbols),
        _logit(len(set(lines)), len(lines)),
        np.log1p(chars / len(lines)),
        float(-(share * np.log(share)).sum()),
        np.log((packed + 1.0) / (size + 16.0)),
    ]


WIDTH = len(statistics(b""))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, f`` per row, the statistics in parts of a unit; null texts count as empty."""

    def run(batches):
        import pyarrow as pa

        for keys, texts in chunks(batches):
            found = np.rint(UNIT * np.array([statistics(t) for t in texts])).astype(np.int64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * WIDTH, pa.int32()), pa.array(found.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), flat], names=["doc_id", "f"])

    return only(docs, doc_id=F.col(id_col).cast("long"), text=text_col).mapInArrow(run, "doc_id long, f array<long>")


class Model:
    """Scale of the statistics, discriminant of both classes, and the two numbers of the probability."""

    def __init__(self):
        self.centre, self.spread = np.zeros(WIDTH), np.ones(WIDTH)
        self.rule: tuple | None = None
        self.slope, self.offset = 0.0, 0.0

    def bent(self, raw: np.ndarray) -> np.ndarray:
        """Standardised and bent statistics, again in whole parts of a unit."""
        z = (raw - self.centre) / self.spread
        return np.rint(UNIT * BEND * np.tanh(z / BEND)).astype(np.int64)

    def score(self, raw: np.ndarray) -> np.ndarray:
        odds = np.full(len(raw), self.offset)
        if self.rule is not None:
            odds = odds + self.slope * squeezed(difference(self.rule, self.bent(raw)))
        return 1.0 / (1.0 + np.exp(-np.clip(odds, -500, 500)))


def squeezed(x: np.ndarray) -> np.ndarray:
    """Differences of log-densities of twenty statistics run into the hundreds; the logarithmic scale keeps their order."""
    return np.arcsinh(x)


def discriminant(sums: dict[int, tuple[int, np.ndarray, np.ndarray]], pooled: float, rounded: float) -> tuple:
    """Mean, inverse Cholesky factor and half log-determinant of both classes, from count, sum and sum of products of each."""
    moments = {}
    for label, (n, total, products) in sums.items():
        mean = total / n / UNIT
        moments[label] = n, mean, products / n / UNIT**2 - np.outer(mean, mean)
    n = sum(m[0] for m in moments.values())
    common = sum(m[0] * m[2] for m in moments.values()) / n
    out = []
    for label in (0, 1):
        _, mean, own = moments[label]
        mixed = (1 - pooled) * own + pooled * common
        mixed = (1 - rounded) * mixed + rounded * max(float(np.trace(mixed)) / WIDTH, 1e-3) * np.eye(WIDTH)
        factor = np.linalg.cholesky(mixed)
        out.append((mean, np.linalg.inv(factor), float(np.log(np.diag(factor)).sum())))
    return tuple(out)


def difference(rule: tuple, bent: np.ndarray) -> np.ndarray:
    """Log-density under class 1 less that under class 0."""
    z = bent / UNIT
    log = []
    for mean, inverse, half in rule:
        y = (z - mean) @ inverse.T
        log.append(-0.5 * (y * y).sum(axis=1) - half)
    return log[1] - log[0]


def _arrays(batch) -> np.ndarray:
    return batch.column("f").flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)


def _summed(rows: DataFrame, partial, groups: int) -> np.ndarray:
    """Whole-number sums ``(group, cell)`` over all rows; ``partial`` gives them for a batch. Only these few sums reach the driver."""

    def run(batches):
        import pyarrow as pa

        total = None
        for batch in batches:
            if batch.num_rows:
                found = partial(batch)
                total = found if total is None else total + found
        if total is not None:
            cells = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.reshape(-1)[cells])], names=["cell", "n"])

    found = rows.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    size = partial(None)
    out = np.zeros(size, np.int64)
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(groups, -1)


def fit(rows: DataFrame) -> Model:
    """The model of ``rows(f, fold, label)`` with labels 0 and 1; without both labels every text scores the share of ones (0.5 without any)."""
    model = Model()

    def plain(batch):
        if batch is None:
            return 2 * (1 + 2 * WIDTH)
        f, label = _arrays(batch), batch.column("label").to_numpy()
        return np.concatenate([np.concatenate([[(label == y).sum()], f[label == y].sum(axis=0), (f[label == y] ** 2).sum(axis=0)]) for y in (0, 1)])

    first = _summed(rows, plain, 2)
    n0, n1 = first[:, 0].tolist()
    model.offset = float(np.log((n1 + 0.5) / (n0 + 0.5)))
    if not n0 or not n1:
        return model
    whole = first.sum(axis=0)
    n = n0 + n1
    model.centre = whole[1 : 1 + WIDTH] / n
    model.spread = np.sqrt(np.maximum(whole[1 + WIDTH :] / n - model.centre**2, 1.0))
    place = 1 + WIDTH + WIDTH * WIDTH

    def products(batch):
        if batch is None:
            return FOLDS * 2 * place
        z, label, fold = model.bent(_arrays(batch)), batch.column("label").to_numpy(), batch.column("fold").to_numpy()
        out = np.zeros((FOLDS, 2, place), np.int64)
        for f in np.unique(fold):
            for y in (0, 1):
                mine = z[(fold == f) & (label == y)]
                out[f, y] = np.concatenate([[len(mine)], mine.sum(axis=0), (mine.T @ mine).reshape(-1)])
        return out.reshape(-1)

    cells = _summed(rows, products, FOLDS * 2).reshape(FOLDS, 2, place)

    def classes(part: np.ndarray) -> dict:
        return {y: (int(part[y, 0]), part[y, 1 : 1 + WIDTH], part[y, 1 + WIDTH :].reshape(WIDTH, WIDTH)) for y in (0, 1)}

    grid = [(a, b) for a in POOLED for b in ROUND]
    rest = [cells.sum(axis=0) - cells[f] for f in range(FOLDS)]
    rules = {f: [discriminant(classes(rest[f]), a, b) for a, b in grid] for f in range(FOLDS) if rest[f][:, 0].min() and cells[f, :, 0].sum()}
    edge = 12.0

    def out_of_fold(batch):
        if batch is None:
            return len(grid) * 2 * BINS
        z, label, fold = model.bent(_arrays(batch)), batch.column("label").to_numpy(), batch.column("fold").to_numpy()
        out = np.zeros((len(grid), 2, BINS), np.int64)
        for f, made in rules.items():
            mine = fold == f
            for g, rule in enumerate(made):
                at = ((squeezed(difference(rule, z[mine])) + edge) / (2 * edge) * BINS).astype(np.int64)
                for y in (0, 1):
                    out[g, y] += np.bincount(np.clip(at[label[mine] == y], 0, BINS - 1), minlength=BINS)
        return out.reshape(-1)

    counts = _summed(rows, out_of_fold, len(grid)).reshape(len(grid), 2, BINS)
    middles = (np.arange(BINS) + 0.5) / BINS * 2 * edge - edge
    choices = [logistic(middles, c[0], c[1]) for c in counts]
    best = min(range(len(grid)), key=lambda g: (choices[g][2], -g))
    model.slope, model.offset, _ = choices[best]
    model.rule = discriminant(classes(cells.sum(axis=0)), *grid[best])
    return model


def logistic(x: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> tuple[float, float, float]:
    """Slope, offset and mean loss of the logistic curve through counts of both labels at ``x``; a tiny ridge keeps it finite, the slope rises."""
    total = zeros + ones
    a, b = 0.1, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        w = total * p * (1 - p)
        ga, gb = (x * (total * p - ones)).sum() + 1e-3 * a, (total * p - ones).sum() + 1e-3 * b
        haa, hab, hbb = (w * x * x).sum() + 1e-3, (w * x).sum(), w.sum() + 1e-3
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = min(1.0, 2.0 / max(abs(da), abs(db), 1e-12))
        a, b = max(a - size * da, 1e-3), b - size * db
    p = np.clip(1 / (1 + np.exp(-(a * x + b))), 1e-12, 1 - 1e-12)
    loss = -(ones * np.log(p) + zeros * np.log(1 - p)).sum() / max(total.sum(), 1)
    return float(a), float(b), float(loss)


def remainder(column: Column) -> Column:
    """crc32 of the id as text modulo ``FOLDS``; null for null ids."""
    return F.crc32(column.cast("string")) % FOLDS


def learn(found: DataFrame, labels: DataFrame, label_col: str = "quality") -> Model:
    """Fitted on ``found(doc_id, f)`` with the labels of ids whose remainder is not 0.

    Label rows of null id or null label are left out; a label other than 1 counts as 0. An id labelled more than once counts each time.
    """
    marks = only(labels, doc_id=F.col("doc_id").cast("long"), label=F.col(label_col).cast("long")).filter("label IS NOT NULL")
    marks = marks.select("doc_id", (F.col("label") == 1).cast("long").alias("label"), remainder(F.col("doc_id")).alias("fold"))
    return fit(stored(found.join(marks.filter("fold <> 0"), "doc_id").select("f", "fold", "label"), "quality-labelled"))


def predict(found: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` per row of ``found(doc_id, f)``: the probability of label 1."""
    held = found.sparkSession.sparkContext.broadcast(model)  # a few kilobytes

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(held.value.score(_arrays(batch)))], names=["doc_id", "score"])

    return found.select("doc_id", "f").mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs``.

    Null and empty texts are scored by the statistics of an empty text. Repeated rows are scored each; rows without an id are scored and never
    learned from. A text of any length is read whole.
    """
    found = stored(features(docs, id_col, text_col), "quality-features")
    scored = predict(found, learn(found, labels))
    held_out = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
