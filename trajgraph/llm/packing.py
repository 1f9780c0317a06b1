"""Sum-of-squares online packing of tokenised documents into windows of fixed length.

Each task packs the documents of its own partition, in order. A level array counts its open windows by fill level. A document longer
than the window is cut into full windows and a rest; the rest goes, whole, to the open window (or a new one) for which the sum of the
squared level counts grows least, ties to the fullest. A full window is closed at once. When ``open_windows`` are open, and at the end
of the partition, what the open windows hold is poured into full windows, cutting where one is full. What is left at the end, less than
one window, is cut into sequences whose lengths are powers of two. So nothing is padded.

No shuffle, and memory of at most ``open_windows`` windows a task. Ids come from the ``tokenizers`` library, once for each different word
of a task: this vocabulary drops white space, so the ids of a text are those of its white-space-separated words in order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import by_value, only, table
from .words import WordTable, chunks

by_value(__name__)

WINDOW = 2048
#: The id that ends each document.
END_ID = 1
#: Open windows of a task before they are poured out: 8 MB of ids.
OPEN_WINDOWS = 1024

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"
)


def choose_level(levels: np.ndarray, size: int) -> int:
    """Fill level (0: a new window) whose use for ``size`` tokens makes the sum of squared level counts smallest.

    ``levels[h]`` counts the open windows with ``h`` tokens, for ``0 < h < window``; full windows do not count.
    """
    window = len(levels) - 1
    start = levels[: window - size + 1].astype(np.int64)
    end = levels[size : window + 1].astype(np.int64)
    change = 2 * end + 1
    change[-1] = 0  # a filled window leaves the array
    change -= np.where(start > 0, 2 * start - 1, 0)
    usable = start > 0
    usable[0] = True
    change = np.where(usable, change, np.iinfo(np.int64).max)
    return int(len(change) - 1 - np.argmin(change[::-1]))


class Packer:
    """Packs pieces ``(doc, start, ids as bytes, document's tokens)``; closed sequences go to ``emit(list of pieces)``."""

    def __init__(self, emit, window: int = WINDOW, open_windows: int = OPEN_WINDOWS):
        self.emit, self.window, self.most = emit, window, open_windows
        self.levels = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list[tuple]]] = {}
        self.count = 0

    def add(self, doc, ids: bytes) -> None:
        total = len(ids) // 4
        at = 0
        while total - at >= self.window:
            self.emit([(doc, at, ids[4 * at : 4 * (at + self.window)], total)])
            at += self.window
        if at < total:
            self.place((doc, at, ids[4 * at :], total))

    def place(self, piece: tuple) -> None:
        size = len(piece[2]) // 4
        level = choose_level(self.levels, size)
        if level:
            pieces = self.open[level].pop()
            self.levels[level] -= 1
            self.count -= 1
        else:
            pieces = []
        pieces.append(piece)
        if level + size == self.window:
            self.emit(pieces)
            return
        self.open.setdefault(level + size, []).append(pieces)
        self.levels[level + size] += 1
        self.count += 1
        if self.count >= self.most:
            self.pour(last=False)

    def pour(self, last: bool) -> None:
        held = [p for level in sorted(self.open, reverse=True) for pieces in self.open[level] for p in pieces]
        self.open, self.count = {}, 0
        self.levels[:] = 0
        now, fill = [], 0
        for piece in held:
            while piece:
                head, piece = cut(piece, self.window - fill)
                now.append(head)
                fill += len(head[2]) // 4
                if fill == self.window:
                    self.emit(now)
                    now, fill = [], 0
        if fill and not last:
            self.open[fill], self.levels[fill], self.count = [now], 1, 1
        elif fill:
            for bit in range(fill.bit_length() - 1, -1, -1):
                size, part = 1 << bit, []
                if fill & size:
                    while size:
                        head, rest = cut(now.pop(0), size)
                        part.append(head)
                        size -= len(head[2]) // 4
                        if rest:
                            now.insert(0, rest)
                    self.emit(part)


def cut(piece: tuple, size: int) -> tuple:
    """The first ``size`` tokens of a piece, and the rest or None."""
    doc, start, ids, total = piece
    if len(ids) <= 4 * size:
        return piece, None
    return (doc, start, ids[: 4 * size], total), (doc, start + size, ids[4 * size :], total)


# Signs, and ASCII letters and the letters of Latin-1; a lower-cased run of either is one group in this vocabulary's splitter.
_SIGNS = b".,;:!?#$%&*()-"
_LETTER = rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])"


def lowered(text: bytes) -> bytes:
    """ASCII letters lower-cased where the tokenizer's own steps give the same ids with or without it.

    A letter may compose with a combining mark (U+0300 to U+036F) in one case only, and special tokens are matched as they stand.
    """
    return text if b"<|" in text or b"\xcc" in text or b"\xcd" in text else text.lower()


def word_ids(vocabulary: str) -> WordTable:
    """A table from a word's bytes to its ids as little-endian unsigned 32-bit numbers.

    Most words are letters with signs behind them, and the vocabulary's splitter cuts there too: each different run of letters goes through
    the library once, many in one call, and so do the signs. Other words go through it whole.
    """
    import os
    import re

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    ends = np.zeros(tokenizer.get_vocab_size(), bool)
    ends[[i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
    letters = re.compile(_LETTER + rb"+").fullmatch

    def runs(parts: list) -> list:
        out = []
        for at in range(0, len(parts), 2000):
            text = b" ".join(parts[at : at + 2000]).decode()
            ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            stops = 4 * (np.flatnonzero(ends[ids]) + 1)
            data, stops = ids.tobytes(), stops.tolist()
            out += [data[a:b] for a, b in zip([0, *stops], stops)]
        return out

    def whole(words: list) -> list:
        found = tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    known_runs, known_rest = WordTable(runs), WordTable(whole)

    def values(words: list) -> list:
        stems = [w.rstrip(_SIGNS) for w in words]
        plain = [letters(s) is not None for s in stems]
        rest = known_rest.look([w[len(s) :] if p else w for w, s, p in zip(words, stems, plain)])
        known = iter(known_runs.look([s for s, p in zip(stems, plain) if p]))
        return [next(known) + r if p else r for r, p in zip(rest, plain)]

    return WordTable(values)


def text_ids(texts: list, known: WordTable) -> Iterator[bytes]:
    """The ids of each text, as :func:`word_ids` has them; each different word of all ``texts`` becomes one Python object and is looked up once."""
    import pyarrow as pa
    import pyarrow.compute as pc

    words = pc.ascii_split_whitespace(pa.array(list(map(lowered, texts)), pa.binary()).cast(pa.string()))
    coded = words.flatten().dictionary_encode()
    found = known.look(coded.dictionary.cast(pa.binary()).to_pylist())
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    ids = np.frombuffer(b"".join(found), "<u4")
    codes = coded.indices.to_numpy()
    many = sizes[codes]
    ends = np.concatenate(([0], np.cumsum(many)))
    starts = (np.cumsum(sizes) - sizes)[codes] - ends[:-1]
    out = ids[np.repeat(starts, many) + np.arange(ends[-1])].tobytes()
    stops = (4 * ends[words.offsets.to_numpy()]).tolist()
    return (out[a:b] for a, b in zip(stops, stops[1:]))


def pack(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
    open_windows: int = OPEN_WINDOWS,
) -> DataFrame:
    """One row per piece of a document, see ``SCHEMA``; ``vocabulary`` is the path of a tokenizer file that drops white space.

    Null and empty texts are a document of the end id alone. Rows that repeat an id are packed as documents of their own. A null id
    stays null. ``sequence_length`` counts the tokens of the piece's sequence. Sequence ids hold the partition in their upper bits.
    """

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        kinds = [pa.int64()] * 8
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        known = word_ids(vocabulary)
        sequence = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []

        def emit(pieces):
            nonlocal sequence
            at = 0
            length = sum(len(p[2]) for p in pieces) // 4
            for doc, start, ids, total in pieces:
                n = len(ids) // 4
                rows.append((doc, start, n, zlib.crc32(ids), total, sequence, at, length))
                at += n
            sequence += 1

        def out():
            columns = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        packer = Packer(emit, window, open_windows)
        end = np.array([end_id], "<u4").tobytes()
        for docs_, texts in chunks(batches):
            for doc, ids in zip(docs_, text_ids(texts, known)):
                packer.add(doc, ids + end)
            if len(rows) > 10_000:
                yield out()
        packer.pour(last=True)
        if rows:
            yield out()

    rows = only(docs, doc_id=id_col, text=text_col)
    return rows.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), word_vocabulary())
