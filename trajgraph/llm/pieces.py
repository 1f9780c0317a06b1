"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A segment's characters start as symbols. An agenda holds the adjacent pairs whose joined text is a piece of the vocabulary, ordered by
score, then from left to right; the best pair is merged, stale entries are skipped, and the pairs with the new neighbours join the
agenda. A symbol that is no piece falls back to the pieces of its UTF-8 bytes.

Merges never cross the end of a word: no piece of the vocabulary holds the space mark behind another character, and none holds a line
feed among others (both are checked when the model is loaded). So a text is cut into runs of space marks with the characters behind
them, and a task encodes each different segment once. In every Arrow batch the new segments are also encoded by the sentencepiece
library; a difference ends the job.
"""

from __future__ import annotations

import hashlib
import heapq

from pyspark.sql import DataFrame, SparkSession

from .common import by_value, only, table
from .words import WordTable, chunks

by_value(__name__)

MARK = "▁"
# Fixed value: the library's text of the unknown piece.
UNKNOWN = " ⁇ "
SCHEMA = "doc_id long, ids array<int>, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class MergeModel:
    """Pieces and scores of a model file, with an encoder and a decoder of its own."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        sp = self.library
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        special = {i for i in range(len(self.pieces)) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i in range(len(self.pieces)) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.control = {i for i in special if i not in self.byte_of}
        self.unknown = sp.unk_id()
        if any(MARK in p.lstrip(MARK) or ("\n" in p and p != "\n") for p in self.ids):
            raise ValueError("this vocabulary merges across the ends of words or lines")
        if len(self.bytes) != 256 or any(sp.is_unused(i) for i in range(len(self.pieces))):
            raise ValueError("only vocabularies with byte fallback and without unused pieces are supported")

    def encode_segment(self, text: str) -> list[int]:
        """The ids of one segment whose spaces are marks already."""
        symbols = list(text)
        symbols = self._short(symbols) if len(symbols) <= 24 else self._long(symbols)
        out = []
        for s in symbols:
            i = self.ids.get(s)
            if i is None:
                out.extend(map(self.bytes.__getitem__, s.encode()))
            else:
                out.append(i)
        return out

    def _short(self, symbols: list[str]) -> list[str]:
        """The agenda of a short segment as a list of scores, searched for its first maximum."""
        score = self.scores.get
        none = float("-inf")
        agenda = [score(a + b, none) for a, b in zip(symbols, symbols[1:])]
        while agenda:
            best = max(agenda)
            if best == none:
                break
            i = agenda.index(best)
            symbols[i] += symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = score(symbols[i] + symbols[i + 1], none)
            if i:
                agenda[i - 1] = score(symbols[i - 1] + symbols[i], none)
        return symbols

    def _long(self, symbols: list[str]) -> list[str]:
        """The agenda as a heap over a linked list, so that a segment of n characters takes n log n steps."""
        score = self.scores.get
        n = len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple] = []

        def offer(i):
            j = right[i]
            joined = symbols[i] + symbols[j]
            s = score(joined)
            if s is not None:
                heapq.heappush(agenda, (-s, i, joined))

        for i in range(n - 1):
            offer(i)
        while agenda:
            _, i, joined = heapq.heappop(agenda)
            j = right[i] if symbols[i] else n
            if not symbols[i] or j >= n or symbols[i] + symbols[j] != joined:
                continue
            symbols[i], symbols[j] = joined, ""
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
                offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [s for s in symbols if s]

    def decode(self, ids: list[int], first: bool = True) -> str:
        """Text of ids as the library gives it: marks become spaces, the first space goes, wrong bytes become U+FFFD one by one.

        Without ``first`` the ids stand within a text, and their first space stays.
        """
        out, pending = [], bytearray()

        def flush():
            at = 0
            while at < len(pending):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(pending[at : at + size]).decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    size = 1
                at += size
            pending.clear()

        for i in ids:
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                first = False
                continue
            flush()
            if i in self.control:
                if i == self.unknown:
                    out.append(UNKNOWN)
                    first = False
                continue
            text = self.pieces[i].replace(MARK, " ")
            out.append(text[1:] if first and text.startswith(" ") else text)
            first = False
        flush()
        return "".join(out)


def segments(text: str) -> list[str]:
    """The segments of a text, the mark that is put before every text included.

    A segment is a line feed, or a run of space marks with what follows up to the next mark or line feed.
    """
    if not text:
        return []
    out: list[str] = []
    for n, line in enumerate(text.split("\n")):
        if n:
            out.append("\n")
        line = line.replace(MARK, " ")
        if n == 0:
            line = " " + line
        words = line.split(" ")
        if words[0]:
            out.append(words[0])
        marks = MARK
        for word in words[1:]:
            if word:
                out.append(marks + word)
                marks = MARK
            else:
                marks += MARK
        if len(marks) > 1:
            out.append(marks[1:])
    return out


def encode(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, check: bool = True
) -> DataFrame:
    """``doc_id, ids, decoded`` per row, or with ``digests`` their count and SHA-256 instead of the lists and texts.

    No begin or end ids, no sampling. Null and empty texts have no ids and decode to an empty text. Repeated rows are encoded each. A
    single text may be of any length. ``check`` compares every new segment with the library and raises when they differ.
    """

    def run(batches):
        import pyarrow as pa

        merges = MergeModel(model)

        def values(words: list) -> list:
            found = [merges.encode_segment(w) for w in words]
            if check:
                # Behind a line feed the library starts with a mark and the line feed's byte, which are left out again.
                own = [len(w) > 1 and w.startswith(MARK) for w in words]
                plain = [w[1:] if x else "\n" + w for w, x in zip(words, own)]
                for word, x, ours, theirs in zip(words, own, found, merges.library.encode(plain, num_threads=1)):
                    if ours != (theirs if x else theirs[2:]):
                        raise AssertionError(f"segment {word!r}: {ours}, and the library has {theirs}")
            if not digests:
                return found
            # A segment's bytes are whole characters, so the text of a document is that of its segments, less its first space.
            return [(len(x), ("," + ",".join(map(str, x))).encode(), merges.decode(x, first=False)) for x in found]

        known = WordTable(values)
        for keys, texts in chunks(batches):
            looked = known.look_all([segments(t.decode()) for t in texts])
            if not digests:
                ids = [[i for found in mine for i in found] for mine in looked]
                out = [pa.array(keys, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(map(merges.decode, ids), pa.string())]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "ids", "decoded"])
                continue
            counts, shas, decoded = [], [], []
            for found in looked:
                counts.append(sum(x[0] for x in found))
                shas.append(hashlib.sha256(b"".join([x[1] for x in found])[1:]).hexdigest())
                text = "".join([x[2] for x in found])
                decoded.append(hashlib.sha256(text[text[:1] == " " :].encode()).hexdigest())
            out = [pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = only(docs, doc_id=id_col, text=text_col)
    return rows.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, DIGESTS if digests else SCHEMA)


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), piece_model(), digests=True)
