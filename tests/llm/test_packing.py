import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer
from trajgraph.llm.packing import Packer, choose_level, lowered, op1_pack, pack, text_ids, word_vocabulary
from trajgraph.llm.words import WordTable


def brute_level(levels, size):
    window = len(levels) - 1
    best = None
    for h in range(0, window - size + 1):
        if h and not levels[h]:
            continue
        n = list(levels)
        n[0] = n[window] = 0
        if h:
            n[h] -= 1
        if h + size < window:
            n[h + size] += 1
        total = sum(x * x for x in n)
        if best is None or (total, -h) < best[0]:
            best = ((total, -h), h)
    return best[1]


def test_level_choice_is_the_smallest_sum_of_squares():
    rng = np.random.default_rng(3)
    for _ in range(300):
        levels = rng.integers(0, 4, 17) * (rng.random(17) < 0.5)
        levels[0] = levels[16] = 0
        size = int(rng.integers(1, 16))
        assert choose_level(levels, size) == brute_level(levels, size)


@pytest.mark.parametrize("most", [2, 5, 1000])
def test_packer_fills_windows_and_keeps_every_token(most):
    rng = np.random.default_rng(most)
    out = []
    packer = Packer(out.append, window=16, open_windows=most)
    docs = [np.arange(1000 * d, 1000 * d + int(rng.integers(1, 60)), dtype="<u4") for d in range(200)]
    for d, ids in enumerate(docs):
        packer.add(d, ids.tobytes())
    packer.pour(last=True)
    seen = defaultdict(list)
    for pieces in out:
        n = sum(len(p[2]) // 4 for p in pieces)
        assert n == 16 or n & (n - 1) == 0
        for doc, start, ids, total in pieces:
            assert total == len(docs[doc])
            seen[doc].append((start, ids))
    for d, ids in enumerate(docs):
        assert b"".join(x for _, x in sorted(seen[d])) == ids.tobytes()


def check(rows, texts, window=2048):
    tokenizer = Tokenizer.from_file(word_vocabulary())
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(docs) == set(texts)
    for doc, text in texts.items():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(docs[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == pieces[0].sequence_length <= window


def test_query_against_whole_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = op1_pack(spark, sf).collect()
    check(rows, {d.doc_id: d.text for d in docs})
    lengths = {r.sequence_id: r.sequence_length for r in rows}.values()
    assert all(n & (n - 1) == 0 for n in lengths)


def test_hard_texts(spark):
    texts = {
        1: None,
        2: "",
        3: " \t\n\x0b\x0c\r ",
        4: "Don't <|endoftext|>STOP it's 12345 a b c\x1cd é\ńx ΣΑΣ İ",
        5: "x" * 5000,
        6: "word " * 9000,
        8: "I\u0307 H\u0331 h\u0331 <|ENDOFTEXT|> A<|endoftext|>B Çtion×÷Ñü ÉÉ9155 a'S don'T (955)... x\xa0y …a#… ŒŒ ªº",
        9: "THE###and%%% Re-use_of A1b2C3 don't...'ve'LL 'S é's É'Re",
        7: "日本語のテキスト 🙂🙂 ﬁ①",
    }
    frame = spark.createDataFrame(
        [(k, v, 1, 2) for k, v in texts.items()], "doc_id long, text string, start int, sequence_id int"
    )
    check(pack(frame, word_vocabulary()).collect(), texts)
    assert pack(frame.limit(0), word_vocabulary()).count() == 0
    twice = pack(frame.filter("doc_id = 4").union(frame.filter("doc_id = 4")).coalesce(1), word_vocabulary(), open_windows=2).collect()
    assert sum(r.length for r in twice) == 2 * twice[0].doc_tokens


def test_ids_of_a_chunk_are_looked_up_once_for_each_word():
    calls = []

    def values(words):
        calls.append(sorted(words))
        return [b"".join(bytes([c, 0, 0, 0]) for c in w) for w in words]

    space = "".join(map(chr, range(128))).encode()
    texts = [b"", b" ", b"b A  b", b"b\xc3\x84 \xc2\xa0 <|B|> C", space, b"b"]
    known = WordTable(values)
    want = [b"".join(bytes([c, 0, 0, 0]) for c in b"".join(lowered(t).split())) for t in texts]
    assert list(text_ids(texts, known)) == want
    assert len(calls) == 1 and len(calls[0]) == len(set(calls[0]))
    assert list(text_ids([b"a b"], known)) == [bytes([97, 0, 0, 0, 98, 0, 0, 0])] and len(calls) == 1
    assert list(text_ids([], known)) == []
