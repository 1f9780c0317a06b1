import zlib

import numpy as np
from pyspark.sql import functions as F
from trajgraph.llm import langid
from trajgraph.llm.langid import ORDER, SYMBOL_BITS, count_ngrams, events, fit, keep_known, kneser_ney, op7_language, predict

TEXTS = {"a": ["the cat sat on the mat", "the hat and the cat", "that thin thing"], "b": ["der hund und die katze", "das ist der hut", "und dann"]}


def frame(spark):
    return spark.createDataFrame([(k, t) for k, ts in TEXTS.items() for t in ts], "lang string, text string")


def brute_counts():
    out = {}
    for lang, texts in TEXTS.items():
        for text in texts:
            for word in text.split():
                codes = [0] * (ORDER - 1) + [ord(c) for c in word] + [0]
                for i in range(ORDER - 1, len(codes)):
                    g = tuple(codes[i - ORDER + 1 : i + 1])
                    out[lang, g] = out.get((lang, g), 0) + 1
    return out


def pack(g):
    x = 0
    for s in g:
        x = x << SYMBOL_BITS | s
    return x


def brute_probability(lang, g, raw):
    """Interpolated Kneser-Ney by its definition, from the raw counts of the highest order."""
    n = len(g)
    if n == 0:
        return 1 / 2**SYMBOL_BITS
    table = {}
    for (other, full), c in raw.items():
        if other == lang:
            key = full[ORDER - n :]
            seen = table.setdefault(key, [0, set()])
            seen[0] += c
            seen[1].add(full[ORDER - n - 1 : ORDER - n])
    counts = {k: c if n == ORDER or (n > 1 and k[0] == 0) else len(before) for k, (c, before) in table.items()}
    ones, twos = sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
    d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5
    mine = {k: c for k, c in counts.items() if k[:-1] == g[:-1]}
    lower = brute_probability(lang, g[1:], raw)
    if not mine:
        return lower
    total = sum(mine.values())
    return max(mine.get(g, 0) - d, 0) / total + d * len(mine) / total * lower


def test_counts_and_probabilities(spark):
    raw = brute_counts()
    counts = count_ngrams(frame(spark))
    assert {(r.lang, r.g): r.n for r in counts.collect()} == {(k, pack(g)): c for (k, g), c in raw.items()}
    orders = kneser_ney(counts)
    top = {(r.lang, r.g): r.p for r in orders[-1][0].collect()}
    for lang, g in raw:
        assert np.isclose(top[lang, pack(g)], brute_probability(lang, g, raw))


def test_scores_of_any_ngram_are_the_models_own(spark):
    raw = brute_counts()
    model = fit(frame(spark), frame(spark).limit(0))
    rng = np.random.default_rng(2)
    letters = [0] + [ord(c) for c in "thecatdruns"]
    asked = [tuple(int(x) for x in rng.choice(letters, ORDER)) for _ in range(200)] + [g for _, g in raw]
    asked = [tuple(0 if 0 in g[i:-1] and i < ORDER - 1 else s for i, s in enumerate(g)) for g in asked]
    logs = model.score(np.array([pack(g) for g in asked]))
    for g, row in zip(asked, logs):
        for lang, value in zip(model.langs, row):
            assert np.isclose(value, np.log(brute_probability(lang, g, raw)))


def test_ngrams_stop_at_word_borders():
    g, place = events([b"Ab", b"--", "é1c".encode()])
    a, b, c, e = (ord(x) for x in "abcé")
    assert g.tolist() == [pack(x) for x in [(0, 0, 0, a), (0, 0, a, b), (0, a, b, 0), (0, 0, 0, e), (0, 0, e, 0), (0, 0, 0, c), (0, 0, c, 0)]]
    assert place.tolist() == [0, 0, 0, 2, 2, 2, 2]


def test_query_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op7_language(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.97
    assert np.mean([r.rejected for r in rows]) < 0.01


def test_hard_rows_and_rejection(spark, monkeypatch):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit_on(base)
    rows = [(1, None), (2, ""), (3, " 123 --- !!! 🙂"), (4, "the " * 50_000), (5, "x" * 200_000), (6, "qzjxkvw " * 40), (None, "the thing and that"), (7, "日本語 のテキスト"), (7, "È")]
    df = spark.createDataFrame([(i, t, "en", 0.5) for i, t in rows], "doc_id long, text string, lang string, score double").withColumn("row", F.lit(1))
    out = predict(df, model).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out if r.doc_id not in (None, 7)}
    assert all(got[i].lang == "und" and got[i].score == 0 and got[i].rejected for i in (1, 2, 3))
    assert got[4].lang == "en" and got[6].rejected
    kept = keep_known(base.unionByName(df.withColumn("doc_id", F.col("doc_id") + 10**6), allowMissingColumns=True))
    assert kept.columns[: len(base.columns)] == base.columns
    assert kept.filter("doc_id < 1000000").count() >= base.filter("text rlike '[a-zA-Z]'").count() * 0.98
    assert not {r.doc_id - 10**6 for r in kept.filter("doc_id >= 1000000").collect()} & {1, 2, 3, 6}
    none = langid.fit_on(base.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang, r.score, r.rejected) for r in predict(df, none).collect()} == {("und", 0.0, True)}
    assert predict(df.limit(0), model).count() == 0 and langid.fit_on(base.limit(0)).langs == []
    one = langid.fit_on(base.withColumn("lang", F.lit("xx")))
    assert predict(df.filter("doc_id = 4"), one).first().lang == "xx"
    monkeypatch.setattr(langid, "REMEMBER", 50)
    assert count_ngrams(base.select("lang", "text")).agg(F.sum("n")).first() == count_ngrams(base.select("lang", "text")).agg(F.sum("n")).first()


def test_letters_of_every_script_are_apart():
    """Letters whose codes agree in their last bits, and letters beyond the first plane."""
    words = ["авг", "αβγ", "漢字仮", "ابت", "ꙀѐА", "𐐨𐐩", "ƀĀ"]
    seen = {}
    for w in words:
        for c in set(w):
            seen.setdefault(int(langid.symbols(c)[0]), set()).add(c)
    assert 0 not in seen and all(len(v) == 1 for v in seen.values())
    assert langid.symbols("1 -\n🙂_").tolist() == [0] * 6


def test_scripts_are_told_apart_and_one_junk_label_changes_little(spark):
    texts = {"ru": "это просто слова и они стоят тут", "el": "αυτές είναι απλές λέξεις που στέκονται εδώ", "en": "these are just words and they stand here"}
    rows = [(lang, " ".join(np.random.default_rng(i).permutation(t.split() * 3))) for i in range(60) for lang, t in texts.items()]
    training = spark.createDataFrame(rows, "lang string, text string")
    clean, junk = training.limit(100), training.limit(100).unionByName(spark.createDataFrame([("en", "q7z xkj wvq " * 30)], "lang string, text string"))
    one, two = fit(training, clean), fit(training, junk)
    assert one.limit == two.limit and one.limit < 20
    asked = spark.createDataFrame([(1, "слова стоят"), (2, "λέξεις απλές"), (3, "words stand here"), (4, "wvq xkj qqz " * 20)], "doc_id long, text string")
    for model in (one, two):
        got = {r.doc_id: r for r in predict(asked, model).collect()}
        assert [got[i].lang for i in (1, 2, 3)] == ["ru", "el", "en"] and not any(got[i].rejected for i in (1, 2, 3))
        assert got[4].rejected
