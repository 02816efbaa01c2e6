import itertools
import zlib

import numpy as np

from eventmill.llm import langid as L


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    A, pi, sizes = np.exp(rng.normal(size=(3, 3))), np.exp(rng.normal(size=3)), np.array([1, 4, 33, 6, 64, 70])
    P = np.exp(rng.normal(size=(sizes.sum(), 3)))
    got = L._transfer(P, A, pi, sizes)
    for at, n in ((1, 4), (38, 6)):  # all label sequences of the short texts
        total = np.zeros((n, 3))
        for y in itertools.product(range(3), repeat=n):
            w = pi[y[0]] * P[at, y[0]]
            for t in range(1, n):
                w *= A[y[t - 1], y[t]] * P[at + t, y[t]]
            total[np.arange(n), y] += w
        assert np.allclose(got[at : at + n], total / total.sum(1, keepdims=True))


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    told = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(told) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in told)
    held = [r for r in told if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in told)


def test_switches_inside_a_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("n_chars > 400")
    model = L.fit(docs)
    part = {r.lang: " ".join(r.text.split()[:40]) for r in docs.collect() if r.lang in ("en", "de")}
    mixed = spark.createDataFrame([(1, part["en"] + " " + part["de"])], "doc_id long, text string")
    runs = L.predict(mixed, model, runs=True).first().runs
    label = {i: r.lang for r in runs for i in range(r.first, r.first + r.tokens)}
    right = [label.get(i) == ("en" if i < 40 else "de") for i in range(80) if i in label]
    assert np.mean(right) > 0.8


def test_prediction_reads_the_text_alone(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = L.fit(docs)
    from pyspark.sql import functions as F

    other = docs.select((F.col("doc_id") + 10**6).alias("doc_id"), "text", F.lit("xx").alias("lang"))
    a = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in L.predict(docs, model).collect()}
    b = {r.doc_id - 10**6: (r.lang_pred, round(r.score, 9)) for r in L.predict(other, model).collect()}
    assert a == b


def test_odd_rows(odd_docs, no_docs, spark):
    rows = L.identify(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r.doc_id: (r.lang_pred, r.score) for r in rows if r.doc_id in (5, 6, 7)} == dict.fromkeys((5, 6, 7), ("und", 0.0))
    assert next(r for r in rows if r.doc_id == 12).lang_pred in {"en", "de", "fr"}
    assert L.identify(no_docs).count() == 0
    kept = L.drop_unidentified(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == [1, 2, 2, 8, 9, 10, 12]
    unlabelled = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert L.identify(unlabelled).first().lang_pred == "und"
    one = spark.createDataFrame([(1, "abc def", "en"), (2, "ghi", "en"), (3, "1", "en"), (4, "x y", "en")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in L.identify(one).collect()} == {"en", "und"}


def test_small_tables_give_the_same(monkeypatch):
    sample = [("the cat and the dog ran " * 3, "en"), ("der hund und die katze lief " * 3, "de")]
    model = L.train(sample)
    texts = ["the dog und die cat ran 7 times", "katze", "!!", "and " * 100 + "zebra quark"]
    want = {i: p for i, _, p in L.Tagger(model).tag(texts)}
    monkeypatch.setattr(L, "KNOWN_WORDS", 3)
    got = {i: p for i, _, p in L.Tagger(model).tag(texts)}
    assert want.keys() == got.keys() and all(np.allclose(want[i], got[i], atol=1e-6) for i in want)


def test_every_language_gets_its_documents(spark):
    rows = [(i, f"the cat number {'abcdefghij'[i % 10]} and the dog {chr(97 + i // 10 % 26)} ran {chr(97 + i // 260)}", "en") for i in range(800)]
    rows += [(i, "one text that was copied again and again", "en") for i in range(800, 1600)]
    rows += [(i, f"12 34 {chr(97 + i % 26)}lempi talo ja metsä", "fi") for i in range(2000, 2012)]
    rows += [(i, "1 2 3", "xx") for i in range(3000, 3040)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = L.labelled_sample(docs, "doc_id", "text", "lang", 100)
    finnish = {r[1] for r in rows if r[2] == "fi" and zlib.crc32(str(r[0]).encode()) % 4 != 2}
    assert {t for t, y in sample if y == "fi"} == finnish
    assert sum(y == "en" for _, y in sample) == 50 and len(set(sample)) == len(sample)
    assert {y for _, y in sample} == {"en", "fi"}
    assert "fi" in {r.lang_pred for r in L.identify(docs).filter("doc_id between 2000 and 2999").collect()}
