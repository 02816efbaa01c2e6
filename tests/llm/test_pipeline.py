import zlib

import corpus_pipeline
from tests.llm import test_contamination, test_jaccard


def test_every_stage_on_its_own_input(spark, sf_dir, odd_docs):
    start = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in start.collect()}
    bench = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs, before = start, set(texts)
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, sf_dir)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == start.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        rows = docs.collect()
        after = {r.doc_id for r in rows}
        assert len(after) == len(rows) and after <= before
        if name == "language_id":
            assert before - after == {i for i in before if not any(c.isalpha() for c in texts[i])}
        elif name == "exact_dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(" ".join(texts[i].split()), i)
            assert after <= set(first.values()) and len(after) >= len(first)
        elif name == "ngram_jaccard":
            told = test_jaccard.brute([(i, texts[i]) for i in sorted(before)])
            assert after == {i for i, n, c in told if i == c or n == 0}
        elif name == "decontaminate":
            assert before - after == {i for i in before if test_contamination.brute(texts[i], bench)[1]}
        else:
            assert after == before and all(r.round_trip for r in rows)
        before = after


def test_run_writes_and_rereads(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert 0 < out.count() < 200 and out.filter("not round_trip").isEmpty()


def test_odd_and_empty_input(spark, sf_dir, odd_docs, no_docs):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(r.doc_id, r.text, r.lang, r.kept, r.n_tokens) for r in odd_docs.collect()]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, step in corpus_pipeline.STAGES:
            docs = step(spark, docs, sf_dir)
        assert docs.count() <= len(rows)


def test_language_stage_decides(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    texts = {r.lang: r.text for r in docs.filter("n_chars > 400").collect()}
    foreign = {
        -1: "Все люди рождаются свободными и равными в своем достоинстве и правах Они наделены разумом и совестью",
        -2: "Minden emberi lény szabadon születik és egyenlő méltósága és joga van Az emberek ésszel és lelkiismerettel bírván",
        -3: "日本国民は正当に選挙された国会における代表者を通じて行動し",
    }
    mixed = " ".join(texts["en"].split()[:40] + texts["de"].split()[:40])
    more = spark.createDataFrame([*((i, t, None) for i, t in foreign.items()), (-4, mixed, None)], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs.union(more), sf_dir).collect()}
    assert not kept & set(foreign) and -4 in kept
    assert {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")} <= kept


def test_language_stage_without_labels(spark, sf_dir):
    rows = [(1, "a clean document", None), (2, "12 34", None), (3, None, None), (4, "", None)]
    held = next(i for i in range(5, 50) if zlib.crc32(str(i).encode()) % 4 == 2)
    for more in ([], [(held, "noch ein text", "de")]):
        docs = spark.createDataFrame(rows + more, "doc_id long, text string, lang string")
        kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, sf_dir).collect()}
        assert kept == {1, *(i for i, _, _ in more)}
