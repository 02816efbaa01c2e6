import re

from eventmill.llm import contamination as C

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(text, items, size=10):
    words = WORD.findall(lower(text))
    hit, found = set(), set()
    for item, t in items:
        w = WORD.findall(lower(t))
        for k in range(max(1, len(w) - size + 1)) if w else ():
            window = w[k : k + size]
            for i in range(len(words) - len(window) + 1):
                if words[i : i + len(window)] == window:
                    hit |= set(range(i, i + len(window)))
                    found |= {item} - {None}
    return len(words), len(hit), sorted(found)


def tables(spark, odd_docs):
    q = "One two Three, four five six seven eight nine ten eleven twelve"
    docs = [
        (20, "zero one two three four five SIX seven eight nine ten eleven twelve thirteen one two"),
        (21, "xone two three four five six seven eight nine ten elevenx"),
        (22, "a b short-item a b short item short item item"),
        (23, "Ä ä one  two\nthree four. five six seven eight nine ten"),
    ]
    docs = spark.createDataFrame(docs, "doc_id long, text string").unionByName(odd_docs, allowMissingColumns=True)
    items = [(1, q), (1, q), (2, "Short item"), (3, None), (4, ""), (None, "the same text"), (5, "!!"), (10, "short")]
    return docs, spark.createDataFrame(items, "item_id long, text string"), items


def check(got, docs, items):
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    want = [(i, *brute(t, [(None if k is None else str(k), x) for k, x in items])) for i, t in texts]
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in got), key=str) == sorted(want, key=str)


def test_against_brute_force(spark, odd_docs):
    docs, bench, items = tables(spark, odd_docs)
    got = C.find_contamination(docs, bench).collect()
    check(got, docs, items)
    by = {r.doc_id: r for r in got}
    text = next(r.text for r in docs.collect() if r.doc_id == 20)
    assert [tuple(s) for s in by[20].spans] == [(5, text.index("twelve") + 6)]
    text = "Ä ä one  two\nthree four. five six seven eight nine ten"
    assert [text[s.start : s.end] for s in by[23].spans] == ["one  two\nthree four. five six seven eight nine ten"]


def test_blocks_of_items_give_the_same(spark, odd_docs):
    docs, bench, items = tables(spark, odd_docs)
    check(C.find_contamination(docs, bench, block_bytes=8).collect(), docs, items)


def test_drop(spark, odd_docs):
    docs, bench, _ = tables(spark, odd_docs)
    clean = C.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    ids = {r.doc_id for r in clean.collect()}
    assert ids.isdisjoint({1, 2, 10, 20, 22, 23}) and {21, 5, 6, 7, 8, 9, 11, 12} <= ids


def test_empty(no_docs, spark, odd_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert C.find_contamination(no_docs, none).count() == 0
    assert C.find_contamination(odd_docs, none).filter("n_hit > 0").count() == 0
