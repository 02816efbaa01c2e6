import hashlib
import re

from pyspark.sql import functions as F

from eventmill.llm import dedup


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, seen = min(known, default=None), False
        for i in ids:
            kept = i == keep and not seen
            seen = seen or kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_odd_rows(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = [tuple(r) for r in dedup.exact_duplicates(odd_docs).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_texts_under_one_hash_stay_apart(spark, odd_docs):
    weak = lambda text: F.unhex(F.lpad(F.hex(F.length(text) % 3), 32, "0"))
    got = [tuple(r) for r in dedup.exact_duplicates(odd_docs, content_hash=weak).collect()]
    assert sorted(got, key=str) == brute([(r.doc_id, r.text) for r in odd_docs.collect()])


def test_drop_keeps_one_whole_row(odd_docs):
    kept = dedup.drop_exact_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in kept.collect()]
    assert len(norm) == len(set(norm)) == 7
    assert {r.doc_id for r in kept.collect()} == {1, 5, 7, 8, 10, 11, 12}


def test_repeated_row_is_dropped(spark):
    docs = spark.createDataFrame([(3, "a"), (3, "a"), (4, "b")], "doc_id long, text string")
    assert sorted(map(tuple, dedup.drop_exact_duplicates(docs).collect())) == [(3, "a"), (4, "b")]


def test_empty(no_docs):
    assert dedup.exact_duplicates(no_docs).count() == 0
    assert dedup.drop_exact_duplicates(no_docs).count() == 0
