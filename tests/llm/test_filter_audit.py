import random
import re
from collections import Counter
from itertools import permutations

import numpy as np

from eventmill.llm import filter_audit as fa


def brute(docs, labels):
    """(part, order, step) -> counts, by applying the filters one after the other."""
    fails, first = [], {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    good = {i for i, q, _ in labels if q == 1} - {None}
    bad = {i for i, _, x in labels if x == 1} - {None}
    for i, text, part in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        test = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and first[t] < i,
        }
        fails.append((i, part or "", {f for f, x in test.items() if x}))
    out = {}
    for part in {p for _, p, _ in fails}:
        own, shapley = [(i, f) for i, p, f in fails if p == part], Counter()
        for order in permutations("ABCDE"):
            left, gone = list(own), []
            for step, f in enumerate(order, 1):
                removed = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                row = [
                    len(left),
                    len(removed),
                    sum(f in x[1] for x in gone),
                    sum(x[1] == {f} for x in own),
                    sum(x[0] in good for x in removed),
                    sum(x[0] in bad for x in removed),
                ]
                gone += removed
                shapley[f] += len(removed)
                out[part, "".join(order), step] = row
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def check(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = fa.filter_interactions(d, marks).collect()
    assert {(r.part, r.filter_order, r.step): [r[c] for c in fa.COUNTS] for r in got} == brute(docs, labels)
    assert len(got) == 600 * len({p or "" for _, _, p in docs})


def test_random_documents(spark):
    rng = random.Random(5)
    words = ["the", "of", "Upper", "CAPS", "a|b", "x#", "é", "word"] + [f"w{i}" for i in range(90)]
    texts = ["\t \n".join(rng.choices(words[rng.randrange(9) :], k=rng.choice([0, 3, 49, 50, 51, 80]))) for _ in range(40)]
    docs = [(rng.randrange(70), rng.choice(texts), rng.choice(["s1", "s2", "s3"])) for _ in range(120)]
    labels = [(rng.randrange(90), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(100)]
    check(spark, docs, labels)


def test_odd_rows(spark, odd_docs):
    docs = [(r.doc_id, r.text, r.lang) for r in odd_docs.collect()]
    check(spark, docs, [(None, 1, 1), (2, 1, 0), (2, 0, 1), (8, 1, None), (99, 1, 1)])
    # columns named like the operator's own
    clash = odd_docs.selectExpr("*", "1 AS part", "2 AS mask", "3 AS _id", "4 AS _hash", "'s' AS source", "5 AS good")
    marks = spark.createDataFrame([(2, 1, 0, 9)], "doc_id long, quality int, toxic int, part int")
    assert fa.filter_interactions(clash, marks).count() == 600


def test_no_rows(spark, no_docs):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    empty = no_docs.selectExpr("doc_id", "text", "lang AS source")
    assert fa.filter_interactions(empty, marks).count() == 0


def test_removal_step_is_the_first_failing_filter():
    ranks = fa.Ranks(4)
    for o, order in enumerate(ranks.orders):
        for mask in range(16):
            first = next((s for s, f in enumerate(order, 1) if mask >> f & 1), 5)
            assert ranks.step[o, mask] == first
    weights = np.arange(32).reshape(2, 16)
    assert (ranks.scatter(weights).sum(2) == weights.sum(1)[:, None]).all()
