import glob
import os
import random
import re
import tempfile

import pytest

from eventmill import session
from eventmill.llm import jaccard as J
from eventmill.llm.components import components


def shingle_sets(texts):
    out = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute(rows):
    sets = shingle_sets([t for _, t in rows])
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[root(i)] = root(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[root(i)] = min(low.get(root(i), k), k)
    return sorted(((k, len(sets[i]), low.get(root(i)) if sets[i] else k) for i, (k, _) in enumerate(rows)), key=str)


def corpus():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    passage = rng.choices(words, k=60)
    rows = []
    for _ in range(25):  # groups of copies that drift apart, so that links chain
        text = rng.choices(words, k=rng.randint(6, 120))
        for _ in range(rng.randint(1, 9)):
            rows.append(" ".join(text))
            text = list(text)
            for _ in range(rng.randint(0, 1 + len(text) // 60)):
                text[rng.randrange(len(text))] = rng.choice(words)
    base = rng.choices(words, k=100)
    for _ in range(60):  # one large group around one text
        text = list(base)
        text[rng.randrange(100)] = rng.choice(words)
        rows.append(" ".join(text))
    for _ in range(60):  # texts that only share a passage
        rows.append(" ".join(rng.choices(words, k=rng.randint(20, 60)) + passage))
    for _ in range(30):  # mostly passage
        rows.append(" ".join(passage + rng.choices(words, k=rng.randint(8, 16))))
    rows += ["A b c", "a B\tc", "a b", None, None, "", " \n", "x", rows[0].upper(), rows[0]]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    out = list(zip(ids, rows, strict=True))
    return out + [(None, rows[3]), (None, "only here with no id at all"), out[5], (out[6][0], "another text under a known id now")]


@pytest.mark.parametrize("few", [4096, 30, 0])
def test_against_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(J, "FEW_PAIRS", few)
    rows = corpus()
    got = J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def hub(copies, seed=8):
    """Copies of one text, with up to 24 words replaced: links lead to the origin, to each other, or nowhere."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(150)]
    rows = [" ".join(base)]
    drifted = base
    for k in range(copies):
        text = list(drifted if k % 10 == 9 else base)
        for _ in range(rng.randint(1, 3) if k % 10 == 9 else rng.randint(1, 24)):
            text[rng.randrange(150)] = rng.choice(words)
        if k % 10 == 9:
            drifted = text  # a chain away from the origin
        rows.append(" ".join(text))
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return list(zip(ids, rows, strict=True))


@pytest.mark.parametrize("few", [4096, 0])
def test_hub_against_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(J, "FEW_PAIRS", few)
    measured = []
    measure = J._Join.measure

    def counted(self, pairs):
        measured.append(pairs.count())
        return measure(self, pairs)

    monkeypatch.setattr(J._Join, "measure", counted)
    rows = hub(900)
    want = brute(rows)
    components = {c for _, _, c in want}
    assert 50 < len(components) < 800  # texts near the origin, chains, and texts that link with nothing
    got = J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == want
    # all 900 copies share cells: far fewer pairs are measured than texts outside the hub's component times all
    assert sum(measured) < 12 * len(rows)


def test_keep_one(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string")
    kept = J.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    want = {(i, c) for i, n, c in brute(rows)}
    ids = [r.doc_id for r in kept.collect()]
    assert set(ids) - {None} >= {c for i, c in want if i == c and i is not None} and len(ids) < len(rows)


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted((tuple(r) for r in J.near_duplicates(odd_docs).collect()), key=str) == brute(rows)
    assert J.near_duplicates(no_docs).count() == 0


def test_components(spark):
    rng = random.Random(7)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(200, 200), (5, 5), (None, 3), (41, 40)]
    links += [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(30)]
    up = {}

    def root(i):
        up.setdefault(i, i)
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        if a is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: root(n) for n in up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shuffle_files_go_with_their_step(spark):
    """The driver may not collect its garbage for long, and until then steps must not pile up their files."""
    root = spark.sparkContext.getConf().get("spark.local.dir", os.environ.get("SPARK_LOCAL_DIRS") or tempfile.gettempdir())

    def files():
        return set(glob.glob(f"{root}/blockmgr-*/*/shuffle_*.data"))

    rng = random.Random(21)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(200)]
    texts += [f"{t} more" for t in texts[:100]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before, staged = files(), []
    real = session.shared_dir

    def counted(*args):
        staged.append(len(files() - before))  # what the steps so far have left
        return real(*args)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(session, "shared_dir", counted)
        rows = J.near_duplicates(docs)
    assert rows.filter("component_id < doc_id").count() == 100
    assert len(staged) > 8
    assert max(staged) <= 3, staged
