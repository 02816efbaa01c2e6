import random
import tracemalloc
from itertools import product

import numpy as np
import pytest

from eventmill.llm import toxicity as tx

WORDS = "the river flows past a quiet village where people walk along green fields and talk about bread wine weather".split()
BAD = ["idiot", "moron", "stupid", "scum"]


def prose(rng, n=40):
    return [rng.choice(WORDS) for _ in range(n)]


def corpus(seed=7, n=400):
    rng, docs, labels = random.Random(seed), [], []
    for i in range(n):
        words, bad = prose(rng), i % 4 == 0
        if bad:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return docs, labels


@pytest.fixture(scope="module")
def model(spark):
    from eventmill.llm.queries import reachable

    reachable(spark)
    docs, labels = corpus()
    return tx.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))


def scored(spark, model, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in tx.score_texts(rows, model).collect()}


HIDDEN = ["1d10t", "i d i o t", "i.d.i.o.t", "idiooooot", "!diot", "id*ot", "m0r0n", "m-o-r-o-n", "$tup1d", "stuuupid", "5cum", "s c u m", "ÍDÍÖT", "St*pid"]


@pytest.mark.parametrize("hidden", HIDDEN)
def test_hidden_words_are_restored_and_found(spark, model, hidden):
    rng = random.Random(hidden)
    words = prose(rng)
    plain = " ".join(words)
    words[20:20] = [hidden, "and", hidden]
    text = " ".join(words)
    assert any(w in tx.restore_text(text, model.log).lower().split() for w in BAD) or not hidden.isascii()
    got = scored(spark, model, [text, plain])
    assert (got[0].predicted, got[1].predicted) == (1, 0)


def test_held_out(spark, model):
    docs, labels = corpus(seed=8)
    got = scored(spark, model, [t for _, t in docs])
    assert sum(got[i].predicted == y for i, y in labels) >= 0.99 * len(labels)


def test_clean_text_stays(model):
    text = "Call 555-0199 at 10.30, the quiet village; a a a walk: 3 fields!! (green)"
    assert tx.restore_text(text, model.log).split()[1:4] == ["555-0199", "at", "10.30,"]
    assert tx.restore_text(None, model.log) == ""
    assert tx.restore_text("the river flows", model.log) == "the river flows"


def brute(raw, log):
    """Best restored text of all ways through the lattice, by score of the whole."""
    best = (-np.inf, None)
    for way in product(*[tx.edges_of(raw, i) for i in range(len(raw))]):
        out, total, state = "", 0.0, 0
        for emitted, cost in way:
            total += cost
            if not emitted:
                continue
            k = tx.class_of(emitted)
            if k == tx.EDGE:
                total += log[state][tx.EDGE] if state else 0.0
                state = 0
            else:
                total += log[state][k]
                state = (state % tx.CLASSES**2) * tx.CLASSES + k
            out += emitted
        total += log[state][tx.EDGE] if state else 0.0
        if total > best[0]:
            best = total, out
    return best[1].split()


def test_viterbi_is_the_best_of_all_ways(model):
    rng = random.Random(2)
    for raw in ["1d1ot", "iidiott", "s.c um", "m00r0n", "a b", "5-c*um"] + ["".join(rng.choices("i1d0otts5 .", k=7)) for _ in range(25)]:
        assert tx.restore(raw, model.log).split() == brute(raw, model.log), raw


def test_counts_are_those_of_all_texts(spark):
    docs, _ = corpus(n=30)
    log = tx.character_model(spark.createDataFrame([*docs, (None, None), (9, "")], "doc_id long, text string").repartition(3)).log
    total = np.zeros(tx.CLASSES**tx.ORDER, np.int64)
    for _, t in docs:
        for w in t.split():
            x = [0, 0, 0, *[tx.class_of(c) for c in w], 0]
            for k in range(3, len(x)):
                total[((x[k - 3] * 28 + x[k - 2]) * 28 + x[k - 1]) * 28 + x[k]] += 1
    assert np.allclose(log, tx.CharacterModel(total).log)
    assert np.allclose(np.exp(log).sum(1), 1, atol=1e-4)


def test_grams_by_brute_force():
    words = ["idiot", "a", "é", "日本語", "ab"]
    word, bucket = tx.Grams(words).of()
    alone = {}
    for i, w in enumerate(words):
        m = f"^{w}$"
        want = {m[k : k + n] for n in tx.GRAMS for k in range(len(m) - n + 1)}
        assert (word == i).sum() == len(want)
        for b in bucket[word == i]:
            alone.setdefault(int(b), set()).add(i)
    assert [len(tx.Grams([w]).of()[0]) for w in words] == [(word == i).sum() for i in range(len(words))]


def test_copied_text_does_not_teach_its_words(spark):
    """A third of the rows is one toxic text; its harmless words stay harmless."""
    docs, labels = corpus()
    copy = "remarkable lantern orchestra umbrella idiot velvet cathedral"
    docs += [(1000 + i, copy + (" end" if i % 2 else "")) for i in range(200)]
    labels += [(1000 + i, 1) for i in range(200)]
    docs += [(5000, "remarkable lantern orchestra umbrella velvet cathedral"), (5001, copy)]
    d, m = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in tx.toxicity(d, m).collect()}
    assert (got[5000].predicted, got[5001].predicted) == (0, 1)


def test_odd_rows(spark, odd_docs, no_docs, model):
    clash = odd_docs.selectExpr("*", "1 AS score", "2 AS _id", "3 AS _y", "4 AS t", "5 AS _r", "6 AS toxic")
    marks = spark.createDataFrame(
        [(1, 1, 5), (1, 0, 5), (None, 1, 5), (2, None, 5), (8, 0, 5), (9, 0, 5), (5, 0, 5), (99, 1, 5)], "doc_id long, toxic int, t int"
    )
    got = tx.toxicity(clash, marks).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert len(by[2]) == 1 and by[5] == by[6]
    held = {r.doc_id for r in got if r.held_out}
    import zlib

    assert held == {i for i in by if i is not None and zlib.crc32(str(i).encode()) % 5 == 0}
    assert tx.toxicity(no_docs, marks).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in tx.toxicity(odd_docs, none).collect()} == {0.0}


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = corpus(n=200)
    import zlib

    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    a, b = (sorted(tx.toxicity(d, spark.createDataFrame(x, "doc_id long, toxic int")).collect()) for x in (labels, flipped))
    assert a == b


def test_restored_texts(spark, model):
    docs = spark.createDataFrame([(1, "you m0r0n, walk"), (2, None)], "doc_id long, text string")
    got = dict(map(tuple, tx.restored(docs, model).collect()))
    assert got[1].split()[1] == "moron" and got[2] == ""


def test_training_holds_no_python_object_per_feature(spark):
    """Hundreds of features in each of 1,200 documents: the driver's Python holds them as arrays of small numbers."""
    rng, docs, labels = random.Random(3), [], []
    letters = "abcdefghijklmnopqrstuvwxyz"
    telling = ["".join(rng.choices(letters, k=9)) for _ in range(400)]
    for i in range(1200):
        words = prose(rng) if i % 2 else rng.sample(telling, 80)
        docs.append((i, " ".join(words)))
        labels.append((i, 1 - i % 2))
    rows = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    tracemalloc.start()
    try:
        trained = tx.train(*rows)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert trained.learned and (trained.place >= 0).sum() > 5000
    assert peak < 45e6, peak


def test_regression_adds_up_pieces_as_one_sum(monkeypatch):
    rng = np.random.default_rng(4)
    lengths = rng.integers(0, 9, 300)
    column = rng.integers(0, 40, lengths.sum()).astype(np.int32)
    y = (rng.random(300) < 0.4).astype(float)
    weights, constant = tx.fit_logistic(lengths, column, y, 40)
    monkeypatch.setattr(tx, "FIT_PIECE", 7)
    again, same = tx.fit_logistic(lengths, column, y, 40)
    assert (weights == again).all() and constant == same
    p = 1 / (1 + np.exp(-(np.bincount(np.repeat(np.arange(300), lengths), weights[column], 300) + constant)))
    assert abs((p - y).sum()) < 0.05  # the slope by the constant is zero at the optimum


def spelled(word, log):
    """Log probability of a word, step by step."""
    state, total = 0, 0.0
    for c in word:
        k = tx.class_of(c)
        total += log[state][k]
        state = (state % (tx.CLASSES * tx.CLASSES)) * tx.CLASSES + k
    return total + log[state][tx.EDGE]


def test_a_doubled_letter_is_judged_by_the_steps_that_see_it():
    class Log(list):
        reads = 0

        def __getitem__(self, state):
            Log.reads += 1
            return super().__getitem__(state)

    rng = np.random.default_rng(4)
    log = Log((np.log(rng.dirichlet(np.full(tx.CLASSES, 0.2), tx.CLASSES**3) + 1e-9)).tolist())
    word = random.Random(4)
    decided = set()
    for n in range(2, 40):
        for _ in range(20):
            plain = "".join(word.sample("abcdefghijklmnopqrstuvwxyz\u4e16", min(n, 27)))
            at = word.randrange(len(plain))
            doubled = plain[:at] + plain[at] + plain[at:]
            Log.reads = 0
            got = tx.words_of(doubled, log)
            assert Log.reads <= 5
            want = spelled(plain, log) + tx.AGAIN > spelled(doubled, log)
            assert got == [plain if want else doubled]
            decided.add(want)
    assert decided == {True, False}


def by_features(model, codes, text):
    """Score of a text from the set of its features."""
    found = np.isin(codes[0], tx.features(text, model.log.tolist()))
    return 1 / (1 + np.exp(-np.clip(model.constant + codes[1][found].sum(), -30, 30)))


def small_model(seed=9, n=300):
    rng = np.random.default_rng(seed)
    log = np.log(rng.dirichlet(np.ones(tx.CLASSES), tx.CLASSES**3)).astype(np.float32)
    grams = np.unique(tx.Grams(WORDS + BAD).of()[1])
    codes = np.unique(rng.choice(grams, n) * tx.LEVELS + rng.integers(0, tx.LEVELS, n))
    weights = rng.normal(size=len(codes))
    return tx.Model.of(log, codes, weights, -0.5, 0.1), (codes, weights)


@pytest.mark.parametrize("known, piece", [(600_000, 1 << 20), (30, 200), (600_000, 1)])
def test_texts_of_a_block_score_by_their_own_features(monkeypatch, known, piece):
    monkeypatch.setattr(tx, "KNOWN_WORDS", known)
    monkeypatch.setattr(tx, "PIECE_CHARS", piece)
    rng = random.Random(3)
    model, codes = small_model()
    texts = [" ".join(rng.choice([w, w.upper(), f"({w},"]) for w in rng.choices(WORDS + BAD, k=rng.randrange(0, 40))) for _ in range(60)]
    texts += [None, "", " \n", "42 !!", "zzyzx", texts[0], "idiot IDIOT idiot. (idiot)"]
    scorer = tx.Scorer(model)
    for _ in range(2):
        assert list(scorer.scores(texts)) == pytest.approx([by_features(model, codes, t or "") for t in texts], abs=1e-12)
    assert list(scorer.scores([])) == []
    nothing = tx.Scorer(tx.Model.nothing(model.log, 0.25))
    assert list(nothing.scores(texts)) == [0.25] * len(texts)


def test_met_tokens_hold_no_python_object_per_feature():
    rng = random.Random(12)
    model, _ = small_model(n=3000)
    tokens = {"".join(rng.choices(["idio", "stup", "riv", "vill", "peop", "wea", "ron", "et"], k=4)) + str(i % 2 * "s") for i in range(40_000)}
    tracemalloc.start()
    try:
        scorer = tx.Scorer(model)
        before = tracemalloc.get_traced_memory()[0]
        scorer.learn(tokens)
        held = tracemalloc.get_traced_memory()[0] - before
    finally:
        tracemalloc.stop()
    assert held < 330 * len(tokens), held / len(tokens)
