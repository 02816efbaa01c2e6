import math
import random
import zlib
from collections import Counter

import numpy as np

from eventmill.llm import suffix_tree as S


def tokens(text):
    return (text or "").encode().lower().split() + [b""]


def test_base_scores_against_brute_force(odd_docs):
    docs = {i: r for i, r in enumerate(odd_docs.collect())}
    held = {i: zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 == 2 for i, r in docs.items()}
    count = Counter(t for i, r in docs.items() if not held[i] for t in tokens(r.text))
    n, v = sum(count.values()), len(count)
    want = []
    for i, r in docs.items():
        base = sum(math.log10((count[t] + 1) / (n + v + 1)) for t in tokens(r.text))
        known = sum(count[t] > 0 for t in tokens(r.text))
        want.append((r.doc_id, held[i], len(tokens(r.text)), known, n, round(base, 5)))
    got = S.score_corpus(odd_docs).collect()
    assert sorted(((*list(r)[:5], round(r.base_score, 5)) for r in got), key=str) == sorted(want, key=str)
    assert all(r.score <= 0 for r in got)


def corpus(spark, n=400):
    """Word pairs that follow each other more often than chance."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        text = [rng.choice(words)]
        for _ in range(rng.randint(5, 40)):
            k = int(text[-1][1:])
            text.append(words[(k * 7 + 3) % 60] if rng.random() < 0.6 else rng.choice(words))
        if i % 9 == 0:
            text.append(f"rare{i}")
        rows.append((i, " ".join(text)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_tree_predicts_held_out_texts_and_sums_to_one(spark):
    docs = corpus(spark)
    held = [r for r in S.score_corpus(docs).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.3 * sum(r.n_tokens for r in held)
    tree, _ = S.fit(docs.select("text"))
    places = np.arange(tree.width)
    outside = 1 - np.exp(tree.root).sum()  # words that aren't in the dictionary
    for state in np.unique(tree.state[tree.state >= 0]):
        mass = np.exp(tree.log_prob(np.full(len(places), state), places)).sum()
        assert abs(mass + math.exp(tree.to_root[state]) * outside - 1) < 1e-9


def test_longest_kept_context_scores(spark):
    tree, _ = S.fit(corpus(spark).select("text"))
    ids = tree.encode([[b"w1", b"w10", b"w13"], [b"w1"]])
    state = tree.states(ids)
    assert state[0] == -1 and state[4] == -1  # nothing reaches over the end of a text
    kept = tree.contexts[0][(tree.state[: len(tree.contexts[0])] >= 0)]
    assert (state[1] >= 0) == (ids[0] in kept)


def test_words_outside_the_dictionary_score_the_same(spark):
    docs = corpus(spark)
    whole, words = S.fit(docs.select("text"))
    part, _ = S.fit(docs.select("text"), head_share=0.02, state_share=0.02, next_share=0.02)
    assert 0 < len(part.head) < len(whole.head)
    a, b = ({r.doc_id: r for r in S.score_texts(docs, t, words).collect()} for t in (whole, part))
    assert all(abs(a[i].base_score - b[i].base_score) < 1e-8 and a[i].n_known == b[i].n_known for i in a)


def test_empty(no_docs):
    assert S.score_corpus(no_docs).count() == 0


def test_buckets_score_as_the_whole_tree(spark, monkeypatch):
    """Also where words and pairs of words have several buckets and most words aren't in the dictionary."""
    rng = random.Random(5)
    phrases = ["a b c d", "x b c e", "p q c f", "a b g", "rare c h"]
    texts = [
        " ".join(rng.choice(phrases) if rng.random() < 0.8 else f"o{rng.randrange(300)}" for _ in range(rng.randint(0, 30)))
        for _ in range(200)
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").cache()
    training = ~S.is_held_out(S.F.col("doc_id"))
    tree, words = S.fit(docs.filter(training).select("text"), head_share=0.0)
    kept = tree.state[tree.state == np.arange(len(tree.state))]
    assert len(np.unique(np.searchsorted(tree.first, kept, "right"))) == 3
    want = {r.doc_id: r.score for r in S.score_texts(docs, tree, words).collect()}
    gains = S._context_gains
    for head_share, bucket in ((S.HEAD_SHARE, S.BUCKET), (0.02, 50), (0.02, 5)):
        monkeypatch.setattr(S, "_context_gains", lambda *a, bucket=bucket: gains(*a, bucket))
        part, _ = S.fit(docs.filter(training).select("text"), depth=0, head_share=head_share)
        got = {r.doc_id: r.score for r in S.score_texts(docs, part, words, training=training).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-8 for i in want)


def test_rare_context_of_a_large_corpus_is_kept(spark):
    """Twelve occurrences among two million tokens: under 1/100,000."""
    filler = " ".join(f"f{i * i % 997}" for i in range(200_000))
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 != 2]
    out = next(i for i in range(200) if i not in ids)
    rows = [(i, filler) for i in ids[:10]] + [(i, "red kite over green hills") for i in ids[10:22]]
    docs = spark.createDataFrame([*rows, (out, "red kite over green hills")], "doc_id long, text string")
    (row,) = [r for r in S.score_corpus(docs).collect() if r.held_out]
    assert row.train_tokens > 2_000_000 and row.score > row.base_score + 10
