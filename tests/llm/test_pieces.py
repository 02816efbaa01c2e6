import itertools
import random

import numpy as np
import pytest
import sentencepiece

from eventmill.llm import pieces as P

SOME = ["a", "the", " ", "  ", "\n", "\t", "é", "日", "\U0001f642", "\r", "̀", "er", "in", "0", "=", "(", ";", "{", "x" * 9, "\x00", "<s>", "²."]


@pytest.fixture(scope="module")
def vocabulary():
    return P.load()


def test_ids_are_the_librarys(vocabulary):
    library = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    encoder, rng = P.Encoder(vocabulary), random.Random(3)
    texts = ["", " ", "".join(rng.choice("abcdefgh01") for _ in range(20_000)), "a" * 5000]
    texts += ["".join(rng.choices(SOME, k=rng.randint(0, 30))) for _ in range(500)]
    for text in texts:
        ids = np.frombuffer(encoder.encode(text), np.int32).tolist()
        assert ids == library.encode(text), text
        assert P.decode(ids, vocabulary) == text


def test_blank_marks_survive(vocabulary):
    text = "▁x ▁▁ a▁"
    ids = np.frombuffer(P.Encoder(vocabulary).encode(text), np.int32).tolist()
    assert P.decode(ids, vocabulary) == text


def test_window_stays_bounded(vocabulary):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdeinrst") for _ in range(5000))
    commits = list(P.stream(text, vocabulary, {}))
    assert len(commits) > 20
    assert max(sum(len(vocabulary.name(i)) for i in c) for c in commits) <= 4 * vocabulary.max_len


def test_unigram_is_the_best_path():
    rng = random.Random(5)
    kinds = {"".join(rng.choices("ab▁", k=rng.randint(2, 4))) for _ in range(12)} | {"a", "b"}
    v = P.Vocabulary([("<unk>", 0.0, P.UNKNOWN)] + [(k, -rng.random() * 9, P.NORMAL) for k in sorted(kinds)], bpe=False)

    def paths(s):
        if not s:
            yield 0.0
        for n in range(1, min(len(s), 4) + 1):
            if s[:n] in v.ids or n == 1:
                yield from (v.score.get(s[:n], v.floor) + x for x in paths(s[n:]))

    for _ in range(60):
        text = "".join(rng.choices("ab▁c", k=rng.randint(1, 9)))
        ids = list(itertools.chain(*P.stream(text, v, {})))
        names = [v.name(i) if i else None for i in ids]
        got = sum(v.score[n] if n else v.floor for n in names)
        assert abs(got - max(paths(text))) < 1e-9


def test_odd_rows(odd_docs, no_docs):
    coded = P.encode_texts(odd_docs, ["doc_id", "lang"])
    rows = coded.collect()
    assert len(rows) == odd_docs.count() and all(r.round_trip and r.n_ids == len(r.ids) for r in rows)
    back = P.decode_ids(coded, ["doc_id", "lang"])
    want = sorted(((r.doc_id, r.text or "") for r in odd_docs.collect()), key=str)
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=str) == want
    assert P.encode_texts(no_docs).count() == 0
