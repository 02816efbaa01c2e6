import functools
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from eventmill.llm import token_alignment as ta


@pytest.fixture(scope="module")
def v():
    return ta.load(ta.TOKENIZER_A, ta.TOKENIZER_B)


@functools.cache
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(ta.TOKENIZER_A)
    t.encode_special_tokens = True
    return t


def plain(text):
    """Ids by the file's own library."""
    return library().encode(text, add_special_tokens=False).ids


def test_engines_agree(v):
    chars = [chr(c) for c in range(0x250)]
    texts = [f"a{c}b {c}{c} 1{c}2  {c} x{c}" for c in chars] + [f" don't{c}'ll it'S {c}\n\n{c} " for c in chars]
    rng = random.Random(4)
    texts += ["".join(rng.choices(chars[:256] + list(" \n\t'stre") * 30, k=200)) for _ in range(200)]
    texts += ["a" * 5000, " " * 5000, "日本 \u2003 x", "<|endoftext|>"]
    assert v.encode_a(texts) == [plain(t) for t in texts]
    assert ta.ranked(ta.TOKENIZER_A, ta.byte_alphabet()) is not None


def spans(ids, table):
    out, at = [], 0
    for i in ids:
        out.append((at, at := at + len(table[i])))
    return out


def brute_groups(x, y, v):
    """Groups by the byte offsets where tokens of both sides end."""
    ends = {e for _, e in spans(x, v.a)} & {e for _, e in spans(y, v.b)}
    groups, at = [], 0
    for cut in sorted(ends):
        inside = lambda ids, table: [i for i, (s, e) in zip(ids, spans(ids, table), strict=True) if at <= s and e <= cut]  # noqa: B023, E731
        groups.append((inside(x, v.a), inside(y, v.b)))
        at = cut
    return groups


def brute(rows, v):
    """The query's rows, token by token, with plain calls of the tokenizers."""
    tokens, links = [], Counter()
    for _, text in rows:
        x, y = ([], []) if not text else (plain(" " + text), v.encode_b([text])[0])
        if b"".join(v.a[i] for i in x) != (" " + (text or "")).encode() or b"".join(v.b[i] for i in y) != (" " + (text or "")).encode():
            x, y = [], []
        own = [(i, j) for i, (_, e) in zip(x, spans(x, v.a), strict=True) for j, (_, f) in zip(y, spans(y, v.b), strict=True) if e == f]
        links.update(own)
        tokens.append((x, y, own))
    most = {}
    for (_, j), n in links.items():
        most[j] = max(n, most.get(j, 0))
    out = []
    for (i, _), (x, y, own) in zip(rows, tokens, strict=True):
        groups = brute_groups(x, y, v)
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append(
            (
                i, len(x), len(y), len(groups), len(own), sum(links[p] == most[p[1]] for p in own),
                sum(links[p] for p in own), hashlib.sha256(text.encode()).hexdigest() if x else "",
            )
        )
    return sorted(out, key=str)


TEXTS = [
    None, "", " ", "  two  spaces ", "a", "The thonble ernd, and the onnd.", "Straße über ß élève ñandú", "日本語のテキスト 🙂🙂 №",
    "<|endoftext|> and <s> </s> <unk> <0x41> plain", "a▁b", "tab\tand\nnewline\r\n", "x" * 300, "1234567890 " * 20, "\x00\x01 null",
    "the the the the", "the the the the",
]


def test_brute_force(spark, v):
    rng = random.Random(3)
    letters = "abcdefghij éß日\n.,!▁ 🙂" * 2 + "   the of ing"
    rows = list(enumerate(TEXTS + ["".join(rng.choices(letters, k=rng.randrange(1, 60))) for _ in range(40)]))
    got = ta.cross_alignment(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, v)


def test_unfaithful_texts_have_no_tokens(spark, v):
    got = {r.doc_id: r for r in ta.cross_alignment(spark.createDataFrame([(1, "a▁b"), (2, "a b"), (3, None)], "doc_id long, text string")).collect()}
    assert (got[1].n_a, got[1].n_links, got[1].groups_sha256) == (0, 0, "")
    assert (got[3].n_b, got[3].count_sum, got[3].groups_sha256) == (0, 0, "")
    assert got[2].n_a > 0


def test_whole_alignment(spark, v):
    rows = list(enumerate(TEXTS))
    got = ta.align_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        x, y = [i for g in r.groups for i in g.a], [i for g in r.groups for i in g.b]
        assert [(g.a, g.b) for g in r.groups] == brute_groups(x, y, v)
        p, q = spans(x, v.a), spans(y, v.b)
        shared = {(i, j) for i, (s, e) in enumerate(p) for j, (t, f) in enumerate(q) if s < f and t < e}
        assert {(o.a, o.b) for o in r.overlaps} == shared and len(r.overlaps) == len(shared)


def test_coalesce_any_intervals():
    rng = np.random.default_rng(1)
    for _ in range(50):
        start = rng.integers(0, 40, 12)
        end = start + rng.integers(1, 8, 12)
        order, group = ta.coalesce(start, end)
        of = dict(zip(order.tolist(), group.tolist(), strict=True))
        inside = [any(s < x < e for s, e in zip(start, end, strict=True)) for x in range(60)]
        for i in range(12):
            for j in range(12):
                lo, hi = sorted((start[i], start[j]))
                assert (of[i] == of[j]) == all(inside[lo + 1 : hi + 1])


def test_odd_rows(spark, odd_docs, no_docs, v):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect() if len(r.text or "") < 1000]
    clash = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS pair", "2 AS n_a", "3 AS _text")
    assert sorted(map(tuple, ta.cross_alignment(clash).collect()), key=str) == brute(rows, v)
    long = {r.doc_id: r for r in ta.cross_alignment(odd_docs.filter("doc_id IN (8, 9)")).collect()}
    assert long[8].n_a > 100_000 and long[8][1:] == long[9][1:]
    assert ta.cross_alignment(no_docs).count() == 0


def test_links_are_linkable_pairs(v):
    assert len(v.pairs) < 4 * (len(v.a) + len(v.b)) and (np.diff(v.pairs) > 0).all()
