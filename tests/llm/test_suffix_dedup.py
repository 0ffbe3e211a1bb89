import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hitlake.llm import suffix_dedup as S


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=80) | st.text(alphabet="ab", min_size=1, max_size=80).map(str.encode))
def test_suffix_array_and_prefixes(text):
    order = S.suffix_array(np.frombuffer(text, np.uint8))
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    lcp = S.common_prefixes(text, order)
    for i in range(1, len(text)):
        a, b = text[order[i - 1] :], text[order[i] :]
        assert lcp[i] == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def brute(texts, length):
    count = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            count[t[i : i + length]] = count.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


def check(df, **how):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in df.select("doc_id", "text").collect()]
    want = sorted((str(d), *w) for (d, _), w in zip(rows, brute([t for _, t in rows], how.get("length", 400))))
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in S.remove_repeats(df, **how).collect())
    assert got == want
    return sum(r[2] for r in want)


@pytest.mark.parametrize("shard_extracts", [1, 2048])
def test_real_documents(small, shard_extracts):
    assert check(small, shard_extracts=shard_extracts) > 0


def test_odd_documents(odd, none):
    assert check(odd) > 0
    assert S.remove_repeats(none).collect() == []


@pytest.mark.parametrize("shard_extracts", [1, 3, 2048])
def test_common_passage_in_different_surroundings(spark, shard_extracts):
    """One passage in many documents, also twice in one, and texts of one repeated byte."""
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choices("abcdefghij é", k=n))
    passage = noise(70)
    texts = [noise(rng.randint(0, 90)) + passage[rng.randint(0, 8) :] + noise(rng.randint(0, 60)) for _ in range(60)] + ["x" * 90, passage + "yy" + passage, "x" * 39, "x" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert check(df, length=40, gram=8, shard_extracts=shard_extracts) > 0


def test_kept_text(spark):
    text = "".join(random.Random(5).choices("abcdefgh", k=500))
    df = spark.createDataFrame([(1, "head " + text), (2, text + " tail")], "doc_id long, text string")
    kept = {r["doc_id"]: bytes(r["kept"]) for r in S.remove_repeats(df, keep_text=True).collect()}
    assert kept == {1: b"head ", 2: b" tail"}


def test_long_document_is_hashed_in_segments(monkeypatch):
    data = np.frombuffer(bytes(random.Random(6).choices(b"abcd", k=5000)), np.uint8)
    whole = S.Anchors(100, 20, 60).scan(data)
    monkeypatch.setattr(S, "SEGMENT", 700)
    parts = S.Anchors(100, 20, 60).scan(data)
    expand = lambda e: np.repeat(e[0], e[2])
    assert (expand(whole[0]) == expand(parts[0])).all() and whole[0][2].sum() == parts[0][2].sum() == 4901
    assert all((a == b).all() for a, b in zip(whole[1], parts[1]))


def test_shared_passages_are_reported(spark, none):
    """Passages of 51 to 60 words that two documents share, below the length that is removed; other documents show none."""
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choices("abcdefghijklm", k=rng.randint(2, 9))) for _ in range(n))
    rows = []
    for i in range(40):
        passage = words(51 + i % 10)
        rows += [(100 + i, f"{words(90)} {passage} {words(70)}"), (200 + i, f"{words(40)} {passage} {words(120)}"), (300 + i, words(200))]
    rows += [(400, words(300))] * 2 + [(401, None), (402, "short")]
    got = [(r["doc_id"], r["n_shared"], r["n_removed"], r["n_bytes"]) for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sum(n > 0 for d, n, _, _ in got if 100 <= d < 300) >= 72 and all(n == 0 for d, n, _, _ in got if 300 <= d < 400 or d > 400)
    assert all(0 < n <= size == gone for d, n, gone, size in got if d == 400)
    assert all(n <= 450 for d, n, _, _ in got if d < 300)


def brute_shared(texts, length=224, gram=64):
    """By the definition, one window after the other; hashes of the module, as the choice of representatives is theirs."""
    marks, count = [], {}
    for t in texts:
        h = S.Anchors(400, gram, length).hashes(np.frombuffer(t, np.uint8)) if len(t) >= gram else []
        w = length - gram + 1
        at = sorted({min(range(i, i + w), key=lambda k: (int(h[k]) >> 22, k)) for i in range(len(t) - length + 1)})
        pairs = [(t[a : a + gram], t[b : b + gram], b - a) for a, b in zip(at, at[1:])]
        marks.append(pairs)
        for p in pairs:
            count[p] = count.get(p, 0) + 1
    return [sum(p[2] for p in pairs if count[p] > 1) for pairs in marks]


def test_shared_against_brute_force(small):
    rows = [(r["doc_id"], (r["text"] or "")[:3000]) for r in small.limit(80).collect()]
    want = brute_shared([t.encode() for _, t in rows])
    got = {r["doc_id"]: r["n_shared"] for r in S.remove_repeats(small.sparkSession.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[d] for d, _ in rows] == want and any(want)
