import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from hitlake.llm import simhash as S


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(fps, most):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbé \n\x0b\x1c", max_size=80))
def test_fingerprint(text):
    assert S.simhash(S.shingle_hashes(text.encode())) == brute_fingerprint(text)


def check_components(df):
    rows = S.components(df).collect()
    want = [(r["doc_id"], brute_fingerprint(r["text"])) for r in df.select("doc_id", "text").collect()]
    roots = brute_roots([f for _, f in want], 4)
    least = {}
    for (doc, _), r in zip(want, roots):
        if doc is not None:
            least[r] = min(least.get(r, doc), doc)
    expected = sorted((str(d), f"{f:016x}", str(least.get(r))) for (d, f), r in zip(want, roots))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in rows) == expected


def test_components(small, odd):
    check_components(small)
    check_components(odd)


def test_empty(none):
    assert S.components(none).collect() == []
    assert S.drop_near_duplicates(none).collect() == []


@pytest.mark.parametrize("block", [4, 2048])
def test_links_of_a_dense_cluster(spark, block):
    """Chains of fingerprints within 4 bits, far more of them than a block holds."""
    rng = np.random.default_rng(1)
    fps = set()
    for centre in rng.integers(0, 1 << 63, 6):
        f = int(centre)
        for _ in range(40):
            fps.add(f)
            for b in rng.integers(0, 64, 3):
                f ^= 1 << int(b)
    fps = sorted(fps)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = S.link_fingerprints(df, 4, block=block)
    roots = {r["node"]: r["root"] for r in S.connected(df.selectExpr("fp as node"), links).collect()}
    groups = {}
    for f, r in zip(signed, brute_roots(fps, 4)):
        groups.setdefault(r, set()).add(roots[f])
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_every_plan_is_complete():
    sample = np.random.default_rng(0).integers(0, 1 << 63, 500).astype(np.uint64)
    for total in (500, 10**6, 10**10):
        plan = S.plan_partitions(sample, total, 4)
        assert sum(t + 1 for _, t in plan) == 5
        bits = [b for g, _ in plan for b in g]
        assert len(bits) == len(set(bits))


def test_drop_keeps_one_of_each(small, odd):
    kept = S.drop_near_duplicates(small)
    ids = {r["component_id"] for r in S.components(small).collect()}
    assert kept.columns == small.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(ids)
    assert S.drop_near_duplicates(odd).columns == odd.columns
