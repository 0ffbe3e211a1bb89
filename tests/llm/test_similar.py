"""Near-duplicate removal by shingle similarity, against all pairs."""

import corpus_pipeline
import numpy as np
import pytest

from hitlake.llm import similar as M
from hitlake.llm import simhash as S
from tests.llm.test_simhash import brute_fingerprint


def brute_kept(rows):
    """The smallest doc_id of each component of pairs with 5-word Jaccard similarity >= 0.8."""

    def shingles(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    rows = sorted(rows, key=lambda r: r["doc_id"])
    sets, root = [shingles(r["text"]) for r in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted({rows[find(i)]["doc_id"] for i in range(len(rows))})


def test_stage_against_all_pairs(spark, small):
    kept = corpus_pipeline.near_duplicates(spark, small, "")
    assert kept.columns == small.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == brute_kept(small.collect())


def test_similar_texts_that_differ_in_many_bits_meet(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in rng.integers(0, 5000, 400)]
    other = [f"changed{i}" if i in (50, 150, 250, 350) else w for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(f"x{i}" for i in range(400)))]
    assert (brute_fingerprint(rows[0][1]) ^ brute_fingerprint(rows[1][1])).bit_count() > 4
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == [1, 3]


def test_blocks_of_a_large_component(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(60):
        text = list(base)
        for at in rng.integers(0, 300, 2):
            text[at] = f"k{k}"
        rows.append((7, k, " ".join(text)))
    members = spark.createDataFrame(rows, "root long, sid long, text string")
    for block in (8, 256):
        links = M.verified_links(members, block=block)
        roots = M.connected(members.selectExpr("sid as node"), links)
        assert {r["root"] for r in roots.collect()} == {0}


def test_odd_documents(odd, none):
    kept = M.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert M.components(odd).count() == odd.count()
    assert M.drop_near_duplicates(none).collect() == []
    rows = sorted(map(str, odd.collect()))
    found = kept.collect()
    assert all(str(r) in rows for r in found)
    # Texts without a word are one set; the rest of the ids stay but for the copies of document 1.
    assert sorted(str(r["doc_id"]) for r in found) == sorted(["1", "3", "6", "7", "8", "9", "10", "None"])


@pytest.mark.parametrize("drop", [M.drop_near_duplicates, S.drop_near_duplicates])
def test_clashing_ids(spark, drop):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a, "x"), (2, b, "x"), (2, a, "x"), (2, b, "y"), (None, a, "z"), (None, "c d", "z"), (None, "c d", "z")]
    out = sorted((str(r["doc_id"]), r["text"]) for r in drop(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect())
    assert out == [("1", a), ("2", b), ("None", "c d")]
