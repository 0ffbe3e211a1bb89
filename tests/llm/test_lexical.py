"""Ranked lexical search against scores computed document by document."""

import math
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from hitlake.llm import lexical as X

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=10):
    """docs: (doc_id, text), items: (item_id, text)."""
    found = [(d, split(t)) for d, t in docs]
    n_docs, total = sum(bool(t) for _, t in found), sum(len(t) for _, t in found)
    out = []
    for item_id, text in items:
        asked = set(split(text))
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in d for _, d in found) + 1))) for t in asked}
        scored = []
        for doc_id, have in found:
            if have:
                m = 100 - 90 + (90 * len(have) * n_docs) // total
                s = sum(w[t] * ((1000000000 * have.count(t)) // (1000 * have.count(t) + 8 * m)) for t in asked)
                if s > 0:
                    scored.append((-s, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, i + 1, r[3], -r[0]) for i, r in enumerate(sorted(scored, key=lambda r: r[:3])[:top])]
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in df.collect()), key=str)


def test_search_matches_brute_force(spark, small):
    docs = [tuple(r) for r in small.select("doc_id", "text").limit(80).collect()]
    asked = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text")
    want = brute(docs, [tuple(r) for r in asked.collect()])
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert len(want) > 300 and rows_of(X.search(df, asked)) == want


def test_odd_rows_and_ties(spark, odd, none):
    items = [(1, "Alpha beta GAMMA gamma delta0"), (1, "Alpha beta GAMMA gamma delta0"), (2, None), (3, ""), (4, "nowhere-found"), (5, "ÜNÏCÖDÉ Ünïcödé 字字字 one"), (None, "two three zeta2 alpha"), (7, "\x00!?")]
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "0 as row", "'t' as terms", "1 as doc_id", "2 as rank")
    docs = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    for top in (10, 2):
        assert rows_of(X.search(odd.repartition(4), asked, top)) == brute(docs, items, top)
    assert X.search(none, asked).collect() == [] and X.search(odd, asked.limit(0)).collect() == []


def test_blocks_of_items_give_the_same(spark, odd, monkeypatch):
    asked = spark.createDataFrame([(i, f"alpha beta gamma {w} one") for i, w in enumerate("delta epsilon zeta eta theta iota kappa".split())], "item_id long, text string")
    whole = rows_of(X.search(odd, asked))
    monkeypatch.setattr(X, "MOST_POSTINGS", 9)
    monkeypatch.setattr(X, "CELLS", 50)
    assert whole and rows_of(X.search(odd, asked)) == whole


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 14), max_size=10).map(sorted), max_size=12), st.integers(1, 5))
def test_graph_covers_every_item_once(items, reach):
    graph = X.mine(items, 15, reach)
    parts = {t: [t] for t in range(15)}
    for i, (x, y) in enumerate(graph.pairs.tolist()):
        assert x < 15 + i and y < 15 + i
        parts[15 + i] = parts[x] + parts[y]
    assert [sorted(t for node in nodes for t in parts[node]) for nodes in graph.items] == items
    heights = np.concatenate([*graph.levels(), np.zeros(0, np.int64)])
    assert sorted(heights.tolist()) == list(range(len(graph.pairs)))


def test_shared_sets_become_nodes():
    items = [[0, 1, 2, 3, k] for k in range(4, 12)]
    graph = X.mine(items, 12)
    assert all(len(nodes) == 2 for nodes in graph.items) and len(graph.pairs) == 3
