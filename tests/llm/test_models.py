import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from hitlake.llm import lm_scoring as L
from hitlake.llm import quality_cnn as Q
from hitlake.llm import queries
from hitlake.llm.common import utf8


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in queries.op4_quality(spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(rows[r["doc_id"]]["held_out"] for r in labels) and len(rows) == 1000
    good = [rows[r["doc_id"]]["score"] for r in labels if r["quality"]]
    bad = [rows[r["doc_id"]]["score"] for r in labels if not r["quality"]]
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows.values())


def test_quality_of_odd_documents(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1), (4, 0), (99, 1), (None, 1), (5, None)], "doc_id long, label int")
    net = Q.train(Q.sample_texts(odd, labels), epochs=2)
    assert Q.score_documents(odd, net).count() == odd.count()
    blank = Q.train(Q.sample_texts(none, labels.limit(0)))
    assert {r["score"] for r in Q.score_documents(odd, blank).collect()} == {0.5}
    assert Q.score_documents(none, net).collect() == []


def test_quality_does_not_depend_on_neighbours_in_a_batch():
    rng = np.random.default_rng(0)
    net = Q.Network(rng.normal(size=(Q.WIDTH, Q.SYMBOLS, 4)).astype(np.float32), rng.normal(size=4).astype(np.float32), rng.normal(size=12).astype(np.float32), 0.1)
    texts = ["".join(map(chr, rng.integers(32, 120, n))) for n in (0, 1, 255, 256, 257, 1000, 70_000)]
    together = Q.score(net, *utf8(pa.array(texts)))
    alone = [Q.score(net, *utf8(pa.array([t])))[0] for t in texts]
    assert together == pytest.approx(alone, abs=1e-6)
    # Brute force: every chunk by itself.
    for text, value in zip(texts, together):
        symbols, blocks = Q.padded(np.frombuffer(text.encode(), np.uint8), 0, len(text.encode()))
        chunks = [0] if blocks == 1 else list(range(blocks - 1))
        pooled = []
        for c in chunks:
            places = range(c * Q.BLOCK, (c + (1 if blocks == 1 else 2)) * Q.BLOCK, Q.STRIDE)
            pooled.append(np.max([sum(net.tables[j][symbols[p + j]] for j in range(Q.WIDTH)) for p in places], axis=0))
        pooled = np.array(pooled)
        hidden = np.maximum(np.concatenate([pooled.mean(0), pooled.max(0), pooled.min(0)]) + np.tile(net.bias, 3), 0)
        assert value == pytest.approx(float(Q.sigmoid(hidden @ net.out + net.out_bias)), abs=1e-4)


def test_quality_gradient_is_that_of_the_score():
    """Against differences of the log loss of `score`, on documents of one, a few and very many chunks."""
    rng = np.random.default_rng(2)
    net = Q.Network(rng.normal(size=(Q.WIDTH, Q.SYMBOLS, 3)), rng.normal(size=3), rng.normal(size=9), 0.1)
    texts = ["".join(map(chr, rng.integers(97, 105, n))) for n in (0, 40, 300, 1000, 30_000)]
    labels = np.array([0.0, 1.0, 1.0, 0.0, 1.0])
    data, offsets = utf8(pa.array(texts))
    parts = [Q.padded(data, a, b) for a, b in zip(offsets[:-1], offsets[1:])]
    bases = np.cumsum([0, *[len(s) for s, _ in parts[:-1]]])
    starts = np.concatenate([base + Q.BLOCK * np.arange(n) for base, (_, n) in zip(bases, parts)])
    got = Q.gradient(net, np.concatenate([s for s, _ in parts]), starts, np.array([n for _, n in parts]), labels)

    def loss():
        p = Q.score(net, data, offsets)
        return float(-(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean())

    for array, grad, extra in ((net.tables, got[0], 0.0), (net.bias, got[1], 0.0), (net.out, got[2], 1e-4)):
        flat, g = array.reshape(-1), grad.reshape(-1)
        for i in np.argsort(-np.abs(g))[:12].tolist():
            old = flat[i]
            flat[i] = old + 1e-6
            up = loss()
            flat[i] = old - 1e-6
            down = loss()
            flat[i] = old
            assert (up - down) / 2e-6 + extra * old == pytest.approx(g[i], rel=1e-3, abs=1e-6)


def test_quality_of_long_documents(spark):
    """What tells the labels apart stands only in the middle of texts of over 20 kB; training and scoring see it there."""
    rng = random.Random(3)
    fill = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(1700))
    rows = [(i, fill() + (" zzqzzq" * 30 if i % 2 else "") + fill(), i % 2) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    net = Q.train(Q.sample_texts(docs, docs.where("doc_id < 40").select("doc_id", "label")), filters=8, epochs=40, batch=8, rate=0.03)
    held = [(r["score"], i % 2) for i, r in enumerate(sorted(Q.score_documents(docs, net).collect(), key=lambda r: r["doc_id"])) if i >= 40]
    assert min(s for s, y in held if y) > max(s for s, y in held if not y)


def brute_losses(texts, flags, which, prior=4.0):
    """Losses of one text under both models of all the others, token by token with plain dictionaries."""
    out = []
    n_target = sum(len(t) for t, f in zip(texts, flags) if f)
    n_all = sum(map(len, texts))
    for model in (0, 1):
        scale = 1.0 if model == 0 or not n_target else n_target / n_all
        grams = [Counter(), Counter(), Counter(), Counter()]  # runs of four, contexts, pairs, bytes
        before = Counter()
        for i, (t, f) in enumerate(zip(texts, flags)):
            if i == which or (model == 0 and not f):
                continue
            wide = b"\n\n\n" + t
            for j in range(len(t)):
                for g, gram in zip(grams, (wide[j : j + 4], wide[j : j + 3], wide[j + 2 : j + 4], wide[j + 3 : j + 4])):
                    g[gram] += scale
                before[wide[j + 2]] += scale
        wide, loss = b"\n\n\n" + texts[which], 0.0
        for j in range(len(texts[which])):
            p = (grams[3][wide[j + 3 : j + 4]] + 1) / (sum(grams[3].values()) + 256)
            p = (grams[2][wide[j + 2 : j + 4]] + prior * p) / (before[wide[j + 2]] + prior)
            p = (grams[0][wide[j : j + 4]] + prior * p) / (grams[1][wide[j : j + 3]] + prior)
            loss -= math.log(p)
        out.append(loss / max(1, len(texts[which])))
    return out


@pytest.mark.parametrize("most_sent", [4_000_000, 40])
def test_lm_scores_match_brute_force(spark, most_sent):
    rng = random.Random(9)
    texts = ["", "a", "the cat sat on the mat", "the cat sat on the mat", "Über das Meer \U0001f600", *["".join(rng.choices("abc \n\xe9z", k=rng.randint(1, 60))) for _ in range(12)]]
    flags = [i % 3 == 0 for i in range(len(texts))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, None)], "doc_id long, text string")
    rows = L.marked(df, spark.createDataFrame([(i,) for i, f in enumerate(flags) if f] + [(None,)], "doc_id long"))
    models = L.fit(rows, most_sent=most_sent)
    assert (len(models.cuts) > 1) == (most_sent == 40)
    got = {r["doc_id"]: r for r in L.score_documents(rows, models).collect()}
    raw = [t.encode() for t in texts]
    for i in range(len(texts)):
        want = brute_losses(raw, flags, i)
        assert (got[i]["target_loss"], got[i]["background_loss"]) == pytest.approx(want, abs=1e-9), i
        assert got[i]["score"] == pytest.approx(want[0] - want[1], abs=1e-9) and got[i]["n_tokens"] == len(raw[i])
    assert got[None]["n_tokens"] == 0 and got[None]["score"] == 0.0


def test_lm_long_text_is_one_sequence(spark):
    """Over 2 MiB: the counts are those of the whole text."""
    text = "".join(random.Random(1).choices("abcdefgh \n", k=2_400_000))
    rows = spark.createDataFrame([(1, text, True), (2, "abc", False)], "doc_id long, text string, is_target boolean")
    counts = {r["key"]: (r["target"], r["background"]) for r in L.count(rows).collect()}
    wide = b"\n\n\n" + text.encode()
    want = Counter(int.from_bytes(wide[i : i + 4], "big") for i in range(len(text)))
    assert sum(t for t, _ in counts.values()) == len(text) and all(counts[k][0] == n for k, n in want.items())
    assert np.isfinite(L.score_documents(rows, L.fit(rows)).first()["score"])


def test_lm_of_real_and_odd_documents(spark, odd, small, none):
    rows = L.marked(small, small.where("lang = 'en'").select("doc_id"))
    scored = {r["doc_id"]: r for r in L.score_documents(rows, L.fit(rows)).collect()}
    lang = {r["doc_id"]: r["lang"] for r in small.collect()}
    english, other = ([scored[d]["score"] for d in scored if (lang[d] == "en") == e] for e in (True, False))
    assert max(np.median(english), 0) < np.median(other)
    rows = L.marked(odd, odd.limit(2).select("doc_id"))
    found = L.score_documents(rows, L.fit(rows)).collect()
    assert len(found) == odd.count() and all(np.isfinite(r["score"]) for r in found)
    assert {r["score"] for r in found if r["n_tokens"] == 0} == {0.0}
    blank = L.marked(none, none.select("doc_id"))
    assert L.score_documents(blank, L.fit(blank)).collect() == []


def test_lm_probabilities_add_up():
    """Over the next byte the probabilities of a model sum to one."""
    data = np.frombuffer(b"abab abba baba abab " * 50, np.uint8)
    found, n = L.tallied(L.keys(data))
    pairs = np.stack([np.bincount((found & 0xFFFF).astype(int), n, 1 << 16)] * 2)
    part = L.Part(found, np.stack([n, n]), pairs, 4.0)
    loss = lambda t: part.losses(*L.tallied(L.keys(np.frombuffer(t, np.uint8))), False, counted=False)[0]
    total = sum(np.exp(loss(b"aba") - loss(b"aba" + bytes([b]))) for b in range(256))
    assert total == pytest.approx(1, abs=1e-3)


def test_lm_ranges_are_passes_of_their_own(spark, small, odd):
    """With many ranges no plan holds two of them, and the scores are those of one range."""
    for docs in (small.limit(60), odd):
        rows = L.marked(docs, docs.where("doc_id % 3 = 0").select("doc_id")).repartition(3)
        rows = L.materialise(rows)
        whole = L.fit(rows)
        cut = L.fit(rows, most_sent=whole.counts.count() // 8)
        assert len(whole.cuts) == 1 and len(cut.cuts) >= 4
        one, many = L.score_documents(rows, whole), L.score_documents(rows, cut)
        plan = many._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" not in plan and one._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
        columns = ("n_tokens", "target_loss", "background_loss", "score")
        key = lambda r: (str(r["doc_id"]), r["n_tokens"], round(r["target_loss"], 6))
        a, b = (sorted(df.collect(), key=key) for df in (one, many))
        assert len(a) == len(b) == rows.count()
        assert all(x["doc_id"] == y["doc_id"] and all(x[c] == pytest.approx(y[c], abs=1e-9) for c in columns) for x, y in zip(a, b))
