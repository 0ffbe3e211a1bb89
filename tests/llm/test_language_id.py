"""Language ID: held-out accuracy, the machines against their optimality conditions, odd rows."""

import numpy as np

from hitlake.llm import language_id as L
from hitlake.llm import queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op12_language_id(spark, SF).collect()
    assert len(rows) == len(truth) and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    right = [r["lang_pred"] == truth[r["doc_id"]] for r in held]
    assert len(held) > 250 and sum(right) / len(right) > 0.98
    sure = [ok for r, ok in zip(held, right) if r["score"] > 0.8]
    assert sum(sure) / len(sure) >= sum(right) / len(right)


def test_labels_of_held_out_rows_do_not_matter(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    other = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang")))
    a, b = (queries.language_rows(d).orderBy("doc_id").collect() for d in (docs, other))
    assert a == b and "xx" not in {r["lang_pred"] for r in b}


def test_machine_meets_its_conditions():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5)).astype(np.float32)
    y = np.where(x[:, 0] + 0.3 * x[:, 1] + 0.3 * rng.normal(size=60) > 0.2, 1.0, -1.0)
    w, bias = L.machine(x, y, rounds=400)
    share = np.where(y > 0, 60 / (2 * (y > 0).sum()), 60 / (2 * (y < 0).sum()))

    def loss(w, bias):
        return (w @ w + bias * bias) / 2 + 4.0 * (share * np.maximum(0, 1 - y * (x @ w + bias)) ** 2).sum()

    assert all(loss(w + d[:5], bias + d[5]) >= loss(w, bias) - 1e-4 for d in rng.normal(size=(300, 6)) * 1e-2)


def test_close_languages_share_a_family_and_are_told_apart():
    words = {"a1": "lan mera toki suno", "a2": "lan mera toki sunu", "b1": "grok zwift plunk", "b2": "grok zwift plonk"}
    rng = np.random.default_rng(5)
    langs = [k for k in words for _ in range(40)]
    texts = [" ".join(rng.choice(words[k].split(), 30)).encode() for k in langs]
    model = L.train(langs, np.array([L.vector(t) for t in texts]))
    assert sorted(map(tuple, model.families)) == [("a1", "a2"), ("b1", "b2")]
    fresh = [k for k in words for _ in range(10)]
    got = model.predict(np.array([L.vector(" ".join(rng.choice(words[k].split(), 30)).encode()) for k in fresh]))
    assert [g[0] for g in got] == fresh and all(0.25 < g[1] <= 1 for g in got)
    alone = L.train(["de"] * 3, np.array([L.vector(b"das ist gut")] * 3))
    assert alone.predict(np.array([L.vector(b"anything")]))[0][0] == "de"


def test_odd_rows(spark, odd, none):
    rows = queries.language_rows(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert {by_id[i]["lang_pred"] for i in (3, 4, 5)} == {"und"} and by_id[3]["score"] == 0.0
    assert set(r["lang_pred"] for r in rows) <= {"en", "de", "und"}
    assert queries.language_rows(none).collect() == []
    assert {r["lang_pred"] for r in queries.language_rows(odd.withColumn("lang", odd["lang"].substr(9, 1)).where("lang is null")).collect()} == {"und"}
    digits = spark.createDataFrame([(1, "12 34 ²Ⅷ", "en"), (3, "字", "zh"), (4, "é", "fr"), (6, "abc", "en")], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["lang_pred"] == "und" for r in L.predict(digits, L.train(*L.training_rows(digits))).collect()} == {1: True, 3: False, 4: False, 6: False}
    assert L.training_rows(odd, rows=4)[1].shape[0] <= 4


def test_vector_is_of_unit_length_and_of_letters_only():
    assert abs(np.linalg.norm(L.vector("Hällo wörld".encode())) - 1) < 1e-6
    assert (L.vector(b"Ab, cd!") == L.vector(b"ab  9cd")).all()
    assert L.vector(b"").sum() == L.vector(b"12 !").sum()
