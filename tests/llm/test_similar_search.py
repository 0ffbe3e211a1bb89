"""The near-duplicate stage searches by operator 10's method, and verifies what it finds."""

import corpus_pipeline
from pyspark.sql import functions as F

from hitlake.llm import similar as M


def test_fingerprint_search_alone_finds_similar_texts(spark, monkeypatch):
    """Without the bands, pairs that the fingerprints bring together are still found, and only verified ones go."""
    words = [f"w{i}" for i in range(3000)]
    other = ["changed" if i == 1500 else w for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(f"x{i}" for i in range(400))), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(M, "candidate_links", lambda sets: sets.select(F.col("sid").alias("src"), F.col("sid").alias("dst")).limit(0))
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == [1, 3, 4]


def test_fingerprint_links_connect_all_near_fingerprints(spark):
    fps = [0b0, 0b1111, 0b11111111, (1 << 40) - 1, 0b0]
    sets = spark.createDataFrame(list(enumerate(fps)), "sid long, fp long")
    roots = {r["node"]: r["root"] for r in M.connected(sets.selectExpr("sid as node"), M.fingerprint_links(sets)).collect()}
    assert roots == {0: 0, 1: 0, 2: 0, 3: 3, 4: 0}
