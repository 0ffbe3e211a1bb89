"""The pipeline's stages against brute force on the smallest documents."""

import re
from collections import Counter

import corpus_pipeline
import pytest

from hitlake.llm import packing, secrets
from hitlake.llm.common import materialise

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """(input, output) of every stage."""
    docs, found = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, SF))
        found[name] = (docs, out)
        docs = out
    return found


def test_order_and_columns(stages):
    assert list(stages) == ["quality_rules", "near_duplicates", "secret_scan", "mix_sources", "pack_sequences"]
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert after.dtypes == before.dtypes


def test_quality(stages):
    before, after = stages["quality_rules"]

    def fails(text):
        words = [w for w in re.split(r"[\x20\x09-\x0d]+", text or "") if w]
        tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        count = Counter(tri)
        return len(words) < 50 or 2 * len({i + k for i, t in enumerate(tri) if count[t] > 1 for k in range(3)}) > len(words)

    def strict(text):  # as a share of the limit; hosts of this table are much alike, between half a limit and a whole one they decide
        words, lines = sum(map(len, re.split(r"[\x20\x09-\x0d]+", text))), [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        return max(10 * sum(c in "#*$%&|<>" for c in text) / words, (len(lines) - len(set(lines))) / 0.3 / len([w for w in re.split(r"[\x20\x09-\x0d]+", text) if w]))

    kept = {r["doc_id"] for r in after.collect()}
    for r in before.collect():
        if fails(r["text"]):
            assert r["doc_id"] not in kept
        elif not 0.5 < strict(r["text"]) <= 1:
            assert (r["doc_id"] in kept) == (strict(r["text"]) <= 1)


def test_near_duplicates(stages):
    from tests.llm.test_similar import brute_kept

    before, after = stages["near_duplicates"]
    assert sorted(r["doc_id"] for r in after.collect()) == brute_kept(before.collect())


def test_secrets(stages):
    before, after = stages["secret_scan"]
    old = {r["doc_id"]: r["text"] for r in before.collect()}
    new = {r["doc_id"]: r for r in after.collect()}
    assert set(old) == set(new)
    for doc, text in old.items():
        assert not secrets.base_spans(new[doc]["text"]) and new[doc]["n_chars"] == len(new[doc]["text"])
        if not secrets.base_spans(text):
            assert new[doc]["text"] == text or "[REDACTED]" in new[doc]["text"]


def test_mix(stages):
    before, after = stages["mix_sources"]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    copies = Counter(r["doc_id"] for r in after.collect())
    assert max(copies.values()) <= 3 and all(r["text"] == texts[r["doc_id"]] for r in after.collect())
    words = lambda t: len(t.split())
    total, taken = sum(map(words, texts.values())), sum(words(texts[d]) * n for d, n in copies.items())
    assert abs(taken - total) < 0.02 * total


def test_pack(stages):
    before, after = stages["pack_sequences"]
    rows = after.collect()
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(r["doc_id"] for r in before.collect())
    use = Counter()
    for r in rows:
        use[r["sequence_id"]] += r["length"]
    assert max(use.values()) <= 1024 and len(use) <= len(packing.best_fit(sorted((r["length"] for r in rows), reverse=True), 1024))


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages["pack_sequences"][1].count()


def test_stages_on_odd_rows(spark, odd, none):
    """Nulls in any column, repeated rows, empty and long texts, clashing names; and no rows at all."""
    for docs in (odd, none):
        start = materialise(docs)
        known = {str(r["doc_id"]) for r in start.collect()}
        for name, stage in corpus_pipeline.STAGES:
            out = materialise(stage(spark, start, SF))
            rows = out.collect()
            assert {str(r["doc_id"]) for r in rows} <= known
            if name == "pack_sequences":
                assert Counter(str(r["doc_id"]) for r in rows if r["piece"] == 0) == Counter(str(r["doc_id"]) for r in start.collect())
            else:
                assert out.columns == docs.columns and (name != "secret_scan" or len(rows) == start.count())
                start = out
        assert (start.count() > 0) == (docs is odd)
