"""Packed sequences carry their token ids."""

import numpy as np
import public_tokenizers

from hitlake.llm import packing as P
from hitlake.llm import queries

BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_packed_sequences_give_back_the_ids(small, odd, none):
    encoder = P.Encoder(BPE)
    for df in (small, odd):
        want = sorted(np.frombuffer(encoder.ids(r["text"] or ""), "<u4").tolist() + [2] for r in df.select("text").collect())
        rows = P.pack_documents(df, BPE).collect()
        assert all(len(r["ids"]) == 4 * r["length"] for r in rows)
        got, copies = [], {}
        for r in rows:
            copies.setdefault((str(r["doc_id"]), r["piece"]), []).append(np.frombuffer(r["ids"], "<u4").tolist())
        for doc in {d for d, _ in copies}:
            parts = [sorted(copies[doc, p]) for p in sorted(p for d, p in copies if d == doc)]
            got += [sum(pieces, []) for pieces in zip(*parts)]
        assert sorted(got) == want
    assert P.pack_documents(none, BPE).collect() == []


def test_query_shows_digests_of_the_packed_ids(spark, small):
    rows = queries.op9_packing(spark, "/root/testdata/sf0.001").collect()
    assert "ids" not in rows[0].asDict()
    want = P.pack_documents(small, BPE).selectExpr("doc_id", "piece", "crc32(ids) as digest").collect()
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows) == sorted(tuple(r) for r in want)
