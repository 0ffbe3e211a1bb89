"""Language ID is fitted in tasks: the driver gets weights, neither vectors nor machines to train."""

import numpy as np

from hitlake.llm import language_id as L
from hitlake.llm import queries


def test_machines_are_fitted_in_tasks(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    alone, together = L.train(*L.training_rows(docs, 300)), L.fit(docs, 300)
    assert together.families == alone.families
    assert np.allclose(together.of_family, alone.of_family, atol=1e-5)
    assert [set(p) for p in together.pairs] == [set(p) for p in alone.pairs]
    assert all(np.allclose(a[k], b[k], atol=1e-5) for a, b in zip(together.pairs, alone.pairs) for k in a)

    def never(*_):
        raise AssertionError("on the driver")

    monkeypatch.setattr(L, "training_rows", never)
    monkeypatch.setattr(L, "train", never)
    assert queries.language_rows(docs).count() == docs.count()
