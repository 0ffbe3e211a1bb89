"""Language identification in two steps: the family first, then the languages of that family against each other.

Features are hashed byte n-grams of two to four bytes over the whole text, letters only: ASCII letters in lower case and
all bytes beyond ASCII stay, any other run of bytes is one space. A text's vector is the square root of its counts, of
unit length. Models are linear support vector machines (squared hinge loss, dual coordinate descent), trained here:

* Families are found in the training rows: the mean vectors of the languages are merged by average cosine, the nearest
  pair first, down to the square root of the number of languages (rounded up). `families` gives them instead.
* Each family has a machine against all others; the largest margin names the family.
* Inside it every pair of languages has a machine of its own. The most pairs won name the language, equal numbers go by
  the sum of margins.

The score is the product of two shares, each a logistic of a margin: that of the family (over the families' sum), and
the least of the language's pairs.

Training rows: at most `rows` vectors in all, spread evenly over the languages, those with the smallest hashes. They are
made by the tasks and written. The mean vectors come to the driver, which finds the families; every machine is then fitted
in a task of its own (`fit`), and the driver gets its weights. `training_rows` and `train` do the same in one process.

Defined cases: `und` with score 0.0 if the text is null or has no letter (Unicode category L), or if there is nothing to
learn from; with one learned language all other texts get it. A null language is never learned. Repeated rows give a row
each; a null doc_id is held out of nothing and trained on if its language is there; other columns are ignored; an empty
table gives an empty result. A text of any length is one vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitlake.llm.common import materialise, utf8

DIMENSIONS = 1 << 13
ORDERS = (2, 3, 4)
UNKNOWN = "und"
#: Letters in lower case; every other ASCII byte becomes a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_LETTER = regex.compile(r"\p{L}")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def vector(text: bytes) -> np.ndarray:
    """The unit vector of a UTF-8 text (zeros without an n-gram)."""
    folded = np.frombuffer(b" " + b" ".join(text.translate(FOLD).split()) + b" ", np.uint8).astype(np.uint64)
    counts = np.zeros(DIMENSIONS, np.int64)
    run = folded
    for order in range(2, ORDERS[-1] + 1):
        run = (run[:-1] << np.uint64(8)) | folded[order - 1 :]
        if order in ORDERS and len(run):
            place = ((run + np.uint64(order << 40)) * _MIX) >> np.uint64(64 - DIMENSIONS.bit_length() + 1)
            counts += np.bincount(place.astype(np.int64), minlength=DIMENSIONS)
    out = np.sqrt(counts).astype(np.float32)
    length = float(np.sqrt((out * out).sum()))
    return out / np.float32(length) if length else out


def has_letter(text: str) -> bool:
    return _LETTER.search(text) is not None


def training_vectors(docs: DataFrame, rows: int = 4000) -> DataFrame | None:
    """(lang, at, value): the vectors of at most `rows` rows of (text, lang), as many of each language as there are, evenly.

    `at` holds the places that are not zero. A share of the hash range is cut off first for each language, so that a
    frequent one does not pass through one task. None if there is no language.
    """
    known = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("_n"))
    most = sizes.count()
    if not most:
        return None
    per = max(1, rows // most)
    key = F.xxhash64("text", "lang")
    place = (key.cast("double") + 2.0**63) / 2.0**64
    near = known.join(F.broadcast(sizes) if most <= 10_000 else sizes, "lang").where(place * F.col("_n") <= 2.0 * per)
    first = near.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy(key, "text"))).where(F.col("_rank") <= per)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            found = [vector(data[lo:hi].tobytes()) for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            at = [np.flatnonzero(v) for v in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.list_(pa.int16())), pa.array([v[i] for v, i in zip(found, at)], pa.list_(pa.float32()))], names=["lang", "at", "value"])

    return first.select("lang", "text").mapInArrow(make, "lang string, at array<smallint>, value array<float>")


def ordered_vectors(rows: pa.Table) -> tuple[list[str], np.ndarray]:
    """(languages, vectors) of (lang, at, value), in one order whatever the order of arrival."""
    langs = rows.column("lang").to_pylist()
    at, value = (rows.column(c).combine_chunks() for c in ("at", "value"))
    places, values, ends = at.flatten().to_numpy(), value.flatten().to_numpy(), np.concatenate([[0], np.cumsum(at.value_lengths().to_numpy(zero_copy_only=False))])
    sums, one = np.zeros(len(langs), np.float32), np.zeros(DIMENSIONS, np.float32)
    for i, (lo, hi) in enumerate(zip(ends[:-1], ends[1:])):
        one[:] = 0
        one[places[lo:hi]] = values[lo:hi]
        sums[i] = one.sum()
    order = np.lexsort((sums, np.array(langs, dtype=object).astype(str))) if langs else np.zeros(0, np.int64)
    vectors = np.zeros((len(langs), DIMENSIONS), np.float32)
    for row, i in enumerate(order.tolist()):
        vectors[row, places[ends[i] : ends[i + 1]]] = values[ends[i] : ends[i + 1]]
    return [langs[i] for i in order], vectors


def training_rows(docs: DataFrame, rows: int = 4000) -> tuple[list[str], np.ndarray]:
    """The languages and vectors of `training_vectors`, in this process: for samples that fit the driver."""
    found = training_vectors(docs, rows)
    return ordered_vectors(found.toArrow()) if found is not None else ([], np.zeros((0, DIMENSIONS), np.float32))


def machine(x: np.ndarray, y: np.ndarray, cost: float = 4.0, rounds: int = 12) -> tuple[np.ndarray, float]:
    """(weights, bias) of a linear support vector machine for y of +1 and -1, classes weighed alike."""
    rng = np.random.default_rng(7)
    share = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    soft = 1 / (2 * cost * share)
    norms = np.einsum("ij,ij->i", x, x) + 1.0 + soft
    w, bias, alpha = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(len(y))
    for _ in range(rounds):
        for i in rng.permutation(len(y)):
            slope = y[i] * (float(x[i] @ w) + bias) - 1 + soft[i] * alpha[i]
            new = max(0.0, alpha[i] - slope / norms[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w += np.float32(step) * x[i]
                bias += step
                alpha[i] = new
    return w, bias


def clustered(languages: list[str], means: np.ndarray, n_families: int) -> list[list[str]]:
    """Languages merged by average cosine, nearest pair first, into n_families groups."""
    unit = means / np.maximum(np.sqrt((means * means).sum(axis=1, keepdims=True)), 1e-12)
    alike = unit @ unit.T
    groups = [[i] for i in range(len(languages))]
    while len(groups) > max(1, n_families):
        near = max(((float(alike[np.ix_(a, b)].mean()), -i, -j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
        i, j = -near[1], -near[2]
        groups[i] += groups.pop(j)
    return [sorted(languages[i] for i in g) for g in groups]


@dataclass
class Model:
    """Families with their machines, and the machines of each pair of languages inside a family."""

    families: list[list[str]]
    of_family: np.ndarray = field(default_factory=lambda: np.zeros((0, DIMENSIONS + 1), np.float32))  # a row per family
    pairs: list[dict[tuple[str, str], np.ndarray]] = field(default_factory=list)  # above 0: the first of the pair

    def predict(self, vectors: np.ndarray) -> list[tuple[str, float]]:
        """(language, score) of each vector."""
        x = np.concatenate([vectors, np.ones((len(vectors), 1), np.float32)], axis=1)
        logistic = lambda m: 1 / (1 + np.exp(-np.clip(3.0 * m, -50, 50)))
        margin = x @ self.of_family.T if len(self.families) > 1 else np.zeros((len(x), 1))
        family, share = margin.argmax(axis=1), logistic(margin)
        sure = share.max(axis=1) / share.sum(axis=1)
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(x)
        for f, languages in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            if not len(rows):
                continue
            won, sums, least = np.zeros((len(rows), len(languages))), np.zeros((len(rows), len(languages))), np.ones((len(rows), len(languages)))
            for (a, b), weights in self.pairs[f].items():
                m = x[rows] @ weights
                i, j = languages.index(a), languages.index(b)
                for k, side in ((i, m), (j, -m)):
                    won[:, k] += side > 0
                    sums[:, k] += side
                    least[:, k] = np.minimum(least[:, k], logistic(side))
            for r, row in enumerate(rows.tolist()):
                k = max(range(len(languages)), key=lambda k: (won[r, k], sums[r, k], -k))  # noqa: B023
                out[row] = languages[k], float(min(1.0, sure[row] * least[r, k]))
        return out


def train(languages: list[str], vectors: np.ndarray, families: list[list[str]] | None = None) -> Model:
    """The model of labelled vectors; `families` lists the languages of each family, all of them."""
    names = sorted(set(languages))
    y = np.array(languages)
    if families is None:
        families = clustered(names, np.array([vectors[y == n].mean(axis=0) for n in names]), math.ceil(math.sqrt(len(names)))) if names else []
    model = Model(families)
    fit = lambda rows, plus: np.append(*machine(vectors[rows], np.where(plus[rows], 1.0, -1.0))).astype(np.float32)
    if len(families) > 1:
        model.of_family = np.array([fit(np.arange(len(y)), np.isin(y, f)) for f in families])
    for languages_of in families:
        pairs = [(a, b) for i, a in enumerate(languages_of) for b in languages_of[i + 1 :]]
        model.pairs.append({(a, b): fit(np.flatnonzero((y == a) | (y == b)), y == a) for a, b in pairs})
    return model


def fit(docs: DataFrame, rows: int = 4000, families: list[list[str]] | None = None) -> Model:
    """The model of `train(*training_rows(docs, rows), families)`; each machine is fitted in a task, from the vectors of its languages."""
    found = training_vectors(docs, rows)
    if found is None:
        return Model([])
    found = materialise(found)

    def mean(group: pa.Table) -> pa.Table:
        langs, vectors = ordered_vectors(group)
        return pa.table({"lang": langs[:1], "mean": pa.array([vectors.mean(axis=0)], pa.list_(pa.float32()))})

    def weights(group: pa.Table) -> pa.Table:
        langs, vectors = ordered_vectors(group)
        plus = dict(zip(group.column("lang").to_pylist(), group.column("plus").to_pylist()))
        w, bias = machine(vectors, np.where([plus[x] for x in langs], 1.0, -1.0))
        return pa.table({"unit": group.column("unit").slice(0, 1), "weights": pa.array([np.append(w, bias).astype(np.float32)], pa.list_(pa.float32()))})

    flat = lambda column: column.combine_chunks().flatten().to_numpy().reshape(len(column), -1)
    if families is None:
        means = found.groupBy("lang").applyInArrow(mean, "lang string, mean array<float>").toArrow().sort_by("lang")  # a vector a language
        names = means.column("lang").to_pylist()
        families = clustered(names, flat(means.column("mean")), math.ceil(math.sqrt(len(names))))
    model = Model(families)
    sides = [(sum(families, []), set(f)) for f in families] if len(families) > 1 else []
    pairs = [(f, a, b) for f, languages in enumerate(families) for i, a in enumerate(languages) for b in languages[i + 1 :]]
    units = [(u, x, x in plus) for u, (of, plus) in enumerate(sides + [([a, b], {a}) for _, a, b in pairs]) for x in of]
    model.pairs = [{} for _ in families]
    if units:
        sent = F.broadcast(docs.sparkSession.createDataFrame(units, "unit int, lang string, plus boolean"))  # names only
        got = found.join(sent, "lang").groupBy("unit").applyInArrow(weights, "unit int, weights array<float>").toArrow().sort_by("unit")
        fitted = flat(got.column("weights"))
        if sides:
            model.of_family = fitted[: len(sides)].copy()
        for (f, a, b), row in zip(pairs, fitted[len(sides) :]):
            model.pairs[f][a, b] = row
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every document (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a vector for each family and pair, whatever the input

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            found: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(column)
            known = [i for i, t in enumerate(column.to_pylist()) if t is not None and has_letter(t)] if shared.value.families else []
            data, offsets = utf8(column)
            for lo in range(0, len(known), 256):
                part = known[lo : lo + 256]
                for i, p in zip(part, shared.value.predict(np.array([vector(data[offsets[i] : offsets[i + 1]].tobytes()) for i in part]))):
                    found[i] = p
            yield pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["lang_pred", "score"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", run("text").alias("_p")).select("doc_id", "_p.lang_pred", "_p.score")
