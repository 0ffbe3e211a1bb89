"""Cross-tokenizer alignment: which ids of one vocabulary stand beside which ids of another, corpus-wide.

Both tokenizers cut the bytes of space + text. Where tokens of both end at one byte a group ends; every token of side A
in a group is linked with every token of side B in it. A pair of ids counts the documents that hold it linked.

The records (pair, document, links) are many times the tokens of the vocabularies, so they are counted externally:

* Tasks cut documents into runs of about `run_records` records. A run is sorted by (radix of the A id, A id, B id,
  document) and written compressed: its heads (distinct pairs, with the number of documents in the run) as blocks, one
  or more for each radix, and its body (documents and links, in the same order).
* Only heads are shuffled for counting, by radix and first pair, so a pair that every document holds is one entry a run.
  Each task merges the blocks with a heap, holding one open block a run, adds equal pairs up and sends every block its
  counts back. The order is by A id first, so the largest count of each A id follows from the same pass.
* Each run meets its own counts once more, and sums them up by document: a document lies in one run, so its row is
  complete there. The largest counts, one number for each id of the vocabulary, are sent to all tasks.

Defined cases: null or empty text, and a text whose joined token bytes differ from space + text on either side (such as
one with U+2581): no tokens, all numbers 0, digest ''. Repeated rows are documents of their own and count each. A null
doc_id stays null. Other columns are ignored; an empty table gives an empty result. Text of any length is one document;
its links are expanded in stretches of at most about `MOST_LINKS`.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitlake.llm.common import materialise, texts
from hitlake.llm.packing import Encoder

RADICES = 256
BLOCK = 2048  # pairs in a block of heads
MOST_LINKS = 2_000_000
MOST_DOCUMENTS = 1 << 16  # in a run: a document's place in it has 16 bits
SLAB = 1_000_000  # characters that are aligned at once; a longer document goes alone
_DOC = np.uint64(16)


def packed(column: np.ndarray) -> bytes:
    """A compressed column, byte plane by byte plane."""
    planes = np.ascontiguousarray(column).view(np.uint8).reshape(len(column), column.itemsize).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpacked(blob: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def steps(ascending: np.ndarray) -> np.ndarray:
    """Differences to the value before; `np.cumsum` gives the values back."""
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def summed(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys ascending, sum of n, or how often each)."""
    if n is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if n is None:
        return keys[first], np.diff(np.append(first, len(keys)))
    return keys[first], np.add.reduceat(n, first) if len(first) else n


class Sides:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = Encoder(a_path).fast.__self__
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [b""] * (self.a.max_token_value + 1)
        for token in self.a.token_byte_values():
            self.a_bytes[self.a.encode_single_token(token)] = token
        self.b_bytes = [bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode() for i, piece in enumerate(self.b.id_to_piece(list(range(self.b.get_piece_size()))))]
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.width = len(str(max(len(self.a_bytes), len(self.b_bytes))))
        self.digits = np.frombuffer(b"".join(str(i).encode().ljust(self.width, b"\0") for i in range(max(len(self.a_bytes), len(self.b_bytes)))), np.uint8).reshape(-1, self.width)
        self.span = -(-len(self.a_bytes) // RADICES)

    def radix_first(self, a: np.ndarray) -> np.ndarray:
        """A ids numbered so that those of one radix are neighbours."""
        return a % RADICES * self.span + a // RADICES

    def encode(self, found: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both sides for each text, None where a side's bytes differ from space + text."""
        out = []
        for text, b in zip(found, self.b.encode(found, num_threads=1)):
            raw = (" " + text).encode()
            a = self.a.encode_ordinary(" " + text)
            same = b"".join(map(self.a_bytes.__getitem__, a)) == raw and b"".join(map(self.b_bytes.__getitem__, b)) == raw
            out.append((np.array(a, np.int64), np.array(b, np.int64)) if same and text else None)
        return out


class Aligned:
    """Groups and links of several documents at once, given as ids of both sides."""

    def __init__(self, sides: Sides, documents: list[tuple[np.ndarray, np.ndarray]]):
        self.sides = sides
        self.n_a, self.n_b = (np.array([len(d[k]) for d in documents], np.int64) for k in (0, 1))
        self.a, self.b = (np.concatenate([d[k] for d in documents]) for k in (0, 1))
        a_ends, b_ends = np.cumsum(sides.a_lengths[self.a]), np.cumsum(sides.b_lengths[self.b])
        common = np.intersect1d(a_ends, b_ends)
        self.a_group, self.b_group = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        self.a_in, self.b_in = (np.bincount(g, minlength=len(common)) for g in (self.a_group, self.b_group))
        self.a_start, self.b_start = (np.cumsum(n) - n for n in (self.a_in, self.b_in))
        self.doc = np.repeat(np.arange(len(documents)), np.diff(np.searchsorted(common, a_ends[np.cumsum(self.n_a) - 1], "right"), prepend=0))  # of each group
        self.n_groups = np.bincount(self.doc, minlength=len(documents))
        self.n_links = np.zeros(len(documents), np.int64)
        np.add.at(self.n_links, self.doc, self.a_in * self.b_in)

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(A id, B id, document) of all links, in stretches."""
        per = self.b_in[self.a_group]
        through = np.cumsum(per)
        lo = 0
        while lo < len(per):
            hi = max(lo + 1, int(np.searchsorted(through, through[lo] - per[lo] + MOST_LINKS, "right")))
            n, group = per[lo:hi], self.a_group[lo:hi]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(self.a[lo:hi], n), self.b[np.repeat(self.b_start[group], n) + inside], np.repeat(self.doc[group], n)
            lo = hi

    def digests(self) -> list[str]:
        """SHA-256 of each document's groups, written out as `a1,a2|b1;a3|b2,b3`."""
        a_at = np.arange(len(self.a)) + self.b_start[self.a_group]
        b_at = np.arange(len(self.b)) + (self.a_start + self.a_in)[self.b_group]
        shown = np.zeros((len(self.a) + len(self.b), self.sides.width + 1), np.uint8)
        shown[a_at, :-1], shown[b_at, :-1] = self.sides.digits[self.a], self.sides.digits[self.b]
        shown[:, -1] = ord(",")
        shown[(self.a_start + self.a_in + self.b_start) - 1, -1] = ord("|")
        ends = np.cumsum(self.a_in + self.b_in) - 1
        shown[ends, -1] = ord(";")
        last = np.cumsum(self.n_a + self.n_b) - 1
        shown[last, -1] = 0
        sizes = np.cumsum((shown != 0).sum(axis=1))[last]
        line = shown.ravel()
        line = line[line != 0].tobytes()
        return [hashlib.sha256(line[lo:hi]).hexdigest() for lo, hi in zip([0, *sizes[:-1].tolist()], sizes.tolist())]


_META = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
_RUN = f"run bigint, radix int, block int, first bigint, pairs binary, n binary, docs binary, links binary, documents array<struct<{_META}>>"
_KINDS = pa.schema(
    [("run", pa.int64()), ("radix", pa.int32()), ("block", pa.int32()), ("first", pa.int64())]
    + [(c, pa.binary()) for c in ("pairs", "n", "docs", "links")]
    + [("documents", pa.list_(pa.struct([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string())])))]
)


class Run:
    """Documents and records gathered by a task until they are written."""

    def __init__(self, sides: Sides):
        self.sides, self.width = sides, np.uint64(len(sides.b_bytes))
        self.documents: list[dict] = []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.records = 0

    def add(self, ids: list[int | None], found: list[str]) -> None:
        begin = len(self.documents)
        self.documents += [{"doc_id": i, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": ""} for i in ids]
        encoded = self.sides.encode(found)
        at = [begin + i for i, e in enumerate(encoded) if e is not None]
        if not at:
            return
        aligned = Aligned(self.sides, [e for e in encoded if e is not None])
        for name, values in (("n_a", aligned.n_a), ("n_b", aligned.n_b), ("n_groups", aligned.n_groups), ("n_links", aligned.n_links), ("groups_sha256", aligned.digests())):
            for i, v in zip(at, values if name == "groups_sha256" else values.tolist()):
                self.documents[i][name] = v
        place = np.array(at, np.uint64)
        for a, b, doc in aligned.links():
            pair = self.sides.radix_first(a).astype(np.uint64) * self.width + b.astype(np.uint64)
            self.parts.append(summed(pair << _DOC | place[doc]))
            self.records += len(self.parts[-1][0])

    def rows(self, run: int) -> Iterator[pa.RecordBatch]:
        """Blocks of heads (radix 0 and up) and the body (radix -1)."""
        keys, links = summed(np.concatenate([k for k, _ in self.parts]), np.concatenate([n for _, n in self.parts])) if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        pairs, n = summed(keys >> _DOC)
        radix = (pairs // (self.width * np.uint64(self.sides.span))).astype(np.int64)
        rows = []
        bounds = np.flatnonzero(np.concatenate([[True], radix[1:] != radix[:-1], [True]])) if len(pairs) else np.zeros(1, np.int64)
        for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            for block, lo in enumerate(range(begin, end, BLOCK)):
                hi = min(end, lo + BLOCK)
                rows.append({"run": run, "radix": int(radix[begin]), "block": block, "first": int(pairs[lo]), "pairs": packed(steps(pairs[lo:hi])), "n": packed(n[lo:hi].astype(np.uint32))})
        docs = np.diff((keys & np.uint64(MOST_DOCUMENTS - 1)).astype(np.uint16), prepend=np.uint16(0))
        rows.append({"run": run, "radix": -1, "block": 0, "pairs": packed(steps(pairs)), "n": packed(n.astype(np.uint32)), "docs": packed(docs), "links": packed(links.astype(np.uint32)), "documents": self.documents})
        for lo in range(0, len(rows), 64):
            yield pa.RecordBatch.from_pylist(rows[lo : lo + 64], _KINDS)


def runs(docs: DataFrame, a_path: str, b_path: str, run_records: int) -> DataFrame:
    """The written runs of all documents, as blocks of heads and bodies."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, number = Sides(a_path, b_path), TaskContext.get().partitionId() << 32
        run = Run(sides)
        for batch in batches:
            ids, found = batch.column(0).to_pylist(), texts(batch.column(1))
            lo = 0
            while lo < len(ids):
                hi, size = lo + 1, len(found[lo])
                while hi < len(ids) and hi - lo < 1000 and size + len(found[hi]) <= SLAB:
                    size += len(found[hi])
                    hi += 1
                run.add(ids[lo:hi], found[lo:hi])
                lo = hi
                if run.records >= run_records or len(run.documents) > MOST_DOCUMENTS - 1000:
                    yield from run.rows(number)
                    run, number = Run(sides), number + 1
        if run.documents:
            yield from run.rows(number)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialise(rows.mapInArrow(write, _RUN))


class Merge:
    """Heads of all runs in ascending order, added up; blocks come in by (radix, first pair)."""

    def __init__(self, per_a: int):
        self.per_a, self.radix = per_a, None
        self.reset()

    def reset(self) -> None:
        self.open: list[dict] = []
        self.heap: list[tuple[int, int]] = []  # (next pair, place in open)
        self.fresh = 0
        self.most: dict[int, int] = {}

    def push(self, row: dict) -> Iterator[dict]:
        if row["radix"] != self.radix:
            yield from self.finish()
            self.radix = row["radix"]
        elif self.fresh > max(64, len(self.open) // 2):
            yield from self.advance(row["first"])
        pairs = np.cumsum(unpacked(row["pairs"], np.uint64))
        n = unpacked(row["n"], np.uint32).astype(np.int64)
        heapq.heappush(self.heap, (row["first"], len(self.open)))
        self.open.append({"run": row["run"], "block": row["block"], "pairs": pairs, "n": n, "at": 0})
        self.fresh += 1

    def advance(self, bound: int | None) -> Iterator[dict]:
        """Count all pairs below the bound: no later block has any of them. Blocks that are through go back to their runs."""
        taken = []
        while self.heap and (bound is None or self.heap[0][0] < bound):
            _, i = heapq.heappop(self.heap)
            block = self.open[i]
            stop = len(block["pairs"]) if bound is None else int(np.searchsorted(block["pairs"], np.uint64(bound)))
            taken.append((i, block["at"], stop))
        if taken:
            keys = np.concatenate([self.open[i]["pairs"][lo:hi] for i, lo, hi in taken])
            order = np.argsort(keys, kind="stable")  # a merge of the sorted stretches
            ordered = keys[order]
            new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
            first = np.flatnonzero(new)
            counts = np.add.reduceat(np.concatenate([self.open[i]["n"][lo:hi] for i, lo, hi in taken])[order], first)
            side = (ordered[first] // np.uint64(self.per_a)).astype(np.int64)
            cut = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]]))
            for a, c in zip(side[cut].tolist(), np.maximum.reduceat(counts, cut).tolist()):
                self.most[a] = max(c, self.most.get(a, 0))
            back = np.empty(len(keys), np.int64)
            back[order] = counts[np.cumsum(new) - 1]
            at = 0
            for i, lo, hi in taken:
                block = self.open[i]
                block["n"][lo:hi] = back[at : at + hi - lo]
                block["at"] = hi
                at += hi - lo
                if hi < len(block["pairs"]):
                    heapq.heappush(self.heap, (int(block["pairs"][hi]), i))
                else:
                    yield {"run": block["run"], "radix": self.radix, "block": block["block"], "counts": packed(block["n"])}
        kept = sorted(i for _, i in self.heap)
        place = {i: k for k, i in enumerate(kept)}
        self.open = [self.open[i] for i in kept]
        self.heap = [(pair, place[i]) for pair, i in self.heap]
        self.fresh = 0

    def finish(self) -> Iterator[dict]:
        yield from self.advance(None)
        for a, c in self.most.items():
            yield {"a": a, "most": c}
        self.reset()


def counted(heads: DataFrame, per_a: int) -> DataFrame:
    """(run, radix, block, counts): the corpus-wide counts of each block's pairs; and rows (a, most), the largest of each A id."""
    kinds = pa.schema([("run", pa.int64()), ("radix", pa.int32()), ("block", pa.int32()), ("counts", pa.binary()), ("a", pa.int64()), ("most", pa.int64())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, held = Merge(per_a), []
        for batch in batches:
            for i in range(batch.num_rows):
                held += state.push({c: batch.column(c)[i].as_py() for c in ("run", "radix", "block", "first", "pairs", "n")})
                if len(held) >= 256:
                    yield pa.RecordBatch.from_pylist(held, kinds)
                    held = []
        held += state.finish()
        if held:
            yield pa.RecordBatch.from_pylist(held, kinds)

    ordered = heads.repartition("radix").sortWithinPartitions("radix", "first", "run", "block")
    return materialise(ordered.mapInArrow(merge, "run bigint, radix int, block int, counts binary, a bigint, most bigint"))


def align(docs: DataFrame, a_path: str, b_path: str, run_records: int = 1_000_000) -> DataFrame:
    """Per document (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and, over its links, n_best (those
    whose pair has the largest count of its A id) and count_sum."""
    sides = Sides(a_path, b_path)
    per_a, n_a, span = len(sides.b_bytes), len(sides.a_bytes), sides.span
    table = runs(docs, a_path, b_path, run_records)
    back = counted(table.where("radix >= 0").select("run", "radix", "block", "first", "pairs", "n"), per_a)
    most = np.zeros(span * RADICES, np.int64)  # a number for each id of the vocabulary
    found = back.where("a is not null").select("a", "most").toArrow()
    most[found.column("a").to_numpy()] = found.column("most").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(most)
    result = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups_sha256", pa.string())])

    def close(body: pa.Table, replies: pa.Table) -> pa.Table:
        row = body.to_pylist()[0]
        blocks = sorted(replies.select(["radix", "block", "counts"]).to_pylist(), key=lambda r: (r["radix"], r["block"]))
        n_docs = len(row["documents"])
        best, total = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
        if blocks:
            counts = np.concatenate([unpacked(b["counts"], np.int64) for b in blocks])
            pairs = np.cumsum(unpacked(row["pairs"], np.uint64))
            n, links = unpacked(row["n"], np.uint32), unpacked(row["links"], np.uint32).astype(np.int64)
            place = np.cumsum(unpacked(row["docs"], np.uint16), dtype=np.uint16)
            top = counts == shared.value[(pairs // np.uint64(per_a)).astype(np.int64)]
            np.add.at(total, place, links * np.repeat(counts, n))
            np.add.at(best, place, links * np.repeat(top, n))
        out = {c: [d[c] for d in row["documents"]] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
        return pa.table({f.name: pa.array({"n_best": best, "count_sum": total}[f.name] if f.name in ("n_best", "count_sum") else out[f.name], f.type) for f in result}, schema=result)

    bodies = table.where("radix < 0").select("run", "pairs", "n", "docs", "links", "documents").groupBy("run")
    replies = back.where("run is not null").select("run", "radix", "block", "counts").groupBy("run")
    return bodies.cogroup(replies).applyInArrow(close, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
