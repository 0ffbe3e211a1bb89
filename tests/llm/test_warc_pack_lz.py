import functools
import gzip
import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from hitlake.llm import lz_fingerprint as Z
from hitlake.llm import packing as P
from hitlake.llm import warc as W

BPE = public_tokenizers.path("byte_bpe_50k.json")


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string")


def test_round_trip(spark, tmp_path):
    long = "<p>" + "é" * 60
    rows = [(5, "http://x/5", long, "c"), (3, "http://x/3", long, "c"), (9, None, long, None), (4, "u", "short", None), (2, "u\r\nX: y", "short", None), (1, "u", None, None), (None, "u", long, None), (8, "u", "x" * 300_000, None)]
    files = W.write_archives(pages(spark, rows), str(tmp_path / "w"), file_bytes=600)
    got = {r["page_id"]: r for r in W.read_archives(files, payloads=True).collect()}
    assert len(got) == 8
    for page, _, html, _ in rows:
        data = (html or "").encode()
        r = got[page]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
        other = html == long and page != 3
        assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if other else ("response", None))
        assert bytes(r["payload"]) == (b"" if other else data)
    assert W.read_archives(W.write_archives(pages(spark, []))).collect() == []


def test_sf_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    both = rows.unionByName(rows.selectExpr("page_id + 1000000 as page_id", "url", "html"))
    got = {r["page_id"]: r["refers_to"] for r in W.read_archives(W.write_archives(both)).collect()}
    want = {}
    data = both.collect()
    first = {}
    for r in data:
        first[r["html"]] = min(first.get(r["html"], r["page_id"]), r["page_id"])
    for r in data:
        want[r["page_id"]] = first[r["html"]] if len((r["html"] or "").encode()) >= 100 and first[r["html"]] != r["page_id"] else None
    assert got == want


def test_members_are_read_one_by_one_and_damage_is_found():
    digest = hashlib.sha256(b"abc").hexdigest()
    one, two = W.record(1, "u", b"abc", 3, digest, None), W.record(2, "u", b"", 3, digest, 1)
    for chunk in (1, 7, 1 << 16):
        found = [W.parse(m) for m in W.members(io.BytesIO(one + two).read, chunk)]
        assert [(f["page_id"], f["record_type"], f["refers_to"]) for f in found] == [(1, "response", None), (2, "revisit", 1)]
    assert gzip.decompress(one).startswith(b"WARC/1.1\r\n")
    with pytest.raises(W.WarcError):
        list(W.members(io.BytesIO(one[:-9]).read))
    with pytest.raises(W.WarcError):
        W.parse(gzip.decompress(one).replace(b"abc", b"abd"))
    with pytest.raises(W.WarcError):
        W.parse(gzip.decompress(one) + b"x")
    with pytest.raises(W.WarcError):
        list(W.members(io.BytesIO(b"not gzip at all").read))


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def hugging(text):
    return tokenizer().encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_the_tokenizer(small):
    encoder = P.Encoder(BPE)
    rng = random.Random(3)
    parts = ["a", "B7", " ", "  ", "\n", "é", "'s", "!", "\t", "don't", "\x1c", "\x85", "<|endoftext|>", "字", " ", "²"]
    made = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(300)]
    for text in made + [r["text"] for r in small.limit(60).collect()]:
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == hugging(text), text


def test_added_token_in_a_text():
    assert P.Encoder(BPE).encode("x <|endoftext|> y") == [87, 220, 50256, 331]


def test_packing_does_not_depend_on_the_layout(spark, small):
    """Also with hundreds of copies of one row, which spread over the blocks."""
    docs = small.select("doc_id", "text").unionByName(spark.range(400).selectExpr("7L as doc_id", "'one and the same text' as text"))
    cut = P.materialise(P.pieces(docs, BPE))
    found = []
    for how in (cut.repartition(1), cut.repartition(5, "length"), cut.orderBy("ids_crc32")):
        rows = P.pack_pieces(P.materialise(how), block_pieces=300).collect()
        sequences = {}
        for r in rows:
            sequences.setdefault(r["sequence_id"], []).append((r["doc_id"], r["piece"], r["ids_crc32"], r["offset"]))
        found.append(sorted(sorted(s, key=str) for s in sequences.values()))
    assert found[0] == found[1] == found[2]


def check_packing(df, rows, capacity=1024):
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        by_doc.setdefault(str(r["doc_id"]), []).append(r)
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= capacity
    want = []
    for d in df.select("doc_id", "text").collect():
        ids = [*hugging(d["text"] or ""), 2]
        head = len(ids) % capacity or capacity
        cuts = [0, *range(head, len(ids) + 1, capacity)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((str(d["doc_id"]), i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    return len(by_sequence), sum(r["length"] for r in rows)


def test_pack_documents(small, odd, none):
    for df in (small, odd):
        sequences, total = check_packing(df, P.pack_documents(df, BPE).collect())
        assert sequences <= 1.02 * total / 1024 + 1
    assert P.pack_documents(none, BPE).collect() == []


def least_bins(lengths, capacity):
    best = [len(lengths)]
    lengths = sorted(lengths, reverse=True)

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= lengths[i] and rooms[k] not in rooms[:k]:
                go(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - lengths[i]])

    go(0, [])
    return best[0]


def test_pack_against_the_best_possible():
    rng = random.Random(9)
    worse = 0
    for _ in range(60):
        lengths = [rng.randint(1, 30) for _ in range(rng.randint(1, 9))]
        bins = P.pack(lengths, 30)
        assert sorted(x for b in bins for x in b) == sorted(lengths) and all(sum(b) <= 30 for b in bins)
        assert len(bins) <= len(P.best_fit(sorted(lengths, reverse=True), 30))
        worse += len(bins) > least_bins(lengths, 30)
    assert worse <= 1
    # A case where best fit decreasing is not the best and the search is.
    hard = [6, 5, 4, 4, 3, 2, 2, 2, 2]
    assert len(P.best_fit(hard, 10)) == 4 and len(P.pack(hard, 10)) == least_bins(hard, 10) == 3


def brute_phrases(data):
    seen, start = set(), 0
    for end in range(1, len(data) + 1):
        if data[start:end] not in seen:
            seen.add(data[start:end])
            start = end
    return seen


def test_phrases():
    rng = random.Random(1)
    for _ in range(100):
        data = bytes(rng.choices(b"abc", k=rng.randint(0, 200)))
        cut = rng.randint(0, len(data))
        whole = Z.Phrases().parse(data)
        head = Z.Phrases().parse(data[:cut])
        rest = head.copy().parse(data[cut:])
        assert len(whole.edges) == len(brute_phrases(data)) and rest.hashes == whole.hashes
        assert len(set(whole.hashes)) == len(whole.hashes)


def test_likeness_estimates_the_sets():
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(300)]
    a = " ".join(rng.choices(words, k=3000)).encode()
    b = a[: len(a) // 2] + " ".join(rng.choices(words, k=1500)).encode()
    sets = [brute_phrases(x) for x in (a, b)]
    exact = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    signs = [Z.Phrases().parse(x).signature(128) for x in (a, b)]
    assert abs(Z.likeness(*signs, 128) - exact) < 0.15
    assert Z.likeness(signs[0], signs[0], 128) == 1.0


def brute_signature(data, size=128):
    """The smallest hashes of the phrase set, one phrase after the other."""
    wide, found = (1 << 64) - 1, set()
    for phrase in brute_phrases(data):
        h = 1
        for byte in phrase:
            h = (h * 1_000_003 + byte + 1) & 0x1FFFFFFFFFFFFFFF
        for shift in (29, 32):
            h = (h ^ h >> shift) * 0x9E3779B97F4A7C15 & wide
        found.add(h >> 32)
    return sorted(found)[:size]


def brute_likeness(a, b, size=128):
    if not a or not b:
        return float(len(a) == len(b))
    least = sorted({*a, *b})[:size]
    return len([h for h in least if h in a and h in b]) / len(least)


def test_whole_rows_against_brute_force(small, odd):
    """Fingerprints of texts and edited texts, and both likenesses."""
    for df in (small, odd):
        low = -(1 << 63)
        docs = sorted((low if r["doc_id"] is None else r["doc_id"], r["text"] is not None, r["text"] or "", r["doc_id"]) for r in df.select("doc_id", "text").collect())
        want = []
        for i, (_, _, text, doc) in enumerate(docs):
            following = docs[(i + 1) % len(docs)][2]
            half = len(text) // 2
            own, other, following = (brute_signature(t.encode()) for t in (text, text[: len(text) - half] + following[:half], following))
            digits = lambda s: "".join(f"{h:08x}" for h in s)
            want.append((str(doc), digits(own), digits(other), brute_likeness(own, other), brute_likeness(own, following)))
        got = [(str(r["doc_id"]), r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in Z.compare_with_next(df, ranges=3).collect()]
        assert sorted(got) == sorted(want)


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_compare_with_next(small, odd, none, ranges):
    for df in (small, odd):
        low = -(1 << 63)
        docs = sorted(((low if r["doc_id"] is None else r["doc_id"], r["text"] is not None, r["text"] or "", r["doc_id"]) for r in df.select("doc_id", "text").collect()))
        want = []
        for i, (_, _, text, doc) in enumerate(docs):
            following = docs[(i + 1) % len(docs)][2]
            half = len(text) // 2
            want.append((str(doc), len(text), hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()))
        rows = Z.compare_with_next(df, ranges=ranges).collect()
        assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in rows) == sorted(want)
        assert all(0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 for r in rows)
    assert Z.compare_with_next(none, ranges=ranges).collect() == []
    one = small.limit(1)
    assert Z.compare_with_next(one, ranges=ranges).first()["near_next"] == 1.0
