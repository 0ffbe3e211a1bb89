"""Cross-tokenizer alignment against a plain nested-loop version."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from hitlake.llm import alignment as A

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def brute(rows):
    """Tokens of both libraries as they are, links token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_side, b_side = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_side.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    documents, counts = [], Counter()
    for doc_id, text in rows:
        groups = []
        if text:
            a = a_side.encode(" " + text, add_special_tokens=False)
            a_bytes = [bytes(byte_of[c] for c in a_side.id_to_token(i)) for i in a.ids]
            b = b_side.encode(text)
            b_bytes = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(b_side.id_to_piece, b)]
            raw = (" " + text).encode()
            if b"".join(a_bytes) == raw == b"".join(b_bytes):
                ends = lambda side: [sum(map(len, side[: i + 1])) for i in range(len(side))] if len(side) < 300 else __import__("itertools").accumulate(map(len, side))
                a_ends, b_ends = list(ends(a_bytes)), list(ends(b_bytes))
                both, i, j = sorted(set(a_ends) & set(b_ends)), 0, 0
                for end in both:
                    left, right = [], []
                    while i < len(a_ends) and a_ends[i] <= end:
                        left.append(a.ids[i])
                        i += 1
                    while j < len(b_ends) and b_ends[j] <= end:
                        right.append(b[j])
                        j += 1
                    groups.append((left, right))
        documents.append((doc_id, groups))
        counts.update({(x, y) for left, right in groups for x in left for y in right})
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for doc_id, groups in documents:
        links = [(x, y) for left, right in groups for x in left for y in right]
        text = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((doc_id, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), sha))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_alignment_matches_brute_force(small, odd):
    for df in (small, odd):
        want = brute([tuple(r) for r in df.select("doc_id", "text").collect()])
        assert rows_of(A.align(df, BPE, PIECES)) == want
        assert rows_of(A.align(df.repartition(5), BPE, PIECES, run_records=3000)) == want  # many runs


def test_odd_texts(spark, monkeypatch):
    found = ["a▁b", "<|endoftext|> and <s> </s> <0x41> <unk>", "\x00\x01\r\n\t  \n", "字字🙂é́‮�", " leading  and trailing  ", "x" * 5000, "ab" * 3000 + " " * 700, "　ﬁ Ⅷ²", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(found)] + [(1, found[1]), (None, found[3])], "doc_id long, text string")
    want = brute([tuple(r) for r in df.collect()])
    got = rows_of(A.align(df, BPE, PIECES))
    assert got == want
    assert (0, 0, 0, 0, 0, 0, 0, "") in got  # U+2581 does not come back as itself


def test_links_of_a_large_group_in_stretches(monkeypatch):
    monkeypatch.setattr(A, "MOST_LINKS", 7)
    sides = A.Sides(BPE, PIECES)
    encoded = [e for e in sides.encode(["🙂🙂字 mixed ﷽ text", "plain words here", "ﷺﷺﷺ"]) if e is not None]
    aligned = A.Aligned(sides, encoded)
    stretches = list(aligned.links())
    assert len(stretches) > 3 and sum(len(s[0]) for s in stretches) == aligned.n_links.sum()
    assert Counter(d for s in stretches for d in s[2].tolist()) == {i: n for i, n in enumerate(aligned.n_links.tolist()) if n}


def test_merge_keeps_few_blocks_open():
    import numpy as np

    rng = np.random.default_rng(1)
    runs = [np.unique(rng.integers(0, 5000, 900)).astype(np.uint64) for _ in range(200)]
    rows = [{"run": r, "radix": 0, "block": b, "first": int(p[lo]), "pairs": A.packed(A.steps(p[lo : lo + 20])), "n": A.packed(np.ones(len(p[lo : lo + 20]), np.uint32))} for r, p in enumerate(runs) for b, lo in enumerate(range(0, len(p), 20))]
    state, out, most_open = A.Merge(100), [], 0
    for row in sorted(rows, key=lambda r: r["first"]):
        out += state.push(row)
        most_open = max(most_open, len(state.open))
    out += state.finish()
    want = Counter(p for r in runs for p in r.tolist())
    got = {(r["run"], r["block"]): A.unpacked(r["counts"], np.int64).tolist() for r in out if "run" in r}
    assert len(got) == len(rows) and most_open < 2.5 * len(runs)
    assert all(got[r["run"], r["block"]] == [want[p] for p in runs[r["run"]][20 * r["block"] : 20 * r["block"] + 20].tolist()] for r in rows)
    assert {r["a"]: r["most"] for r in out if "a" in r} == {a: max(n for p, n in want.items() if p // 100 == a) for a in {p // 100 for p in want}}


def test_empty_table(none):
    assert A.align(none, BPE, PIECES).collect() == []


@pytest.mark.parametrize("values", [[], [5], [0, 0, 7, 1 << 40]])
def test_packing_of_columns(values):
    import numpy as np

    column = np.array(values, np.uint64)
    assert np.cumsum(A.unpacked(A.packed(A.steps(column)), np.uint64)).tolist() == values
