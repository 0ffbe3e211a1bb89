import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from hitlake.llm import secrets as S
from hitlake.llm.common import utf8


def brute_base(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def test_base_spans_match_the_patterns_as_written():
    rng = random.Random(2)
    parts = ["password", "PassWD", "secret", "toKen", "api_key", "apikey", "=", ": ", " ", '"', "'", "AKIA", "AKIAZZZZ11112222", "0123456789abcdef" * 2, "abcdefgh1", "x", "ſecret=12345678", "é", "\n"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 12)))
        assert S.base_spans(text) == brute_base(text), text


def test_scan(spark, small, odd):
    model = S.train(S.labelled_samples(small))
    for df in (small, odd):
        texts = sorted((str(r["doc_id"]), r["text"] or "") for r in df.select("doc_id", "text").collect())
        got = sorted((str(r["doc_id"]), r["base_sha256"], r["n_assign"], r["n_access"], r["n_hex"]) for r in S.scan(df, model).collect())
        want = []
        for doc, text in texts:
            base = brute_base(text)
            want.append((doc, hashlib.sha256(",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest(), *[sum(k == n for _, k, _ in base) for n in range(3)]))
        assert got == sorted(want)


#: Ordinary runs that the models must not take (fixed values). Alphabets, rulers and numbers are of kinds that are trained on.
PLAIN = (
    "-" * 35, "=" * 60, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "1" * 23, "0123456789" * 3, "x" * 28, "+-" * 13, "QWERTYUIOPASDFGHJKLZXCVBNM", "Donaudampfschifffahrtsgesellschaft",
    "Kraftfahrzeughaftpflichtversicherung", "Rindfleischetikettierungsaufgabengesetz", "anticonstitutionnellement", "antidisestablishmentarianism", "electroencephalographically", "internationalization",
    "getElementsByClassName", "information_retrieval_engine", "TheQuickBrownFoxJumps", "configuration-management", "HTTPSConnectionPoolTimeoutError", "MAX_CONNECTION_POOL_SIZE", "user_profile_image_2023_final_v2",
    "some/path/to/the/library", "/usr/local/share/applications/mimeinfo", "src/main/java/org/apache/commons/lang3/StringUtils", "node_modules/typescript/lib/typescriptServices", "kubernetes-dashboard-metrics-scraper",
    "4952935900253052", "2024-01-31T12-00-00", "20240131120000", "2023-11-14-backup-full-weekly-03", "DE89370400440532013000", "550e8400-e29b-41d4-a716-446655440000", "THATREOUENIN", "HEITSCHBER",
)


def test_models_tell_random_from_ordinary(spark, small):
    """Fresh random strings of every kind from 24 characters on are found, ordinary runs of any length are not."""
    model = S.train(S.labelled_samples(small))
    rng = random.Random(11)
    for plain in PLAIN:
        assert model.score(plain) < 22 or model.score(plain) < 0.75 * len(plain), plain
    drawn = ["".join(rng.choices(a, k=rng.randint(24, 44))) for a in S.RANDOM_ALPHABETS[1:] for _ in range(100)]
    rows = [(i, f"the value {x} stands here, é, {PLAIN[i % len(PLAIN)]}") for i, x in enumerate(drawn)]
    got = {r["doc_id"]: r for r in S.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    hit = sum(f"markov:10:{10 + len(x)}" in got[i]["spans"].split(",") for i, x in enumerate(drawn))
    assert hit / len(drawn) > 0.97
    assert all(got[i]["n_markov"] <= 1 for i in got)


def test_scores_of_runs_are_those_of_the_models(spark, small):
    """The scores of all texts at once against the sum over a run's triples; runs never join two texts."""
    model = S.train(S.labelled_samples(small))
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcXYZ019_ é\n-", k=rng.randint(0, 60))) for _ in range(300)]
    data, offsets = utf8(pa.array(texts))
    start, end, score = model.runs(np.frombuffer("\n".join(texts).encode(), np.uint8), 1)
    joined = "\n".join(texts).encode()
    other = model.size - 1
    for a, b, s in zip(start.tolist(), end.tolist(), score.tolist()):
        codes = [other, other, *[int(model.codes[c]) for c in joined[a:b]]]
        assert s == pytest.approx(sum(float(model.ratio[x, y, z]) for x, y, z in zip(codes, codes[1:], codes[2:])), abs=1e-3)
    found = S.added_spans(data, offsets, model, 5.0, 0.1)
    for i, text in enumerate(texts):
        want = [(m.start(), m.end()) for m in re.finditer(rb"[A-Za-z0-9+/_=-]{2,}", text.encode()) if (v := model.score(m.group().decode())) >= 5 and v >= 0.1 * len(m.group())]
        assert found.get(i, []) == want
    assert S.all_spans("é aaaa", [], [(3, 7)]) == [(2, 3, 6)] and S.all_spans("é aaaa", [(2, 0, 4)], [(3, 7)]) == [(2, 0, 4)]


def test_redact(spark, odd):
    model = S.train(S.labelled_samples(odd))
    done = S.redact(odd, model)
    assert done.columns == odd.columns
    rows = {r["doc_id"]: r for r in done.collect()}
    assert "0123456789abcdef" not in rows[7]["text"] and "[REDACTED]" in rows[7]["text"] and rows[7]["n_chars"] == len(rows[7]["text"])
    assert rows[3]["text"] is None and rows[9]["text"] == "one" and done.count() == odd.count()


def test_empty(none):
    model = S.train(S.labelled_samples(none))
    assert S.scan(none, model).collect() == [] and S.redact(none, model).collect() == []


def test_secrets_inside_longer_runs(spark, small):
    """Behind a name, in a path or a compound: the span is the secret alone; ordinary runs of the same forms have none."""
    model = S.train(S.labelled_samples(small))
    rng = random.Random(21)
    forms = ("{}", "bearer:{}", "auth={}", "https://example.org/files/download/{}/index", "my-service-{}", "SESSION_KEY_ID={}", "export DATABASE_URL_VALUE={} # here", "{}-staging-eu-west")
    figures = {}
    for n in (24, 32):
        for form in forms:
            drawn = ["".join(rng.choices(S.ALPHABET[:62], k=n)) for _ in range(200)]
            df = spark.createDataFrame([(i, form.format(x)) for i, x in enumerate(drawn)], "doc_id long, text string")
            at = form.index("{")
            got = [f"markov:{at}:{at + n}" in r["spans"].split(",") for r in S.scan(df, model).collect()]
            figures[form, n] = sum(got) / len(got)
    print(figures)
    assert all(f >= (0.9 if n == 24 else 0.97) for (_, n), f in figures.items()), figures
    plain = [form.format(x) for form in forms for x in PLAIN if "550e" not in x]
    rows = S.scan(spark.createDataFrame(list(enumerate(plain)), "doc_id long, text string"), model).where("n_markov > 0").collect()
    assert [plain[r["doc_id"]] for r in rows] == []
