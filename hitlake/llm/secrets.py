"""Secret scan: fixed patterns plus two character Markov models compared by log-likelihood ratio.

Base kinds (leftmost, non-overlapping, per kind; spans are the whole match in code points, end exclusive):
`assign` (a key word, `:` or `=`, a value of 8+ characters), `access` (AKIA..., 16+ characters), `hex` (32+ digits).
The models, second-order chains over a small alphabet that both back off by Witten-Bell to first order and to uniform,
are trained from labelled samples: random strings (label 1) and ordinary identifiers (label 0: words of the documents
as they stand, common words, their compounds and paths, numbers, rulers, alphabets). One triple adds between -4 and
`MOST` nats, so that no few unseen triples decide. Every run of token characters, of any length, is scored; one outside
base spans is added as kind `markov` if its ratio is at least `min_llr` nats, which pay the prior odds against a secret,
and at least `min_mean` nats a character, so that length alone does not make a secret. Where a run as a whole is ordinary,
its pieces between the separators `+/_=-` are scored the same way, each by itself, and the span is the piece: so a secret
behind a name (`SESSION_KEY_ID=...`), in a path or a compound does not pay for the ordinary part. A random run loses the
name before its last `=` and ordinary words at its ends (`narrowed`). Short runs cannot reach
`min_llr` (at most `MOST` nats a character): strings under about 16 characters are seldom found.

Defined cases: null text = empty text (no spans); repeated rows each give a row; other columns are ignored by `scan`
and kept by `redact`; an empty table gives an empty result; without documents to learn from, the fixed samples remain.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitlake.llm.common import bounded_sample, materialise, texts, utf8

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # a run is taken whole, so the length may stand in the pattern
HEX = re.compile(r"[0-9a-f]{32,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Character classes that random strings are drawn from, as labelled samples.
RANDOM_ALPHABETS = ("0123456789abcdef", ALPHABET[:62], ALPHABET[:64], "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
#: Ordinary words (fixed values): they keep words known that the documents' own sample does not hold.
COMMON = """about access account action address after again align allow along always amount answer application archive array article assembly
background balance because before between binary block boundary buffer build button cache calendar callback category change character check
client cluster collection column command common company compare complete component configuration connection constant container content context
counter country create current customer data database default delete description destination device dictionary directory document domain download
element enable engine environment error event example exception expression factory feature field filter format forward function general generate
government group handler header height history identifier image implementation index information initial input instance integer interface internal
international item journal keyboard knowledge language large layout length level library limit listener location machine manager matrix member message
method model module mountain name network number object observer operation option order output package parameter parser password pattern people
performance philosophy picture position previous private process product profile program project property protocol provider public quality quarter query
question record reference register release remote report request resource response result retrieval return sample schedule schema science search second
section security select sequence server service session settings shadow signal simple source standard statistics status storage stream string structure
student subject support switch symbol system table target template temporary thread threshold through timeout together token transaction transfer
transform translate university update upload user validate value variable vector version visible volume window without worker workflow writer
arbeit auskunft bahn beamte dampf donau fahrt gesellschaft geschwindigkeit handwerk kapitän kranken lebens mittel rechts schiff schutz straßen
überwachung unternehmen verordnung versicherung wirtschaft zeitung bonjour développement gouvernement maison naturellement quelque toujours
acontecimiento ayuntamiento ciudad desarrollo entonces mañana siempre trabajo""".split()
SEPARATORS = "+/_=-"
VALUE = 8  # characters of a piece that counts as random, and of a value behind `=`
ORDINARY = 4  # characters of an ordinary word at an end
LEAST, MOST = -4.0, 2.5  # nats that one triple may add


class RatioModel:
    """log P(char | two before; random) - log P(...; identifier) for every triple of symbols."""

    def __init__(self, counts: dict[tuple[int, str], int]):
        size = len(ALPHABET) + 1  # the last symbol: start, or any other character
        self.codes = np.full(1 << 8, size - 1, np.int64)
        for i, c in enumerate(ALPHABET):
            self.codes[ord(c)] = i
        self.letters = self.codes.copy()  # without the separators
        self.letters[[ord(c) for c in SEPARATORS]] = size - 1
        table = np.zeros((2, size, size, size))
        for (label, gram), n in counts.items():
            table[(label, *self.codes[np.frombuffer(gram.encode("latin-1", "replace"), np.uint8)])] += n

        def smoothed(seen: np.ndarray, below: np.ndarray) -> np.ndarray:
            kinds = np.maximum((seen > 0).sum(axis=-1, keepdims=True), 1)
            return (seen + kinds * below) / (seen.sum(axis=-1, keepdims=True) + kinds)

        first = smoothed(table.sum(axis=1), np.full((2, 1, size), 1 / size))
        second = smoothed(table, first[:, None])
        self.ratio = np.clip(np.log(second[1]) - np.log(second[0]), LEAST, MOST).astype(np.float32)
        self.size = size

    def score(self, token: str) -> float:
        """The log-likelihood ratio of one run."""
        return float(sum(self.runs(np.frombuffer(token.encode("latin-1", "replace"), np.uint8), 1)[2]))

    def runs(self, data: np.ndarray, least: int, pieces: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, log-likelihood ratio) of every run of token characters in UTF-8 bytes that is `least` or longer; with `pieces`, separators end a run."""
        c = (self.letters if pieces else self.codes)[data]
        inside = c < self.size - 1
        edges = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
        start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        long = end - start >= least
        start, end = start[long], end[long]
        if not len(start):
            return start, end, np.zeros(0)
        sizes = end - start
        first = np.cumsum(sizes) - sizes
        at = np.repeat(start - first, sizes) + np.arange(sizes.sum())
        one = c[at]
        two, three = np.roll(one, 1), np.roll(one, 2)
        two[first] = three[first] = self.size - 1  # two symbols before a run count as its start
        three[first[sizes > 1] + 1] = self.size - 1
        value = self.ratio.reshape(-1)[(three * self.size + two) * self.size + one].astype(np.float64)
        return start, end, np.add.reduceat(value, first)


def train(samples: DataFrame) -> RatioModel:
    """Fit both models from labelled samples (value string, label int: 1 random, 0 identifier).

    The character triples are counted by Spark; the table that comes back has at most 2 * 68**3 rows whatever the input.
    """
    start = "\x00\x00"
    plain = F.regexp_replace(F.col("value"), r"[^A-Za-z0-9+/_=\-]", "\x00")
    padded = F.concat(F.lit(start), plain)
    grams = samples.where(F.length("value") > 0).select(F.col("label").cast("int").alias("label"), padded.alias("p"))
    grams = grams.select("label", F.explode(F.transform(F.sequence(F.lit(1), F.length("p") - 2), lambda i: F.substring(F.col("p"), i, F.lit(3)))).alias("gram"))
    rows = grams.groupBy("label", "gram").count().collect()
    return RatioModel({(r["label"], r["gram"]): r["count"] for r in rows})


def fixed_samples(n: int, seed: int = 7) -> list[tuple[str, int]]:
    """`n` random strings (1), and ordinary ones (0): common words alone and joined, numbers, dates, rulers, alphabets."""
    rng = random.Random(seed)
    out = [("".join(rng.choices(rng.choice(RANDOM_ALPHABETS), k=rng.randint(12, 64))), 1) for _ in range(n)]
    word = lambda: rng.choice(COMMON)
    joins = (lambda a, b, c: a + b + c, lambda a, b, c: a + b, lambda a, b, c: a + b.title() + c.title(), lambda a, b, c: a.title() + b.title() + c.title(), lambda a, b, c: f"{a}_{b}_{c}", lambda a, b, c: f"{a}-{b}-{c}", lambda a, b, c: f"/{a}/{b}/{c}", lambda a, b, c: f"{a}_{b}".upper(), lambda a, b, c: f"{a}{rng.randint(0, 99)}", lambda a, b, c: f"{a}_{rng.randint(1900, 2100)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}")
    for w in COMMON:
        out += [(v, 0) for v in (w, w.title(), w.upper())]
    for _ in range(n):
        out.append((rng.choice(joins)(word(), word(), word()), 0))
    for _ in range(n // 4):
        out.append(("".join(rng.choices("0123456789", k=rng.randint(4, 24))), 0))
        out.append((f"{rng.randint(1900, 2100)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", 0))
    rows = ("abcdefghijklmnopqrstuvwxyz", "0123456789", "9876543210", "qwertyuiop", "asdfghjkl", "zxcvbnm", "yxcvbnm")
    for _ in range(n // 40):
        out += [(rng.choice(ALPHABET) * rng.randint(3, 80), 0), (rng.choice(["-=", "=-", "_-", "+-", "/-", "--+", "==+", "__/"]) * rng.randint(3, 30), 0)]
        out += [(r * rng.randint(1, 2), 0) for r in rows] + [(r.upper(), 0) for r in rows]
    out += [(c * k, 0) for c in ALPHABET for k in (3, 5, 8, 13, 21, 34, 55)]
    return out


def labelled_samples(docs: DataFrame, sample_docs: int = 1000, sample_words: int = 20_000, sample_random: int = 12_000, seed: int = 7) -> DataFrame:
    """(value, label): identifiers of a bounded sample of documents and of fixed words, and seeded random strings.

    `sample_docs` documents (smallest hash of doc_id), `sample_words` distinct runs of them (base secrets taken out) as
    they stand, their words joined in camelCase and snake_case, and `sample_random` strings of each fixed kind bound it.
    """
    spark: SparkSession = docs.sparkSession
    some = bounded_sample(docs.select("doc_id", F.col("text").cast("string").alias("text")), sample_docs, "doc_id")
    for pattern in (r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+", "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}"):
        some = some.withColumn("text", F.regexp_replace("text", pattern, " "))
    runs = some.select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9+/_=\-]{3,}"), F.lit(0))).alias("value")).distinct()
    runs = materialise(bounded_sample(materialise(runs), sample_words, "value"))
    words = runs.where(F.col("value").rlike("^[A-Za-z]+$"))
    compound = words.select("value", F.coalesce(F.lag("value").over(_order()), F.lit("name")).alias("other"))
    joined = compound.select(F.explode(F.array(F.concat("value", F.initcap("other")), F.concat_ws("_", F.lower("value"), F.lower("other")), F.concat_ws("-", F.lower("value"), F.lower("other")), F.concat_ws("/", "value", "other"), F.concat("value", "other"))).alias("value"))
    made = spark.createDataFrame(pd.DataFrame(fixed_samples(sample_random, seed), columns=["value", "label"])).withColumn("label", F.col("label").cast("int"))
    return runs.unionByName(joined).withColumn("label", F.lit(0)).unionByName(made)


def _order():
    from pyspark.sql import Window

    return Window.orderBy(F.xxhash64("value"), "value")  # over the bounded word sample only


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind as index of KINDS, end), sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def added_spans(data: np.ndarray, offsets: np.ndarray, model: RatioModel, min_llr: float, min_mean: float, pieces: bool = False) -> dict[int, list[tuple[int, int]]]:
    """For each text (by place) with any: the byte spans of runs (or pieces of runs) that the models call random. All texts are scored at once."""
    split = np.zeros(len(data) + 1, bool)
    split[offsets] = True
    found: dict[int, list[tuple[int, int]]] = {}
    least = int(np.ceil(min_llr / MOST))
    lo = 0
    while lo < len(offsets) - 1:  # texts of about 1 MiB at a time, as every byte takes some 50 here; a run never crosses from one text to the next
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + (1 << 20), "right")) - 1)
        part = data[offsets[lo] : offsets[hi]]
        gaps = offsets[lo:hi] - offsets[lo] + np.arange(hi - lo)
        spaced = np.full(len(part) + hi - lo, 32, np.uint8)
        keep = np.ones(len(spaced), bool)
        keep[gaps] = False
        spaced[keep] = part
        start, end, score = model.runs(spaced, least, pieces)
        hit = (score >= min_llr) & (score >= min_mean * (end - start))
        for a, b in zip(start[hit].tolist(), end[hit].tolist()):
            i = int(np.searchsorted(gaps, a, "right")) - 1
            found.setdefault(lo + i, []).append((a - int(gaps[i]) - 1, b - int(gaps[i]) - 1))
        lo = hi
    return found


def narrowed(run: np.ndarray, a: int, b: int, model: RatioModel, min_mean: float) -> tuple[int, int]:
    """A random run (its bytes and places) without a name before its last `=` and without ordinary words at its ends.

    An end is cut at a piece of ORDINARY characters or more that is likelier ordinary; shorter ones tell too little.
    """
    begin = bytes(run[: max(0, len(run) - VALUE)]).rfind(b"=") + 1
    start, end, score = model.runs(run[begin:], 1, pieces=True)
    start, end = start + begin, end + begin
    strong = np.flatnonzero((end - start >= VALUE) & (score >= min_mean * (end - start)))
    if not len(strong):
        return a, b
    plain = np.flatnonzero((end - start >= ORDINARY) & (score < 0))
    before, after = plain[plain < strong[0]], plain[plain > strong[-1]]
    return a + (int(start[before[-1] + 1]) if len(before) else begin), a + int(end[after[0] - 1]) if len(after) else b


def random_spans(data: np.ndarray, offsets: np.ndarray, model: RatioModel, min_llr: float, min_mean: float) -> dict[int, list[tuple[int, int]]]:
    """The runs that the models call random, without ordinary pieces at their ends, and random pieces of the other runs."""
    whole = added_spans(data, offsets, model, min_llr, min_mean)
    for i, runs in whole.items():
        base = int(offsets[i])
        whole[i] = [narrowed(data[base + a : base + b], a, b, model, min_mean) for a, b in runs]
    for i, found in added_spans(data, offsets, model, min_llr, min_mean, pieces=True).items():
        runs = whole.get(i, [])
        whole[i] = runs + [(a, b) for a, b in found if not any(s < b and a < e for s, e in runs)]
    return whole


def all_spans(text: str, base: list[tuple[int, int, int]], raw: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """The base spans, and those of the models (places of UTF-8 bytes) that overlap none of them."""
    if not raw:
        return base
    data = text.encode()
    places = [(len(data[:a].decode()), len(data[:b].decode())) for a, b in raw]
    return sorted(base + [(a, 3, b) for a, b in places if not any(s < b and a < e for s, _, e in base)])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, model: RatioModel, min_llr: float = 22.0, min_mean: float = 0.75) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size, 68**3 numbers

    @F.arrow_udf("struct<n_assign: bigint, n_access: bigint, n_hex: bigint, base_sha256: string, spans: string, n_markov: bigint>")
    def find(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            rows = []
            added = random_spans(*utf8(column), shared.value, min_llr, min_mean)
            for i, text in enumerate(texts(column)):
                base = base_spans(text)
                spans = all_spans(text, base, added.get(i, []))
                count = [sum(k == kind for _, k, _ in spans) for kind in range(4)]
                rows.append((*count[:3], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), count[3]))
            names, kinds = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov"), (pa.int64(),) * 3 + (pa.string(),) * 2 + (pa.int64(),)
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(6)], names=list(names))

    return docs.select("doc_id", find(F.col("text").cast("string")).alias("found")).select("doc_id", "found.*")


def redact(docs: DataFrame, model: RatioModel, min_llr: float = 22.0, min_mean: float = 0.75, mark: str = "[REDACTED]") -> DataFrame:
    """The documents with every span replaced by `mark` (overlapping spans by one); n_chars, if there, follows the text.

    Documents without a secret come back unchanged, null texts as null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def clean(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            out = []
            added = random_spans(*utf8(column), shared.value, min_llr, min_mean)
            for i, text in enumerate(column.to_pylist()):
                spans = all_spans(text, base_spans(text), added.get(i, [])) if text else []
                parts, at = [], 0
                for s, _, e in spans:
                    if s >= at:
                        parts += [text[at:s], mark]
                    at = max(at, e)
                out.append("".join([*parts, text[at:]]) if spans else text)
            yield pa.array(out, pa.string())

    done = docs.withColumn("text", clean(F.col("text").cast("string")))
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done
