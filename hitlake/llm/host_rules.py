"""Host-level quality rules, native DataFrame expressions only.

Each document is measured (words, symbols, repeated lines, repeated 3-word windows). Rule failures are added up by host
(the `source` column; null is a host of its own) before anything is shuffled, each host's failure rate is shrunk with a
beta prior whose parameters are fitted to the rates of all hosts by the method of moments, and the rate is joined
back to the documents. There it is the prior of each document: host and document decide together. The document's
evidence is its symbols as a share of their limit plus its repeated lines as a share of theirs; half a limit in all says
nothing, and each doubling makes failing `2 ** POWER` times as likely. A document goes if the odds of its host times its
evidence say that it rather fails than not. So the worse a host, the less its documents may be off: a document at a whole
limit goes on ordinary hosts and stays on those that hardly ever fail; one without symbols and repeats stays on any host.

Base rules (either fails the document, whatever its host): fewer than 50 words; over half of the words inside 3-word
windows found twice or more in the text. Strict rules: symbols over a tenth of the word characters; repeated lines over
30 in 100 of the words. For the host's failures a document counts if it fails any rule.

Defined cases: null text = no words (fails); repeated rows each give a row and count each; empty table, empty result;
other columns are ignored by `verdicts` and kept by `keep_documents`; names used inside begin with `_hl_`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitlake.llm.common import GAP, materialise

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MOST_SENT_HOSTS = 100_000  # rows of a name and a number
POWER = 4
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body) -> Column:
    """Bind a costly expression once inside an expression."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, each counted once.

    Windows become (hash, position) pairs, sorted so that equal windows stand together; the positions of windows with an
    equal neighbour are sorted again, and each adds as many words as it lies past the one before, 3 at most.
    """
    windows = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")))
    same = lambda s, x, i: x["h"].eqNullSafe(F.get(s, i)["h"])  # noqa: E731  past the ends: null, never equal
    again = lambda s: F.filter(s, lambda x, i: same(s, x, i + 1) | same(s, x, i - 1))
    covered = lambda p: F.aggregate(p, F.struct(F.lit(-3).alias("at"), F.lit(0).cast("bigint").alias("n")), lambda acc, x: F.struct(x.alias("at"), (acc["n"] + F.least(F.lit(3), x - acc["at"])).alias("n")), lambda acc: acc["n"])
    found = _let(F.sort_array(windows(words)), lambda s: _let(F.sort_array(F.transform(again(s), lambda x: x["p"])), covered))
    return F.when(F.size(words) >= 4, found).otherwise(F.lit(0)).cast("bigint")


def measure(docs: DataFrame) -> DataFrame:
    """All columns of docs plus `_hl_` measures."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    solid = F.length(F.translate(text, BLANKS, ""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    with_words = docs.withColumns(
        {
            "_hl_words": F.filter(F.split(text, GAP), lambda x: x != ""),
            "_hl_word_chars": solid.cast("bigint"),
            "_hl_n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint"),
            "_hl_n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
        }
    )
    words = F.col("_hl_words")
    done = with_words.withColumns({"_hl_n_words": F.size(words).cast("bigint"), "_hl_n_repeat_words": repeat_words(words)}).drop("_hl_words")
    failed = (F.col("_hl_n_words") < 50) | (100 * F.col("_hl_n_repeat_words") > 50 * F.col("_hl_n_words"))
    strict = (10 * F.col("_hl_n_symbols") > F.col("_hl_word_chars")) | (100 * F.col("_hl_n_dup_lines") > 30 * F.col("_hl_n_words"))
    return done.withColumns({"_hl_base_failed": failed, "_hl_strict_failed": strict})


def host_verdicts(measured: DataFrame) -> DataFrame:
    """(_hl_host, docs, failures, rate): failures added up by host and shrunk with a fitted beta prior."""
    hosts = measured.groupBy(F.col("source").alias("_hl_host")).agg(F.count("*").alias("docs"), F.count(F.when(F.col("_hl_base_failed") | F.col("_hl_strict_failed"), 1)).alias("failures"))
    rates = hosts.agg(F.avg(F.col("failures") / F.col("docs")).alias("mean"), F.var_pop(F.col("failures") / F.col("docs")).alias("spread"), F.avg(1 / F.col("docs")).alias("thin"))
    # Between-host variance: the variance of the rates less what sampling documents alone would give.
    m = F.col("mean")
    between = F.greatest(F.col("spread") - m * (1 - m) * F.col("thin"), m * (1 - m) / 1000, F.lit(1e-9))
    strength = F.greatest(m * (1 - m) / between - 1, F.lit(1e-3))
    prior = rates.select((m * strength + 0.5).alias("alpha"), ((1 - m) * strength + 0.5).alias("beta"))
    rate = (F.col("failures") + F.col("alpha")) / (F.col("docs") + F.col("alpha") + F.col("beta"))
    return hosts.join(F.broadcast(prior)).withColumn("rate", rate).drop("alpha", "beta")  # prior: one row


def evidence(symbols: Column, word_chars: Column, dup_lines: Column, words: Column) -> Column:
    """How much likelier the measures make it that the document fails: (twice the shares of the two limits) ** POWER."""
    shares = 20 * symbols / F.greatest(word_chars, F.lit(1)) + 20 * dup_lines / (3 * F.greatest(words, F.lit(1)))
    return _let(shares, lambda x: reduce(Column.__mul__, [x] * POWER))


def _judge(measured: DataFrame) -> DataFrame:
    """Host verdicts joined back. A host table of checked, small size is sent to the tasks, so that texts stay where they
    are; a larger one meets the documents in a shuffle join, whose hot hosts adaptive execution splits.
    """
    hosts = materialise(host_verdicts(measured).select("_hl_host", F.col("rate").alias("_hl_rate")))
    few = hosts.count() <= MOST_SENT_HOSTS
    joined = measured.join(F.broadcast(hosts) if few else hosts, measured["source"].eqNullSafe(hosts["_hl_host"]))
    fails = F.col("_hl_rate") * evidence(*[F.col(f"_hl_{c}") for c in ("n_symbols", "word_chars", "n_dup_lines", "n_words")])
    judged = joined.withColumn("_hl_fail_chance", fails / (fails + (1 - F.col("_hl_rate"))))
    return judged.withColumn("_hl_kept", ~F.col("_hl_base_failed") & (F.col("_hl_fail_chance") <= 0.5))


def verdicts(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the measures, base_failed, kept, host_rate, fail_chance (of the strict rules alone)."""
    measured = materialise(measure(docs.select("doc_id", "text", "source")).drop("text"))
    names = [F.col(f"_hl_{c}").alias(c) for c in (*MEASURES, "base_failed", "kept")]
    return _judge(measured).select("doc_id", *names, F.col("_hl_rate").alias("host_rate"), F.col("_hl_fail_chance").alias("fail_chance"))


def keep_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns."""
    return _judge(materialise(measure(docs))).where("_hl_kept").select(*docs.columns)
