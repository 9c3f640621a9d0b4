"""Quality rules with host verdicts. Only DataFrame functions.

Each document is judged by rules on its own text: the base rule (too few words, or mostly repeated windows) and three
more (``RULES``: symbols, repeated lines, word length). The failures of each rule are summed by host (here: ``source``),
and each host's rate of each rule is shrunk towards the rate of all by a beta prior fitted to the hosts by moments.
Verdicts come back to documents:

- the base rule rejects by itself;
- a host whose shrunk rate of the base rule reaches ``HOST_LIMIT`` loses all its documents;
- a document that fails another rule goes unless its host is trusted in that rule, that is, has a shrunk rate under
  ``TRUSTED`` times the mean of the hosts: there, a single odd text is an exception and stays.

Defined results: null text has no words and fails the base rule; a null source is a host of its own;
no rows give no rows; rows that repeat are judged alike and each counts for its host; extra columns are ignored.

Repeated three-word windows are found by sorting, in each row, one long per window: the high bits of the
window's 64-bit hash, and its position in the low bits (as many as the number of words needs). Two different
windows of one text are taken for the same with a probability of about n*n/2 in 2^(64-log2 n): under 1e-7
for 2^PACKED_BITS words. Longer texts sort pairs of the whole hash and the position: under 1e-6 for 5 million words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_columns, written

LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
#: Texts of fewer words than 2 to this have hash and position of a window in one long.
PACKED_BITS = 13
#: A host goes when its shrunk rate of base failures reaches this.
HOST_LIMIT = 0.8
#: A host is trusted in a rule when its shrunk rate is under this share of the hosts' mean.
TRUSTED = 0.5
#: The other rules, as SQL over the counts: more than a symbol for ten words; more than half of the lines repeated; words
#: of under 2 or over 15 characters in the mean.
RULES = {
    "symbols": "10 * n_symbols > n_words",
    "lines": "2 * n_dup_lines > n_lines",
    "length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
}


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, source, text_hash, n_words, word_chars, n_symbols, n_dup_lines, n_lines (with a word), n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.expr("trim(BOTH ' \\t\\n\\u000b\\f\\r' FROM coalesce(text, ''))")
    words = F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    lines = F.expr(r"filter(split(coalesce(text, ''), '\n', -1), l -> length(trim(BOTH ' \t\n\u000b\f\r' FROM l)) > 0)")
    rows = own_columns(docs, "doc_id", "source", "text").select("doc_id", "source", F.xxhash64("text").alias("text_hash"), text.alias("text"), words.alias("w"))
    rows = rows.select(
        "doc_id", "source", "text_hash", "w",
        F.size("w").cast("long").alias("n_words"),
        (F.char_length("text") - F.regexp_count("text", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.when(F.instr("text", "\n") > 0, F.size(lines) - F.size(F.array_distinct(lines))).otherwise(0).cast("long").alias("n_dup_lines"),
        F.when(F.instr("text", "\n") > 0, F.size(lines)).otherwise((F.size("w") > 0).cast("int")).cast("long").alias("n_lines"),
        F.greatest(F.lit(1), F.ceil(F.log2(F.size("w") + 1.0))).cast("int").alias("b"),
    )
    packed = F.col("b") <= PACKED_BITS
    windows = F.expr("sort_array(transform(sequence(0, n_words - 3), i -> (xxhash64(w[i], w[i + 1], w[i + 2]) << b) | i))")
    pairs = F.expr("sort_array(transform(sequence(0, n_words - 3), i -> struct(xxhash64(w[i], w[i + 1], w[i + 2]) AS h, i AS i)))")
    rows = rows.withColumn("g", F.when((F.col("n_words") >= 4) & packed, windows).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("v", F.when(packed, F.array().cast("array<struct<h:bigint,i:bigint>>")).otherwise(pairs)).drop("w")
    twin = "filter(g, (x, j) -> (j > 0 AND shiftrightunsigned(g[greatest(j - 1, 0)] ^ x, b) = 0) OR (j < size(g) - 1 AND shiftrightunsigned(g[least(j + 1, size(g) - 1)] ^ x, b) = 0))"
    twins = "filter(v, (x, j) -> (j > 0 AND v[greatest(j - 1, 0)].h = x.h) OR (j < size(v) - 1 AND v[least(j + 1, size(v) - 1)].h = x.h))"
    placed = F.when(packed, F.expr(f"sort_array(transform({twin}, x -> x & ((1L << b) - 1)))")).otherwise(F.expr(f"sort_array(transform({twins}, x -> x.i))"))
    rows = rows.withColumn("p", placed).drop("g", "v")
    covered = F.expr("CASE WHEN size(p) = 0 THEN 0L ELSE 3L + aggregate(sequence(1, size(p) - 1), 0L, (s, j) -> s + least(3L, p[j] - p[j - 1])) END")
    covered = F.when(F.size("p") == 0, F.lit(0).cast("long")).when(F.size("p") == 1, F.lit(3).cast("long")).otherwise(covered)
    rows = rows.withColumn("n_repeat_words", covered).drop("p", "b")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def host_rates(judged: DataFrame) -> DataFrame:
    """source, n, and for each rule (base first) rate_<rule> and mean_<rule>.

    A rate is the host's, shrunk by the prior fitted to all hosts: its mean m is the mean of the hosts' rates and its
    weight s follows from their variance v, s = m(1-m)/v - 1, held between 1 and 1000; with one host, or all rates
    alike, s is 1000.
    """
    rules = {"base": "base_failed", **RULES}
    hosts = judged.groupBy("source").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.expr(f"CAST({rule} AS BIGINT)")).alias(f"bad_{name}") for name, rule in rules.items()])
    share = lambda name: F.col(f"bad_{name}") / F.col("n")
    fit = hosts.agg(*[f(share(name)).alias(f"{key}_{name}") for name in rules for key, f in (("mean", F.avg), ("spread", F.var_pop))])

    def weight(name: str):
        m, v = F.col(f"mean_{name}"), F.coalesce(F.col(f"spread_{name}"), F.lit(0.0))
        return F.when(v <= 0, F.lit(1000.0)).otherwise(F.least(F.lit(1000.0), F.greatest(F.lit(1.0), m * (1 - m) / v - 1)))

    fit = fit.select(*[f"mean_{name}" for name in rules], *[weight(name).alias(f"weight_{name}") for name in rules])
    shrunk = [((F.col(f"bad_{name}") + F.col(f"mean_{name}") * F.col(f"weight_{name}")) / (F.col("n") + F.col(f"weight_{name}"))).alias(f"rate_{name}") for name in rules]
    # one row of eight numbers beside each host
    return hosts.join(F.broadcast(fit)).select("source", "n", *shrunk, *[f"mean_{name}" for name in rules])


def quality_rules(docs: DataFrame) -> DataFrame:
    """The counts of every document, its text_hash, base_failed, failed (the other rules that count against it), host_rate
    (of the base rule) and kept."""
    judged = written(counted(docs), "quality")  # texts are read and counted once
    rates = host_rates(judged).withColumnRenamed("source", "_host").drop("n")
    out = judged.join(rates, judged["source"].eqNullSafe(rates["_host"]))
    against = [F.when(F.expr(rule) & (F.col(f"rate_{name}") >= TRUSTED * F.col(f"mean_{name}")), F.lit(name)) for name, rule in RULES.items()]
    out = out.withColumn("failed", F.array_compact(F.array(*against)))
    kept = ~F.col("base_failed") & (F.col("rate_base") < HOST_LIMIT) & (F.size("failed") == 0)
    return out.select(*judged.columns, "failed", F.col("rate_base").alias("host_rate"), kept.alias("kept"))
