"""Rules on whole texts, and verdicts on the hosts that the texts come from. Spark functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import kept

#: White space that parts words, as a set for trimming and as a pattern.
BLANKS = " \t\n\x0b\x0c\r"
BLANK = r"[\x20\x09-\x0D]"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _after(values: Column, n: int) -> Column:
    """The array without its first ``n`` items."""
    return F.slice(values, n + 1, F.greatest(F.size(values), F.lit(1)))


def _repeated_words(windows: Column) -> Column:
    """How many words lie in windows (hashes, in order, of three words each) that occur more than once."""

    def starts(ordered):
        same = F.zip_with(ordered, _after(ordered, 1), lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])))
        return F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))

    ordered = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    cover = _let(_let(ordered, starts), lambda at: F.aggregate(F.zip_with(at, _after(at, 1), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))), F.lit(0).cast("long"), lambda n, x: n + x))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), cover).otherwise(F.lit(0).cast("long"))


def text_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per document: id, host, n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words.

    Words are runs of characters other than space and \\x09-\\x0D; null and empty texts have none and
    count 0 everywhere. Only the three columns named are read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim("text", F.lit(BLANKS))
    words = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), text.alias("text")).withColumn("words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK + "+")))
    hashed = words.select(
        "id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        _let(F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""), lambda lines: F.struct(F.size(lines).cast("long").alias("n"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("dup"))).alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    pairs = F.zip_with("hashes", _after(F.col("hashes"), 1), lambda a, b: F.xxhash64(a, b))
    triples = F.slice(F.zip_with(pairs, _after(F.col("hashes"), 2), lambda a, b: F.xxhash64(a, b)), 1, F.greatest(F.size("hashes") - 2, F.lit(0)))
    return hashed.select("id", "host", "n_words", "word_chars", "n_symbols", F.col("lines.n").alias("n_lines"), F.col("lines.dup").alias("n_dup_lines"), _let(triples, _repeated_words).alias("n_repeat_words"))


def judged(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", worst_rate: float = 0.5, least_strength: float = 1.0, most_strength: float = 10_000.0) -> DataFrame:
    """Per document its counts, whether it fails the base rules, and whether it and its host are kept.

    A document breaks a rule if it fails the base (under 50 words, or over half of its words in
    repeated three-word windows), or if over a tenth of its word characters are symbols, or over
    half of its lines (those with a word) repeat an earlier one. Each host's share of rule-breaking documents is shrunk towards the
    corpus: with a beta prior whose mean is the corpus rate and whose strength comes from the spread of
    host rates beyond sampling noise (method of moments, held within the two bounds), the host's
    rate is (failed + strength * mean) / (n + strength). A host above ``worst_rate`` loses all its
    documents; base failures go in any case. A null host is a host of its own. The host table has a
    row for each host; its join is left to the adaptive planner, which splits large hosts.

    Returns id_col, the counts, base_failed, broken (any rule), host_docs, host_rate, host_kept,
    kept. An empty table gives an empty result.
    """
    counts = text_counts(docs, id_col=id_col, text_col=text_col, host_col=host_col)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = kept(counts.withColumn("base_failed", base).withColumn("broken", base | (10 * F.col("n_symbols") > F.col("word_chars")) | (2 * F.col("n_dup_lines") > F.col("n_lines"))))
    hosts = rows.groupBy(F.col("host").alias("of")).agg(F.count(F.lit(1)).alias("host_docs"), F.count_if("broken").alias("failed"))
    rate = F.col("failed") / F.col("host_docs")
    spread = hosts.agg((F.sum("failed") / F.sum("host_docs")).alias("mean"), F.sum("host_docs").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(rate * rate * F.col("host_docs")).alias("squares"))
    # variance of host rates, less what sampling alone would give
    noise = F.col("mean") * (1 - F.col("mean")) * F.col("k") / F.col("n")
    between = F.greatest(F.col("squares") / F.col("n") - F.col("mean") * F.col("mean") - noise, F.lit(1e-12))
    prior = spread.select("mean", F.least(F.greatest(F.col("mean") * (1 - F.col("mean")) / between - 1, F.lit(least_strength)), F.lit(most_strength)).alias("strength"))
    shrunk = hosts.crossJoin(F.broadcast(prior)).select("of", "host_docs", ((F.col("failed") + F.col("strength") * F.col("mean")) / (F.col("host_docs") + F.col("strength"))).alias("host_rate"))  # prior: one row
    return rows.join(shrunk, F.col("host").eqNullSafe(F.col("of"))).select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "broken", "host_docs", "host_rate", (F.col("host_rate") <= worst_rate).alias("host_kept"), (~F.col("base_failed") & (F.col("host_rate") <= worst_rate)).alias("kept")
    )
