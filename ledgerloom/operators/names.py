"""Pairs of similar names without comparing all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.dedup import levenshtein_similarity, name_ratio


def _numbered(tokens: Column, mark: str) -> Column:
    """The tokens, told apart where one occurs again."""
    return F.transform(tokens, lambda t, i: F.concat(F.lit(mark), t, F.lit("#"), F.size(F.filter(F.slice(tokens, F.lit(1), i), lambda x: x == t)).cast("string")))


def rare_tokens(names: DataFrame, by: list[str], key: str, threshold: float) -> DataFrame:
    """(by, key, token): two of the rarest pairs of letters of each name at a time, such that two similar names share one such token.

    Similarity t leaves two names of T letters together at most (1 - t) T that do not match, and each of these parts one matching pair of
    neighbouring letters. So they share n = (1.5 t - 1) T - 1 pairs at least, and of a name's pairs, rarest first, all but the last n - 2
    hold two that are shared. Names so short that n is under two give their rarest letters instead, of which t T / 2 match.
    """
    slope, length = 1.5 * threshold - 1, F.length(key)
    shortest = F.ceil(length * threshold / (2 - threshold) - 1e-9)
    pairs = F.when(length > 1, F.transform(F.sequence(F.lit(1), length - 1), lambda i: F.substring(key, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    letters = F.when(length <= int(2 / slope) + 1, F.filter(F.split(key, ""), lambda c: c != "")).otherwise(F.array().cast("array<string>"))
    held = names.select(*by, key).distinct().withColumns({"_pairs": pairs, "_letters": letters})
    both = F.explode(F.array(F.struct(F.lit(2).alias("kind"), _numbered(F.col("_pairs"), "2").alias("tokens")), F.struct(F.lit(1).alias("kind"), _numbered(F.col("_letters"), "1").alias("tokens"))))
    tokens = held.select(*by, key, both.alias("_t")).select(*by, key, F.col("_t.kind").alias("_kind"), F.size("_t.tokens").alias("_all"), F.explode("_t.tokens").alias("token"))
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("_held_by"))  # as many as there are pairs of letters
    needed = F.when(F.col("_kind") == 2, F.greatest(F.ceil(slope * (length + shortest) - 1 - 1e-9), F.lit(2))).otherwise(F.greatest(F.ceil(threshold * (length + shortest) / 2 - 1e-9), F.lit(1)))
    rarest = F.array_sort(F.collect_list(F.struct("_held_by", "token")))  # a name's own tokens
    first = tokens.join(common, "token").groupBy(*by, key, "_kind", "_all").agg(F.transform(rarest, lambda t: t["token"]).alias("_rare")).withColumn("_rare", F.slice("_rare", F.lit(1), F.greatest(F.lit(0), F.col("_all") - needed + F.col("_kind")).cast("int")))
    twos = F.flatten(F.transform("_rare", lambda t, i: F.transform(F.slice("_rare", i + 2, F.size("_rare")), lambda u: F.concat(t, F.lit(" "), u))))
    return first.select(*by, key, F.explode(F.when(F.col("_kind") == 2, twos).otherwise(F.col("_rare"))).alias("token"))


def similar_names(names: DataFrame, by: list[str], *, key: str = "key", threshold: float = 0.85, metric: str = "ratio") -> DataFrame:
    """(by, a, b, score) of all pairs of distinct names, a before b, of one block that are ``threshold`` or more alike.

    An inverted index over rare pairs of letters, two at a time, gives candidates, and no similar pair is lost; lengths that exclude each other are passed over, and what is
    left is compared. So the work follows the names that share two rare pairs of letters and not the square of a block.
    ``metric`` is 'ratio' or 'levenshtein'; ``threshold`` lies above 2/3 and under 1. Null and empty names have no partner. Blocks with nulls in ``by`` have none either.
    """
    if not 2 / 3 < threshold < 1:
        raise ValueError("the threshold must lie between 2/3 and 1")
    posted = rare_tokens(names.where(F.coalesce(key, F.lit("")) != ""), by, key, threshold)
    left, right = posted.select(*by, "token", F.col(key).alias("a")), posted.select(*by, "token", F.col(key).alias("b"))
    longest = F.length("a") + F.length("b")
    candidates = left.join(right, [*by, "token"]).where((F.col("a") < F.col("b")) & (2 * F.least(F.length("a"), F.length("b")) >= threshold * longest)).select(*by, "a", "b").distinct()
    measure = name_ratio if metric == "ratio" else levenshtein_similarity
    return candidates.withColumn("score", measure(F.col("a"), F.col("b"))).where(F.col("score") >= threshold)
