"""Exact and near duplicates of records."""

from __future__ import annotations

import difflib
from collections import Counter
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import cleaners as C
from ledgerloom.operators.links import joined_groups
from ledgerloom.sources.shared import written

#: The order of rows within a file.
ORDER = ("source_file", "source_sheet", "source_row")


def with_identity(rows: DataFrame) -> DataFrame:
    cols = ("name", "mobile_1", "community", "building_cluster", "unit_number", "plot_number")
    return rows.withColumn("identity_hash", C.identity_hash(*[F.col(c) for c in cols]))


def exact_duplicates(rows: DataFrame, *, scope: str = "file", known: DataFrame | None = None) -> DataFrame:
    """Add ``duplicate_flag`` = duplicate_identity_hash to valid rows whose identity a valid row before them, or a stored record, has.

    ``scope`` is 'file' (each file on its own) or 'global' (across files); ``known`` holds
    identity_hash (and source_file, for 'file') of stored records. Only the smallest place of each identity is
    found by a partial aggregate and joined back, so an identity that many rows share is no hot group.
    """
    keys = ["identity_hash"] + (["source_file"] if scope == "file" else [])
    place = F.struct(*ORDER)
    first = rows.where("is_valid").groupBy(*keys).agg(F.min(place).alias("_first"))
    out = rows.join(first, keys, "left")
    seen = F.coalesce(place > F.col("_first"), F.lit(False))
    if known is not None:
        stored = known.select(*keys).distinct().withColumn("_known", F.lit(True))
        out = out.join(stored, keys, "left")
        seen = seen | F.coalesce("_known", F.lit(False))
    return out.withColumn("duplicate_flag", F.when(F.col("is_valid") & seen, F.lit("duplicate_identity_hash"))).drop("_first", "_known")


def ratio(a: str, b: str) -> float:
    """Ratcliff/Obershelp similarity."""
    return difflib.SequenceMatcher(None, a, b).ratio()


def name_ratio(a: Column, b: Column) -> Column:
    """:func:`ratio` of two name keys; the one function that Spark has no builtin for."""

    @F.pandas_udf(T.DoubleType())
    def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([ratio(i, j) for i, j in zip(a, b)], dtype="float64")

    return ratios(a, b)


def levenshtein(a: str, b: str) -> float:
    """1 - edit distance / longer length."""
    before = list(range(len(b) + 1))
    for i, x in enumerate(a):
        now = [i + 1]
        for j, y in enumerate(b):
            now.append(min(before[j + 1] + 1, now[j] + 1, before[j] + (x != y)))
        before = now
    return 1 - before[-1] / max(len(a), len(b), 1)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


METRICS = {"ratio": ratio, "levenshtein": levenshtein}
_WALKED = "source_file string, source_sheet string, source_row long, verdict string, score double, match long"


def _common(a: str, b: str) -> int:
    """Characters that two strings share at most, each as often as both hold it."""
    return sum((Counter(a) & Counter(b)).values())


def _walk(rows: DataFrame, threshold: float, metric: str) -> DataFrame:
    """The verdict on each row, in order of place within each group: accepted, exact, property or phone.

    The state is what the rows before have left: identities accepted, and the last accepted name of each property and phone. A key leaves it
    with its last row, so the state holds open keys only, and rows stream past it in batches.
    """
    measure = METRICS[metric]

    def walk(batches):
        @lru_cache(1 << 16)
        def alike(a: str, b: str) -> float:
            if not a or not b or a == b:
                return float(bool(a) and a == b)
            # neither measure can exceed this
            most = 2 * _common(a, b) / (len(a) + len(b)) if metric == "ratio" else _common(a, b) / max(len(a), len(b))
            return measure(a, b) if most >= threshold - 1e-9 else 0.0

        group, last, accepted = object(), {}, set()
        for batch in batches:
            columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
            verdicts, scores, matches = [], [], []
            for of, file, row, key, prop, phone, identity, copies, ends in zip(*(columns[c] for c in ("_group", "source_file", "source_row", "_key", "_property", "_phone", "identity_hash", "_copies", "_ends"))):
                if of != group:
                    group, last, accepted = of, {}, set()
                verdict, score, match = "accepted", None, None
                if copies and (file, identity) in accepted:
                    verdict = "exact"
                else:
                    for kind, block in (("property", prop), ("phone", phone)):
                        before = last.get((file, kind, block)) if block is not None else None
                        if before is not None and (s := alike(key, before[0])) >= threshold:
                            verdict, score, match = kind, s, before[1]
                            break
                    else:
                        for kind, block in (("property", prop), ("phone", phone)):
                            if block is not None:
                                last[file, kind, block] = (key, row)
                        if copies:
                            accepted.add((file, identity))
                for end, kind, block in zip(ends, ("property", "phone"), (prop, phone)):
                    if end:
                        last.pop((file, kind, block), None)
                if ends[2]:
                    accepted.discard((file, identity))
                verdicts.append(verdict)
                scores.append(score)
                matches.append(match)
            yield pa.RecordBatch.from_arrays(
                [batch.column("source_file"), batch.column("source_sheet"), batch.column("source_row"), pa.array(verdicts, pa.string()), pa.array(scores, pa.float64()), pa.array(matches, pa.int64())],
                names=["source_file", "source_sheet", "source_row", "verdict", "score", "match"],
            )

    dealt = rows.repartition("_group").sortWithinPartitions("_group", *ORDER, "_key", "_property", "_phone", "identity_hash")
    return dealt.mapInArrow(walk, _WALKED)


def near_duplicates(rows: DataFrame, *, threshold: float = 0.85, metric: str = "ratio") -> DataFrame:
    """The rows with the near-duplicate verdict: fuzzy_match_score, fuzzy_matched_row (a source_row) and duplicate_flag.

    Within a file, rows are judged in order of their place. A valid row whose identity an accepted row before it has is an exact duplicate. A named row is a near
    duplicate if the last accepted named row of its property has a name at least ``threshold`` alike, or else that of its first phone. Every other
    row is accepted. So a verdict depends on the verdicts before it, and rows that could
    decide on each other form a group: those joined by shared properties and phones. Groups are walked side by side, each as one stream;
    rows that share neither are not moved. Names are compared with one other name a block, never with all of it.
    A copy of a near duplicate is judged anew, as its first row was not accepted; only groups that hold such copies are walked twice.
    Repeated places get one verdict. ``metric`` is 'ratio' or 'levenshtein'.
    """
    base = rows.withColumns({"_key": C.name_key(F.col("name")), "_property": C.property_key(F.col("community"), F.col("building_cluster"), F.col("unit_number"), F.col("plot_number")), "_phone": F.nullif(F.col("mobile_1"), F.lit("")), "_exact": F.col("duplicate_flag").isNotNull()})
    named = base.where(F.col("is_valid") & (F.coalesce("name", F.lit("")) != "") & (F.col("_property").isNotNull() | F.col("_phone").isNotNull()))
    named = written(named.select(*ORDER, "_key", "_property", "_phone", "identity_hash", "_exact", F.when(F.col("_property").isNotNull(), F.xxhash64("source_file", F.lit("property"), "_property")).alias("_p"), F.when(F.col("_phone").isNotNull(), F.xxhash64("source_file", F.lit("phone"), "_phone")).alias("_m")))
    firsts = named.where("NOT _exact")
    place = F.struct(*ORDER)
    shared = lambda block: firsts.where(F.col(block).isNotNull()).groupBy(F.col(block).alias(f"{block}_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    with_blocks = written(firsts.join(shared("_p"), F.col("_p") == F.col("_p_id"), "left").join(shared("_m"), F.col("_m") == F.col("_m_id"), "left").where("_p_id IS NOT NULL OR _m_id IS NOT NULL"))
    groups = written(joined_groups(with_blocks.where("_p_id IS NOT NULL AND _m_id IS NOT NULL").select(F.col("_p_id").alias("a"), F.col("_m_id").alias("b"))))
    node = F.coalesce("_p_id", "_m_id")
    grouped = with_blocks.join(groups, node == F.col("node"), "left").withColumn("_group", F.coalesce("of", node)).drop("node", "of", "_p_id", "_m_id")

    def ordered(part: DataFrame, copies: bool) -> DataFrame:
        """With the ends of each key: whether a row is the last of its property, phone and identity."""
        end = lambda key: part.where(F.col(key).isNotNull()).groupBy("_group", "source_file", key).agg(F.max(place).alias("_last"))
        for number, key in enumerate(("_property", "_phone", "identity_hash")):
            ends = end(key).select(F.col("_group").alias("_g"), F.col("source_file").alias("_f"), F.col(key).alias("_k"), "_last")
            part = part.join(ends, (F.col("_group") == F.col("_g")) & (F.col("source_file") == F.col("_f")) & (F.col(key) == F.col("_k")), "left").withColumn(f"_end{number}", F.coalesce(place == F.col("_last"), F.lit(False))).drop("_g", "_f", "_k", "_last")
        return part.withColumns({"_ends": F.array("_end0", "_end1", "_end2"), "_copies": F.lit(copies)}).drop("_end0", "_end1", "_end2")

    once = written(_walk(ordered(grouped, False), threshold, metric))
    # copies of rows that were not accepted: their groups are walked again with all copies in place
    file_identity = ["source_file", "identity_hash"]
    refused = grouped.join(once.where("verdict <> 'accepted'").select(*ORDER).distinct(), list(ORDER), "left_semi").select(*file_identity, "_group").distinct()
    again = written(named.where("_exact").select(*file_identity).distinct().join(refused, file_identity).select("_group").distinct())
    inside = grouped.join(again, "_group", "left_semi")
    copies = named.where("_exact").join(inside.select(*file_identity, "_group").distinct(), file_identity)
    twice = _walk(ordered(inside.unionByName(copies), True), threshold, metric)
    kept = once.join(inside.select(*ORDER).distinct(), list(ORDER), "left_anti")
    found = kept.unionByName(twice).groupBy(*[F.col(c).alias(f"_{c}") for c in ORDER]).agg(F.max(F.struct("verdict", "score", "match")).alias("_hit"))
    same = (F.col("source_file") == F.col("_source_file")) & (F.col("source_sheet").eqNullSafe(F.col("_source_sheet"))) & (F.col("source_row") == F.col("_source_row"))
    near = F.col("_hit.verdict").isin("property", "phone")
    percent = F.floor(F.col("_hit.score") * 100).cast("string")
    flag = F.when(near, F.concat(F.lit("fuzzy_duplicate_"), F.col("_hit.verdict"), F.lit("_match_"), percent, F.lit("pct"))).when(F.col("_hit.verdict") == "accepted", F.lit(None)).otherwise(F.col("duplicate_flag"))
    out = base.join(written(found.where("_hit.verdict <> 'exact'")), same, "left").withColumns({
        "fuzzy_match_score": F.when(near, F.floor(F.col("_hit.score") * 1000 + 0.5) / 1000),
        "fuzzy_matched_row": F.when(near, F.col("_hit.match")),
        "duplicate_flag": flag,
    })
    return out.drop("_key", "_property", "_phone", "_exact", "_hit", *[f"_{c}" for c in ORDER])


def known_identities(rows: DataFrame, records: DataFrame, *, scope: str = "global") -> DataFrame:
    """Rows whose identity a stored record has (same file or anywhere)."""
    keys = ["identity_hash"] + (["source_file"] if scope == "file" else [])
    return rows.join(records.select(*keys).distinct(), keys, "left_semi")
