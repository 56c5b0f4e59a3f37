"""Synthetic registers over the star-schema tables.

Each view is a list of (column, expression) in the part of SQL that Spark and DuckDB share, so
both engines start a query from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.shared import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str | None], by: str) -> str:
    """One of the values by a whole number."""
    cases = " ".join(f"WHEN {i} THEN {v if v is None else chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39)}".replace("None", "NULL") for i, v in enumerate(values))
    return f"CASE {by} % {len(values)} {cases} END"


def _pad(x: str, n: int) -> str:
    return f"lpad(CAST({x} AS STRING), {n}, '0')"


_FIRST = ["Mohammed", "Mohd", "Fatima", "Fatma", "Ahmed", "Ahmad", "John", "Maria"]
_LAST = ["Al Rashid", "Al-Rashid", "Khan", "Smith", "Haddad", "Garcia", "Osman"]

#: A register of owners: customer joined to nation, with each tenth row repeated (copy 1) and each
#: tenth after it repeated under a variant of its name (copy 2).
REGISTER = [
    ("source_file", "concat('register_', CAST(k % 4 AS STRING), '.csv')"),
    ("source_sheet", "CASE WHEN k % 2 = 0 THEN 'Owners' ELSE 'Sheet1' END"),
    ("source_row", "k + copy * 1000000"),
    ("name", f"CASE WHEN k % 13 = 4 THEN NULL WHEN k % 41 = 7 THEN concat('Owners Data #', CAST(k AS STRING)) ELSE concat({_pick(['Mr. ', '  ', '', '', '', '[ab12] '], 'k')}, {_pick(_FIRST, '(k % 64)')}, ' ', {_pick(_LAST, 'k')}, CASE WHEN copy = 2 THEN ' LLC' ELSE '' END) END"),
    ("mobile_1", f"CASE k % 8 WHEN 0 THEN concat('050', {_pad('k', 7)}) WHEN 1 THEN concat('971|50-', {_pad('k', 7)}) WHEN 2 THEN concat('O50', {_pad('k', 7)}) WHEN 3 THEN 'n/a' WHEN 4 THEN '12345' WHEN 5 THEN concat('0044 20 ', {_pad('k', 8)}) WHEN 6 THEN concat('97100971', lpad(CAST(k AS STRING), 8, '5')) END"),
    ("mobile_2", f"CASE k % 6 WHEN 0 THEN concat('+971 50 ', {_pad('k', 7)}) WHEN 1 THEN '5.0655e10' WHEN 2 THEN '43920430' WHEN 3 THEN '7.4995E+21' WHEN 4 THEN concat('54', {_pad('k', 7)}) END"),
    ("mobile_3", f"CASE k % 9 WHEN 0 THEN 'abc' WHEN 1 THEN concat('1415555', {_pad('k % 10000', 4)}) END"),
    ("email_address", "CASE k % 5 WHEN 0 THEN concat('User', CAST(k AS STRING), '@Example.com, other@y.com') WHEN 1 THEN 'not-an-email' WHEN 2 THEN concat('  p', CAST(k AS STRING), '@mail.ae ') WHEN 3 THEN 'N/A' END"),
    ("community", "CASE WHEN k % 9 = 0 THEN 'DAMAC HILLS 2' WHEN k % 9 = 1 THEN 'dubai hills' WHEN k % 9 = 2 THEN 'AL-BARSHA SOUTH 3' WHEN k % 4 = 0 THEN n_name WHEN k % 4 = 1 THEN 'TOTAL OWNER DETAILS' WHEN k % 4 = 2 THEN concat(n_name, ' 1044') END"),
    ("sub_community", _pick(["Park  Point", "Sidra", None, "-", "Maple 2"], "k")),
    ("building_cluster", _pick(["Tower 5", None, "  Rimal 3 ", "N/A", "Block C"], "(k % 25)")),
    ("unit_number", "CASE k % 7 WHEN 0 THEN concat('A-', CAST(k % 300 AS STRING)) WHEN 1 THEN 'G1-' WHEN 2 THEN concat(CAST(k % 90 AS STRING), '-s') WHEN 3 THEN '--' END"),
    ("plot_number", "CASE WHEN k % 11 = 3 THEN concat('P', CAST(k % 50 AS STRING)) END"),
    ("plot_reg_no", "CASE WHEN k % 12 = 3 THEN concat('R ', CAST(k AS STRING)) END"),
    ("dmno", "CASE WHEN k % 15 = 3 THEN CAST(k % 70 AS STRING) END"),
    ("dmsubno", "CASE WHEN k % 30 = 3 THEN '0' END"),
    ("size", "CASE k % 7 WHEN 0 THEN '1,533.74' WHEN 1 THEN concat(CAST(k % 200 + 1 AS STRING), ' sqm') WHEN 2 THEN '85.5 m2' WHEN 3 THEN 'AED0' WHEN 4 THEN CAST(k * 37 AS STRING) WHEN 5 THEN 'large' END"),
    ("bedroom", _pick(["2 BHK", "3", "studio apt", "26", "Penthouse", "retail", "4 B/R", "duplex", None], "k")),
    ("party_type", _pick(["Buyer", "SELLER", "buying", "A", None], "k")),
    ("pi_number", "CASE WHEN k % 10 = 5 THEN concat('PI', CAST(k AS STRING)) END"),
    ("nationality", _pick(["UAE", "u.a.e.", "INDIA", "uk", "USA", "Egypt", "SAUDI-ARABIA"], "k")),
    ("property_type", _pick(["Villa", "villa", "Apartment", None], "k")),
    ("developer", _pick(["Emaar  Properties", None, "DAMAC", None, "unknown"], "(k % 35)")),
    ("project", _pick([None, "Sidra Villas", "Golf Place 1", None, "Hills"], "(k % 45)")),
    ("record_date", f"CASE k % 9 WHEN 0 THEN concat('20', {_pad('k % 24', 2)}, '-', {_pad('k % 12 + 1', 2)}, '-', {_pad('k % 28 + 1', 2)}) WHEN 1 THEN concat(CAST(k % 28 + 1 AS STRING), '/', CAST(k % 12 + 1 AS STRING), '/2021') WHEN 2 THEN '12/25/2024' WHEN 3 THEN concat({_pad('k % 28 + 1', 2)}, '-', {_pad('k % 12 + 1', 2)}, '-2019') WHEN 4 THEN concat(CAST(k % 28 + 1 AS STRING), '.', CAST(k % 12 + 1 AS STRING), '.2018') WHEN 5 THEN '2020/2/29' WHEN 6 THEN 'sometime' WHEN 7 THEN '2023-01-05 10:20:30' END"),
    ("procedure_value", _pick(["AED 1,200,000", "n/a", "0", "950000.50", None], "k")),
]

_COPIES = "(copy = 0 OR (copy = 1 AND k % 10 = 0) OR (copy = 2 AND k % 10 = 1))"


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owners' register as raw text, spread over all cores: its cleaning is dear, and a scan gives a small file to one task."""
    people = spread(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey"), "k")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = people.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where(_COPIES)
    return rows.selectExpr("k", "copy", *[f"{e} AS {c}" for c, e in REGISTER])


REGISTER_SQL = f"""register AS (SELECT k, copy, {', '.join(f'{e} AS {c}' for c, e in REGISTER)}
FROM (SELECT c_custkey AS k, n_name, copy FROM customer JOIN nation ON c_nationkey = n_nationkey CROSS JOIN (SELECT 0 AS copy UNION ALL SELECT 1 UNION ALL SELECT 2) copies WHERE {_COPIES.replace('k %', 'c_custkey %')}) base)"""

#: Reference developments: parts under their suppliers.
DEVELOPMENTS = [
    ("ord", "p_partkey"),
    ("name", f"concat({_pick(['Tower', 'Sidra', 'Golf Place', 'Rimal', 'Park Point', 'Hills', 'Maple'], 'p_partkey')}, ' ', CAST(p_partkey % 40 AS STRING), CASE WHEN p_partkey % 3 = 0 THEN ' Residences' ELSE '' END)"),
    ("emirate", "'Dubai'"),
    ("region", "concat('Region ', CAST(p_size % 7 AS STRING))"),
    ("developer", "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE concat('Developer ', CAST(p_partkey % 10 AS STRING)) END"),
    ("dev_type", "p_type"),
    ("confidence", _pick(["High", "medium", "low", None], "p_size")),
]


def developments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*[f"{e} AS {c}" for c, e in DEVELOPMENTS])


DEVELOPMENTS_SQL = f"developments AS (SELECT {', '.join(f'{e} AS {c}' for c, e in DEVELOPMENTS)} FROM part)"

#: Owners by PI number, and the properties that carry the places.
OWNERS = [("source_file", "concat('dld_', CAST(o_orderkey % 5 AS STRING))"), ("source_row", "o_orderkey"), ("pi_number", "concat(CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE '' END, CAST(o_orderkey AS STRING))"), ("name", "concat('Owner ', CAST(o_custkey AS STRING))"), ("unit_number", "CASE WHEN o_orderkey % 6 = 0 THEN 'own' END"), ("building_cluster", "CAST(NULL AS STRING)"), ("size", "CAST(NULL AS STRING)")]
PROPERTIES = [("source_file", "concat('dld_', CAST(l_orderkey % 5 AS STRING))"), ("source_row", "((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey"), ("pi_number", "CAST(l_orderkey AS STRING)"), ("unit_number", "concat('U', CAST(l_linenumber AS STRING))"), ("building_cluster", "CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE concat('B', CAST(l_partkey % 9 AS STRING)) END"), ("size", "CAST(CAST(l_quantity AS INT) AS STRING)")]


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {c}" for c, e in OWNERS])


def properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_orderkey % 8 <> 1").selectExpr(*[f"{e} AS {c}" for c, e in PROPERTIES])


OWNERS_SQL = f"owners AS (SELECT {', '.join(f'{e} AS {c}' for c, e in OWNERS)} FROM orders), properties AS (SELECT {', '.join(f'{e} AS {c}' for c, e in PROPERTIES)} FROM lineitem WHERE l_orderkey % 8 <> 1)"
