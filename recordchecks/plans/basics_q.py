"""Registered queries for the basic operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordchecks.operators import basics as B
from recordchecks.plans.registry import query
from recordchecks.session import shared_path
from recordchecks.sources.tables import TABLES, scan_csv, table

ASOF = "2024-01-31 00:00:00"


@query("sum_by_key", """
SELECT l_suppkey, sum(l_quantity) AS sum_qty FROM lineitem GROUP BY l_suppkey""")
def q_sum_by_key(spark, d):
    li = table(spark, d, "lineitem")
    return B.sum_by_key(li, "l_suppkey", "l_quantity", "sum_qty")


@query("sum_all", """
SELECT sum(l_quantity) AS total, count(*) AS n FROM lineitem""")
def q_sum_all(spark, d):
    return B.sum_all(table(spark, d, "lineitem"), "l_quantity")


@query("count_if", """
SELECT count(*) FILTER (WHERE l_quantity > 30) AS n FROM lineitem""")
def q_count_if(spark, d):
    return B.count_if(table(spark, d, "lineitem"), F.col("l_quantity") > 30)


@query("filter_gt", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 30""")
def q_filter_gt(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return B.filter_gt(li, "l_quantity", 30)


@query("actions_7d", f"""
SELECT user_id, count(*) AS n_actions FROM events
WHERE ts < TIMESTAMP '{ASOF}' AND ts > TIMESTAMP '{ASOF}' - INTERVAL 7 DAY
GROUP BY user_id""")
def q_actions_7d(spark, d):
    return B.actions_in_window(table(spark, d, "events"), "user_id", "ts", ASOF, 7)


@query("split_delimited", """
SELECT p_partkey, len(string_split(p_name, ' ')) AS n_parts,
       string_split(p_name, ' ')[1] AS first_part,
       string_split(p_name, ' ')[-1] AS last_part
FROM part""")
def q_split_delimited(spark, d):
    p = B.split_delimited(table(spark, d, "part").select("p_partkey", "p_name"),
                          "p_name", " ", "parts")
    return p.select("p_partkey", F.size("parts").alias("n_parts"),
                    F.get("parts", 0).alias("first_part"),
                    F.element_at("parts", -1).alias("last_part"))


def _marks(spark, d):
    """Packed numeric strings derived from lineitem: 1-4 parts, the fourth a
    letter (so it casts to NULL), width varying by line number."""
    li = table(spark, d, "lineitem")
    parts = F.array(
        F.col("l_quantity").cast("int").cast("string"),
        F.round(F.col("l_discount") * 100).cast("int").cast("string"),
        F.round(F.col("l_tax") * 100).cast("int").cast("string"),
        F.col("l_returnflag"))
    return li.select("l_orderkey", "l_linenumber",
                     F.array_join(F.slice(parts, 1, 1 + F.col("l_linenumber") % 4), "|")
                     .alias("marks"))


_MARKS_SQL = """
WITH m AS (
  SELECT l_orderkey, l_linenumber,
         array_to_string(list_slice([CAST(CAST(l_quantity AS INTEGER) AS VARCHAR),
                                     CAST(CAST(round(l_discount * 100) AS INTEGER) AS VARCHAR),
                                     CAST(CAST(round(l_tax * 100) AS INTEGER) AS VARCHAR),
                                     l_returnflag], 1, 1 + l_linenumber % 4), '|') AS marks
  FROM lineitem)"""


@query("split_to_columns", _MARKS_SQL + """
SELECT l_orderkey, l_linenumber,
  TRY_CAST(string_split(marks, '|')[1] AS INTEGER) AS sub_0,
  TRY_CAST(string_split(marks, '|')[2] AS INTEGER) AS sub_1,
  TRY_CAST(string_split(marks, '|')[3] AS INTEGER) AS sub_2,
  TRY_CAST(string_split(marks, '|')[4] AS INTEGER) AS sub_3
FROM m""")
def q_split_to_columns(spark, d):
    return B.split_to_columns(_marks(spark, d), "marks", r"\|")


@query("paren_extract", """
SELECT doc_id, CASE WHEN strpos(text, '(') > 0
                    THEN split_part(split_part(text, '(', 2), ')', 1) END AS paren
FROM documents""")
def q_paren_extract(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return B.paren_extract(docs, "text").select("doc_id", "paren")


@query("explode_rows", """
SELECT p_partkey, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS pos,
       unnest(string_split(p_name, ' ')) AS word
FROM part""")
def q_explode_rows(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.split("p_name", " ", -1).alias("w"))
    return B.explode_rows(p, "w", out="word", pos="pos")


@query("flatmap_expr", """
SELECT unnest(string_split(p_name, ' ')) AS token FROM part""")
def q_flatmap_expr(spark, d):
    p = table(spark, d, "part")
    return B.flatmap_expr(p, F.split("p_name", " ", -1), "token")


@query("map_expr", """
SELECT l_orderkey, l_linenumber, l_linenumber + 2 AS mapped FROM lineitem""")
def q_map_expr(spark, d):
    li = table(spark, d, "lineitem")
    return B.map_expr(li, F.col("l_linenumber") + 2, "mapped", keep=("l_orderkey", "l_linenumber"))


@query("dedup_rows", """
SELECT DISTINCT * FROM lineitem""")
def q_dedup_rows(spark, d):
    return B.dedup_rows(table(spark, d, "lineitem"))


@query("dedup_counts", """
WITH w AS (SELECT p_size, unnest(string_split(p_name, ' ')) AS word FROM part)
SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT p_size, word FROM w)) AS n_distinct
FROM w""")
def q_dedup_counts(spark, d):
    w = B.explode_rows(table(spark, d, "part").select("p_size", F.split("p_name", " ", -1).alias("w")),
                       "w", out="word")
    return B.dedup_counts(w)


@query("row_count", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES))
def q_row_count(spark, d):
    return B.row_counts({t: table(spark, d, t) for t in TABLES})


PART_SCHEMA = "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE"


@query("scan_csv", """
SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part""")
def q_scan_csv(spark, d):
    """S3: the whole part table written as headed CSV to the shared folder by Spark,
    then read back with an explicit schema."""
    path = shared_path(spark, "part_csv")
    table(spark, d, "part").write.option("header", True).csv(path)
    return scan_csv(spark, path, PART_SCHEMA)
