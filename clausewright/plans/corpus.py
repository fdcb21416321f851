"""Query inputs derived from the star-schema tables by SQL that Spark and DuckDB both read.

Clauses come from line items: numbers, quantities, references, citations,
vague words and definitions, all from integers, so both engines build equal texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.schemas import COMMITMENTS
from clausewright.sources.staging import stage

NUMBERED = """SELECT *, l_partkey % 50 AS k, CAST(l_linenumber AS STRING) || '.' || CAST(l_partkey % 9 + 1 AS STRING) AS n,
             row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS o FROM {lineitem}"""
CLAUSES = """
SELECT 'ord_' || CAST(l_orderkey AS STRING) || '::' || lpad(CAST(o - 1 AS STRING), 5, '0') AS clause_id,
       'ord_' || CAST(l_orderkey AS STRING) AS doc_id, 'T' || CAST(l_orderkey % 7 AS STRING) AS tender_id,
       l_linenumber AS page, CAST(o AS BIGINT) AS ord, n AS clause_number, 'Section ' || l_returnflag AS section,
       l_linestatus = 'F' AND l_partkey % 4 = 0 AS table_origin, k, l_suppkey,
       n || '  Supply. The Contractor shall place ' || CAST(CAST(floor(l_quantity) AS INT) AS STRING) || ' mm within ' || CAST(l_linenumber * 15 AS STRING) || ' days'
       || CASE l_returnflag WHEN 'R' THEN ' using reasonable care and due diligence as directed by the Engineer'
                            WHEN 'A' THEN ' as per Clause ' || CAST(l_linenumber AS STRING) || '.1 and Section ' || CAST(k AS STRING)
                            ELSE ' conforming to IS ' || CAST(400 + k AS STRING) || ':' || CAST(2000 + l_suppkey % 20 AS STRING) || ' Section ' || CAST(k % 9 + 1 AS STRING) || '.' || CAST(k % 3 + 1 AS STRING) END
       || CASE l_partkey % 7 WHEN 0 THEN ' for INR ' || CAST(k AS STRING) || ' lakh' WHEN 1 THEN ' at ' || CAST(k AS STRING) || '% or more'
                             WHEN 2 THEN ' in the ratio 1:' || CAST(k + 1 AS STRING) WHEN 3 THEN ' with +/- ' || CAST(k AS STRING) || ' mm'
                             WHEN 4 THEN ' tested ' || CAST(k AS STRING) || ' times per week' WHEN 5 THEN ' for Rs. ' || CAST(k AS STRING) || ',500 and 2 years'
                             ELSE ' under Annexure-B and Schedule ' || CAST(k % 5 AS STRING) END
       || '.' || CASE WHEN l_linenumber = 1 THEN ' The Works ' || chr(CAST(65 + k % 20 AS INT)) || ' means the construction of item ' || CAST(k AS STRING) || ' by the party.' ELSE '' END AS text
FROM ({numbered}) AS numbered
""".replace("{numbered}", NUMBERED)
#: Each clause's reply: a commitment for its quantity, and a second one for every third part.
COMMITTED = """
SELECT clause_id, doc_id, tender_id, page, ord, clause_number, section, table_origin, text, k, l_suppkey,
       CASE k % 4 WHEN 0 THEN 'CANNOT_DETERMINE' WHEN 1 THEN ' 5 mm ' ELSE '365 days' END AS quantity,
       CASE k % 5 WHEN 0 THEN '' ELSE 'test' END AS method, CASE k % 3 WHEN 0 THEN 'CANNOT_DETERMINE' WHEN 1 THEN 'CONTRACT_DEFINED' ELSE 'IS 456' END AS standard,
       CASE WHEN k % 6 = 0 THEN 'How much for item ' || CAST(k AS STRING) || '?' ELSE ' ' END AS question
FROM ({clauses}) AS c
"""
#: Pages of a document: a customer's orders.
PAGES = """
SELECT 'cust_' || CAST(o_custkey AS STRING) AS doc_id, 'T' || CAST(o_custkey % 5 AS STRING) AS tender_id,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS page_number, o_orderstatus = 'P' AS ocr_was_used,
       CASE WHEN o_orderkey % 3 = 0 THEN 'SECTION-' || CAST(o_orderkey % 7 + 1 AS STRING) || ': Scope of work' || chr(10) ELSE '' END
       || CAST(o_orderkey % 9 + 1 AS STRING) || '.' || CAST(o_orderkey % 4 + 1 AS STRING) || ' The party shall deliver order ' || CAST(o_orderkey AS STRING) || ' without delay.' || chr(10)
       || CASE WHEN o_orderkey % 5 = 0 THEN 'Annexure IV' || chr(10) ELSE '' END || '(a) Priority is ' || o_orderpriority || chr(10) || 'Page ' || CAST(o_orderkey % 90 AS STRING) AS text
FROM {orders}
"""


def frame(spark: SparkSession, sql: str, sf_dir: str, often: bool = False) -> DataFrame:
    """A derived input; ``{name}`` in the SQL is a table of the folder. ``often``: it is read several times,
    so the line items are numbered once and the columns that clauses are made of staged; texts are made where they are read."""
    sql = sql.replace("{clauses}", CLAUSES)
    if often:
        numbered = frame(spark, NUMBERED, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "k", "n", "o")
        return spark.sql(sql.replace(f"({NUMBERED})", "{numbered}"), numbered=stage(numbered, "query-numbered"))
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders") if f"{{{t}}}" in sql}
    return spark.sql(sql, **used)


def duck(sql: str) -> str:
    return sql.replace("{clauses}", CLAUSES).replace("{lineitem}", "lineitem").replace("{orders}", "orders")


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, CLAUSES, sf_dir).withColumn("section_path", F.array("section")).withColumn("char_count", F.length("text"))


def committed(spark: SparkSession, sf_dir: str, often: bool = False) -> DataFrame:
    """Clauses with ``commitments``: one of the columns' fields, and for every third part a complete one behind it."""
    first = F.struct(F.concat(F.lit("place item "), F.col("k").cast("string")).alias("obligation"), "quantity", "method", "standard", F.array("question").alias("missing_info"))
    second = F.struct(F.lit("report weekly").alias("obligation"), F.lit("7 days").alias("quantity"), F.lit("form").alias("method"), F.lit("IS 1").alias("standard"), F.array().cast("array<string>").alias("missing_info"))
    both = F.when(F.col("k") % 3 == 0, F.array(first.cast(COMMITMENTS[6:-1]), second.cast(COMMITMENTS[6:-1]))).otherwise(F.array(first.cast(COMMITMENTS[6:-1])))
    return frame(spark, COMMITTED, sf_dir, often).withColumn("section_path", F.array("section")).withColumn("char_count", F.length("text")).withColumn("commitments", both)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, PAGES, sf_dir)
