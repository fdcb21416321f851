"""Readers: JSON lines, manifests, registries, vocabularies, binaries, web pages, runs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright import schemas
from clausewright.functions import naming
from clausewright.operators.quantities import REFERENTS


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def jsonl(spark: SparkSession, path: str, table: str, missing_ok: bool = False) -> DataFrame:
    """A table of JSON lines by its declared schema. A broken line fails; a
    missing file fails too, unless it may be missing and then is empty."""
    schema = schemas.TABLES[table]
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a document of a manifest (or of many)."""
    rows = spark.read.schema(schemas.TABLES["manifest"]).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if rows.filter("tender_id is null").head(1):
        raise ValueError(f"not a manifest: {path}")
    return rows.select("tender_id", F.explode("documents").alias("d")).select("tender_id", "d.*")


def registry(spark: SparkSession, path: str) -> DataFrame:
    """``(code_id, section, chunk_id, ord)`` of a JSON map keyed ``code::section``; empty if missing."""
    if not exists(spark, path):
        return spark.createDataFrame([], "code_id string, section string, chunk_id string, ord int")
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.map_entries(F.from_json("value", "map<string, struct<chunk_id: string>>"))).alias("ord", "e"))
    return rows.select(F.substring_index("e.key", "::", 1).alias("code_id"), F.regexp_replace("e.key", "^.*?::", "").alias("section"), F.col("e.value.chunk_id").alias("chunk_id"), "ord")


def ids(spark: SparkSession, path: str, predicate: str | None = None, key: str = "clause_id") -> DataFrame:
    """Distinct ids of the rows that meet a predicate, such as ``coalesce(flagged, false)``; empty if missing."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"{key} string")
    rows = spark.read.schema(f"{key} string, flagged boolean, verdict string, critique_verdict string, error string").json(path)
    return (rows.filter(predicate) if predicate else rows).select(key).distinct()


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a JSON list or of lines of text."""
    whole = spark.read.text(path, wholetext=True)
    listed = whole.select(F.when(F.btrim("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.split("value", "\n")).alias("v"))
    return listed.select(F.explode(F.transform("v", lambda v: F.btrim(v))).alias("clause_id")).filter("clause_id <> ''").distinct()


def vocabulary(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Referent labels, one a line; blank lines and comments are skipped."""
    if path is None or not exists(spark, path):
        return spark.createDataFrame([(r,) for r in REFERENTS], "label string")
    return spark.read.text(path).filter("not startswith(value, '#')").select(F.btrim("value").alias("label")).filter("label <> ''")


def files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """Manifest rows of the files of a folder: role, sequence, size, hash, and whether they look like PDF."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select(name.alias("filename"), naming.role(name).alias("role"), naming.sequence(name).alias("sequence"), F.col("length").alias("file_size_bytes"), F.sha2("content", 256).alias("sha256"), is_pdf(F.col("content")).alias("is_pdf"))


def is_pdf(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 4)) == "25504446"


def sampled_text_layer(pages: DataFrame, first: int = 3) -> DataFrame:
    """Whether any of a document's first pages has text."""
    return pages.filter(F.col("page_number") <= first).groupBy("doc_id").agg(F.bool_or(F.btrim(F.coalesce("text", F.lit(""))) != "").alias("has_text_layer"))


def links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Distinct documents that web pages link to: hrefs that end in .pdf or download servlets."""
    href = F.explode(F.array_distinct(F.regexp_extract_all(F.col(html_col), F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))))
    rows = pages.select(id_col, href.alias("href")).filter("href <> ''")
    return rows.filter(F.lower("href").endswith(".pdf") | F.col("href").contains("DownloadDocument"))


def page_title(html: Column) -> Column:
    return _first_of(html, [r"(?i)Tender\s*Title[:\s]*<[^>]*>([^<]+)<", r"(?i)<title[^>]*>([^<]+)</title>"], "")


def issuing_authority(html: Column) -> Column:
    return _first_of(html, [r"(?i)Organisation\s*Chain[:\s]*<[^>]*>([^<]+)<", r"(?i)Issuing\s*Authority[:\s]*<[^>]*>([^<]+)<"], "UNKNOWN")


def _first_of(html: Column, patterns: list[str], default: str) -> Column:
    out = F.lit(default)
    for p in reversed(patterns):
        found = F.regexp_extract(html, p, 1)
        out = F.when(found != "", F.substring(F.btrim(found), 1, 200)).otherwise(out)
    return F.coalesce(out, F.lit(default))


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The run index in file order; broken lines are skipped, a missing file is empty."""
    try:
        return spark.read.schema(schemas.TABLES["runs"]).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schemas.TABLES["runs"])


def status(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Presence, size and lines of artefacts."""
    rows = []
    for label, path in paths.items():
        if not exists(spark, path):
            rows.append((label, False, None, None))
            continue
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        size = where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
        rows.append((label, True, size, spark.read.text(path).count() if path.endswith(".jsonl") else None))
    return spark.createDataFrame(rows, "artefact string, present boolean, size_bytes bigint, lines bigint")
