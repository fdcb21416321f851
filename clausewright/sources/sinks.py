"""Writers: JSON lines, summaries, trees, graphs, registries, vectors, caches, run logs."""

from __future__ import annotations

import json
import platform
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

import pyspark
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright import schemas
from clausewright.functions.text import content_hash
from clausewright.sources.artefacts import exists

#: Rows of one call of an embedding provider.
EMBED_BATCH = 64


def jsonl(df: DataFrame, path: str) -> None:
    """One record a line; replaces what the stage wrote before."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def parquet(df: DataFrame, path: str, partition_by: str = "tender_id") -> None:
    df.write.mode("overwrite").partitionBy(partition_by).parquet(path)


def summary(row: DataFrame, path: str) -> None:
    """A one-row frame as one JSON object."""
    row.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def manifest(documents: DataFrame, path: str, **fields: str) -> None:
    """A manifest file for each tender of ``documents``: its fields, dates as ISO text, documents by role's
    file name, nulls kept. Missing columns of the schema are null."""
    import re

    spec = schemas.TABLES["manifest"]
    inner = re.search(r"array<struct<(.*)>>", spec)[1]
    names = [f.strip().split(": ") for f in inner.split(", ")]
    doc = F.struct(*[(F.col(n) if n in documents.columns else F.lit(None)).cast(t).alias(n) for n, t in names])
    top = [f.strip().split(" ")[0] for f in spec.split(", documents ")[0].split(",")]
    held = documents.groupBy("tender_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("filename", doc.alias("d")))), lambda x: x["d"]).alias("documents"))
    head = [F.lit(fields.get(n)).cast("string").alias(n) for n in top if n != "tender_id"]
    held.select("tender_id", *head, "documents").coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def upsert_codes(chunks: DataFrame, existing: DataFrame | None, embed: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``(vectors, registry)`` of a code library: vectors of the chunks that are not stored yet, and
    the first chunk of every code and section of all chunks."""
    from clausewright.operators import citations

    fresh = upsert_vectors(chunks.select(F.col("chunk_id").alias("id"), "text", "code_id", "section", "page"), existing, embed)
    ordered = chunks if "ord" in chunks.columns else chunks.withColumn("ord", F.col("chunk_id"))
    return fresh, citations.registry(ordered)


def document_tree(pages: DataFrame) -> DataFrame:
    """One row a document with its pages nested in order, and totals."""
    size = F.length(F.coalesce("text", F.lit("")))
    page = F.struct("page_number", size.alias("char_count"), F.coalesce("ocr_was_used", F.lit(False)).alias("ocr_was_used"))
    return pages.groupBy("tender_id", "doc_id").agg(F.array_sort(F.collect_list(page)).alias("pages"), F.count("*").alias("page_count"), F.sum(size).alias("total_chars"))


def node_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The graph as a table of JSON objects, one a node or link. It is written in
    parts; :func:`node_link_json` joins them for graphs that fit one file."""
    n = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct("*")).alias("json"))
    return n.unionByName(edges.select(F.lit("link").alias("kind"), F.to_json(F.struct("*")).alias("json")))


def node_link_json(nodes: DataFrame, edges: DataFrame) -> str:
    rows = node_link(nodes, edges).orderBy("kind", "json").collect()
    pick = lambda kind: [json.loads(r["json"]) for r in rows if r["kind"] == kind]
    return json.dumps({"directed": True, "multigraph": False, "graph": {}, "nodes": pick("node"), "edges": pick("link")}, ensure_ascii=False)


def registry_json(entries: DataFrame) -> DataFrame:
    """One row: the registry as a JSON map, in order."""
    item = F.struct(F.concat("code_id", F.lit("::"), "section").alias("key"), F.struct("chunk_id").alias("value"))
    return entries.agg(F.to_json(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("ord", item.alias("item")))), lambda x: x["item"]))).alias("value"))


def upsert_vectors(new: DataFrame, existing: DataFrame | None, embed: Callable[[DataFrame], DataFrame], id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Rows to append: ids not stored yet, with vectors and content hashes. A text that changed under its id keeps its old vector."""
    fresh = new if existing is None else new.join(existing.select(id_col), id_col, "left_anti")
    return embed(fresh.withColumn("content_hash", content_hash(F.col(text_col))))


def cache_key(kind: Column, model: Column, prompt: Column, schema: Column, temperature: Column, system: Column, max_tokens: Column) -> Column:
    """SHA-256 of the call's inputs as JSON with sorted keys."""
    fields = F.struct(kind.alias("kind"), max_tokens.cast("int").alias("max_out"), model.alias("model"), prompt.alias("prompt"), schema.alias("schema"), F.coalesce(system, F.lit("")).alias("sys"), temperature.cast("double").alias("temp"))
    return F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256)


def cached(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits with their replies, and the requests to make; both have ``cache_key``."""
    return requests.join(cache.select("cache_key", "reply"), "cache_key"), requests.join(cache.select("cache_key"), "cache_key", "left_anti")


def environment() -> dict[str, str]:
    return {"python": platform.python_version(), "platform": platform.platform(), "pyspark": pyspark.__version__}


def start_run(tender_id: str, stage: str, version: str = "1.0", **parameters: object) -> dict:
    return {"run_id": str(uuid.uuid4()), "tender_id": tender_id, "stage": stage, "stage_version": version, "started_at": datetime.now(UTC).isoformat(timespec="seconds"), "parameters": parameters, "environment": environment(), "inputs": [], "outputs": [], "api_calls": 0, "cache_hits": 0, "cost_usd": 0.0, "cost_inr": 0.0}


#: Bytes up to which a file is hashed whole; a larger one line by line.
HASHED_WHOLE = 1 << 30


def record(spark: SparkSession, run: dict, path: str, end: str = "inputs", figures: dict | None = None) -> None:
    """Size and fingerprint of a file or folder that a run read or wrote, in any number of files.

    ``figures``: what :mod:`observed` counted while it was written; then rows and fingerprint come
    from there and no content is read again. Otherwise the fingerprint is the sum of hashes of the
    files' SHA-256, or, of files over HASHED_WHOLE, of their lines, so it
    does not depend on names, order or partitions; one file up to that size has its SHA-256 as well.
    """
    entry: dict = {"path": path}
    if exists(spark, path):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        entry["files"], entry["size_bytes"] = files.select("length").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        if figures is not None:
            entry |= {"line_count": figures["rows"], "fingerprint": figures["fingerprint"]}
        else:
            whole, total = F.sha2("content", 256), lambda *of: F.sum(F.xxhash64(*of).cast("decimal(20,0)"))
            small = files.filter(F.col("length") <= HASHED_WHOLE).agg(total(whole), F.max(whole)).first()
            large = [r["path"] for r in files.filter(F.col("length") > HASHED_WHOLE).select("path").collect()]
            lines = spark.read.text(large).agg(total("value")).first()[0] if large else 0
            entry["fingerprint"] = f"{(int(small[0] or 0) + int(lines or 0)) % (1 << 64):016x}"
            entry["sha256"] = small[1] if entry["files"] == 1 and not large else None
            if path.endswith(".jsonl"):
                entry["line_count"] = spark.read.text(path).count()
    run[end].append(entry)


def finish_run(spark: SparkSession, run: dict, folder: str, success: bool = True, error: str | None = None) -> dict:
    """Close a run: append its index row and write its own record."""
    run |= {"finished_at": datetime.now(UTC).isoformat(timespec="seconds"), "success": success, "error": error}
    run["seconds_elapsed"] = (datetime.fromisoformat(run["finished_at"]) - datetime.fromisoformat(run["started_at"])).total_seconds()
    name = f"{run['started_at'].replace(':', '-').replace('+00-00', 'Z')}__{run['stage']}__{run['run_id'][:8]}.json"
    index = {k: run[k] for k in ("run_id", "stage", "stage_version", "started_at", "finished_at", "success", "api_calls")}
    index |= {"seconds_elapsed": round(run["seconds_elapsed"], 1), "cost_usd": round(run["cost_usd"], 6), "cost_inr": round(run["cost_inr"], 4), "cache_hit_rate": hit_rate(run["cache_hits"], run["api_calls"]), "manifest_path": f"runs/{name}"}
    for text, mode, at in ((json.dumps(run, default=str), "overwrite", f"{folder}/runs/{name}"), (json.dumps(index), "append", f"{folder}/runs/_index.jsonl")):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).text(at)
    return index


def hit_rate(hits: int, calls: int) -> float:
    return round(hits / max(calls, 1), 3)
