"""A small made-up tender for trying things out: pages and a manifest, from plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.sources import sinks
from clausewright.sources.artefacts import exists

WIDTH = 88
#: Documents of the example: file, role, sequence and text.
DOCUMENTS = [
    ("01_notice.pdf", "nit", 0, "1.1 Bids are invited for the lining of a canal.\n1.2 The Bidder shall submit the bid within 21 days with a deposit of Rs. 2 lakh."),
    ("02_conditions.pdf", "gcc", 0, "2.1 The Contractor means the party whose bid has been accepted.\n2.2 The Contractor shall keep the site reasonably clean to the satisfaction of the Engineer.\n2.3 Payment shall follow Clause 2.2 within a suitable time."),
    ("03_special.pdf", "scc", 0, "3.1 The defects period is 12 months as per Clause 2.2.\n3.2 The Contractor shall use best efforts to finish early."),
    ("04_specification.pdf", "specs", 0, "4.1 Concrete shall be tested as per IS 456:2000 Section 16.1 and cured adequately.\n4.2 The lining shall be 75 mm thick with a tolerance of +/- 5 mm."),
    ("05_quantities.pdf", "boq", 0, "5.1 Lining of 1200 m at the rates of Schedule 2."),
    ("06_corrigendum_1.pdf", "corrigendum", 1, "6.1 In Clause 1.2 read 28 days in place of 21 days."),
    ("07_corrigendum_2.pdf", "corrigendum", 2, "7.1 The tolerance of Clause 4.2 is +/- 3 mm."),
]


def soft_wrap(line: Column, width: int = WIDTH) -> Column:
    """Lines of at most ``width`` characters, broken at the last space that fits; longer words are cut."""
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("rest"))
    # a word that fits no line is cut into pieces first
    words = F.flatten(F.transform(F.split(line, " "), lambda w: F.when(F.length(w) <= width, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.length(w), F.lit(width)), lambda k: F.substring(w, k, F.lit(width))))))

    def add(acc: Column, word: Column) -> Column:
        joined = F.when(acc["rest"] == "", word).otherwise(F.concat(acc["rest"], F.lit(" "), word))
        fits = F.length(joined) <= width
        return F.struct(F.when(fits, acc["lines"]).otherwise(F.concat(acc["lines"], F.array(acc["rest"]))).alias("lines"), F.when(fits, joined).otherwise(word).alias("rest"))

    return F.aggregate(words, start, add, lambda acc: F.concat(acc["lines"], F.array(acc["rest"])))


def pages(spark: SparkSession, tender_id: str = "EXAMPLE", width: int = WIDTH) -> DataFrame:
    """One page a document, its lines wrapped."""
    rows = spark.createDataFrame([(name, tender_id, text) for name, _, _, text in DOCUMENTS], "doc_id string, tender_id string, raw string")
    wrapped = F.array_join(F.flatten(F.transform(F.split("raw", "\n"), lambda line: soft_wrap(line, width))), "\n")
    return rows.select("doc_id", "tender_id", F.lit(1).alias("page_number"), wrapped.alias("text"), F.lit(False).alias("ocr_was_used"))


def manifest(spark: SparkSession, tender_id: str = "EXAMPLE") -> DataFrame:
    rows = [(tender_id, name, role, seq) for name, role, seq, _ in DOCUMENTS]
    return spark.createDataFrame(rows, "tender_id string, filename string, role string, sequence int")


def write(spark: SparkSession, folder: str, tender_id: str = "EXAMPLE", overwrite: bool = False) -> None:
    """``pages.parquet`` and ``manifest.json`` of the example; an existing folder is refused unless it may be overwritten."""
    if exists(spark, f"{folder}/pages.parquet") and not overwrite:
        raise FileExistsError(folder)
    pages(spark, tender_id).write.mode("overwrite").parquet(f"{folder}/pages.parquet")
    sinks.manifest(manifest(spark, tender_id), f"{folder}/manifest.json", project_title="Canal lining (example)", issuing_authority="Example authority")
