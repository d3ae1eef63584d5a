"""Quality rules, near-duplicates, secrets and packing, one stage after the other, on the documents.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; the stages before the last return the
columns of documents. ``run`` writes each stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimcheck.llm import packing, quality, secrets, simhash
from claimcheck.llm.shared import free_name, saved

#: Texts are near-duplicates if their sets of shingles of five words have a Jaccard similarity of 0.8 or more.
WORDS, SIMILARITY = 5, 0.8


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and aren't unlike the trusted ones."""
    ratios = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.assess(docs, ratios).where("kept").select(*docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id (and row hash).

    Rows are told apart by doc_id and a hash of all columns; of rows equal in all columns one stays. A null
    doc_id is larger than all others.
    """
    row, mark = free_name(docs, "_row"), free_name(docs, "_mark")
    marked = docs.withColumn(mark, F.xxhash64(*docs.columns))
    found = simhash.similar(marked.select(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.col(mark).alias("mark")).alias("row"), "text"), "row", words=WORDS, least=SIMILARITY)
    chosen = found.where("row = component_id").select(F.coalesce("row.doc_id", F.lit(0)).alias("doc_id_"), F.col("row.mark").alias("mark_")).distinct()
    chosen = saved(chosen, "chosen")
    kept = marked.join(chosen, (F.coalesce(marked["doc_id"], F.lit(0)) == chosen["doc_id_"]) & (marked[mark] == chosen["mark_"]), "left_semi")
    first = F.row_number().over(Window.partitionBy(F.coalesce("doc_id", F.lit(0)), mark).orderBy(F.lit(0)))
    return kept.withColumn(row, first).where(F.col(row) == 1).select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts replaced by a mark, and n_chars to match."""
    base, linked = free_name(docs, "_base"), free_name(docs, "_linked")
    found = secrets.scan(docs, names=(base, linked))
    spans = F.array_sort(F.concat(base, linked))
    texts = found.withColumn("text", F.when(F.size(spans) > 0, secrets.redact(F.col("text"), spans)).otherwise(F.col("text")))
    return texts.withColumn("n_chars", F.when(F.size(spans) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = packing.cut(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicates_stage),
    ("secret scans", secrets_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can't express the hashed likelihood ratio, SimHash or tokens; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
