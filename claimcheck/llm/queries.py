"""The operators applied to the given tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimcheck.llm import ann, bpe, html, lexical, online, oracle, packing, quality, records, runs, secrets, sharding, simhash, tokens


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.col("fingerprint")[0]), 16, "0")).alias("fingerprint"), "component_id")


def op2_ann(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(table(spark, folder, "embeddings"))


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text")


def op4_html(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return html.extract(pages, html.fit(pages)).drop("html")


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    pieces = packing.cut(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(pieces)


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.assign(table(spark, folder, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_records(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    files = records.records_folder(spark)
    index = records.write_records(docs, files, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return records.read_shards(index, files).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(table(spark, folder, "documents").select("doc_id", "text")).drop("text")

    def count(kind: int):
        return F.size(F.filter("base", lambda x: x.kind == kind)).cast("long").alias(f"n_{secrets.KINDS[kind]}")

    counts = [count(kind) for kind in range(3)]
    every = F.array_sort(F.concat("base", "linked"))
    return found.select("doc_id", *counts, F.sha2(secrets.as_text(F.col("base")), 256).alias("base_sha256"), secrets.as_text(every).alias("spans"))


def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = bpe.encode_documents(table(spark, folder, "documents").select("doc_id", "text"), path)
    docs = bpe.decode_documents(docs.drop("text"), path)
    return docs.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    ratios = quality.fit(docs, table(spark, folder, "labels"))
    return quality.assess(docs, ratios).drop("text")


def op11_lexical(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_online_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return online.pack_online(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text); in those whose doc_id has a crc32 h with h % 10 = 0, words from one on repeat a stretch of the text."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words, g = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)), F.floor(h / 10)
    docs = docs.withColumn("words", F.when(h % 10 == 0, words)).withColumn("n", F.size("words"))
    docs = docs.withColumn("a", g % F.col("n")).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    planted = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("words", place(i).cast("int"))), " ")
    return docs.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op13_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = runs.find_runs(with_planted_runs(table(spark, folder, "documents").select("doc_id", "text")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("less"), r.start.alias("start"), r.period.alias("period"))))
    found = found.withColumn("longest", longest)
    length, period = -F.col("longest.less"), F.col("longest.period")
    line = lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("longest.start").alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def secrets_base(spark: SparkSession, folder: str) -> DataFrame:
    """What SQL can check of op8's result."""
    return op8_secrets(spark, folder).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def quality_base(spark: SparkSession, folder: str) -> DataFrame:
    """What SQL can check of op10's result."""
    return op10_quality(spark, folder).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_ann": op2_ann,
    "op3_token_counts": op3_token_counts,
    "op4_html": op4_html,
    "op5_packing": op5_packing,
    "op6_sharding": op6_sharding,
    "op7_records": op7_records,
    "op8_secrets": op8_secrets,
    "op9_bpe": op9_bpe,
    "op10_quality": op10_quality,
    "op11_lexical": op11_lexical,
    "op12_online_packing": op12_online_packing,
    "op13_runs": op13_runs,
    "secrets_base": secrets_base,
    "quality_base": quality_base,
}

#: DuckDB SQL of the operators that SQL can express.
ORACLE_SQL: dict[str, str] = {"op6_sharding": oracle.sharding(24), "op11_lexical": oracle.LEXICAL, "secrets_base": oracle.SECRETS_BASE, "quality_base": oracle.QUALITY_BASE}
