"""Running metrics of a stream of texts, against tables that are replaced while it runs.

``run_verdicts`` judges each batch by the newest version of the truth and writes it under the batch's number,
so that a batch that is repeated after a failure replaces itself. ``running_metrics`` reads such verdicts as a
stream and keeps, for each source, its counts and the claims of late: a claim that comes again before the
watermark has passed its time and the delay counts as repeated only.

A source may bring a third of all claims: its claims are dealt into shards by their text, each with a state
of its own, and ``total_metrics`` adds the shards up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from claimcheck.streaming.verdicts import stream_verdicts

COUNTS = ("total_claims", "valid_claims", "hallucinations", "unverified", "repeated")


def save_version(truth: DataFrame, profile: DataFrame, folder: str, version: str) -> None:
    """Write a version of the tables; it is in force once both are written. Versions are ordered by name."""
    truth.write.parquet(f"{folder}/{version}/truth")
    profile.write.parquet(f"{folder}/{version}/profile")


def newest_version(spark: SparkSession, folder: str) -> tuple[str, DataFrame, DataFrame]:
    """(version, truth, profile) of the last whole version in the folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in sorted((s.getPath().getName() for s in store.listStatus(path(folder))), reverse=True):
        if all(store.exists(path(f"{folder}/{name}/{table}/_SUCCESS")) for table in ("truth", "profile")):
            return name, spark.read.parquet(f"{folder}/{name}/truth"), spark.read.parquet(f"{folder}/{name}/profile")
    raise FileNotFoundError(f"no version of the truth in {folder}")


def run_verdicts(texts: DataFrame, versions: str, columns: list[str], first_column: str | None, out: str, checkpoint: str, time: str = "time", fuzzy: str | None = None, once: bool = False) -> StreamingQuery:
    """Start judging a stream (source_id, text, ``time``); verdicts go to ``out`` with their time and ``truth_version``.

    With ``once`` the query ends when it has read what is there.
    """

    def judge(batch: DataFrame, number: int) -> None:
        version, truth, profile = newest_version(batch.sparkSession, versions)
        # A claim keeps its source's id as it is, so the time goes with it.
        dated = batch.withColumn("source_id", F.struct(F.col("source_id").alias("id"), F.col(time).alias("at")))
        found = stream_verdicts(dated, truth, profile, columns, first_column, fuzzy)
        kept = ("ordinal", "original_text", "direction", "strength", "status", "reason")
        found.select(F.col("source_id.id").alias("source_id"), F.col("source_id.at").alias(time), *kept, F.lit(version).alias("truth_version")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = texts.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def running_metrics(found: DataFrame, time: str = "time", delay: str = "10 minutes", shards: int = 8) -> DataFrame:
    """(source_id, shard, total_claims, ..., repeated) of a stream of verdicts: a row whenever a shard's counts change (update mode).

    Claims are the same if their texts are, but for case. Rows later than ``delay`` are left out. A null
    source is a source like others; a claim without text is never repeated.
    """
    lag = pd.Timedelta(delay).value // 1_000_000

    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        *counts, seen, until = state.get if state.exists else (*[0] * len(COUNTS), b"", b"")
        recent = dict(zip(np.frombuffer(seen, "<i8").tolist(), np.frombuffer(until, "<i8").tolist()))
        recent = {claim: end for claim, end in recent.items() if end > now}
        changed = False
        for frame in () if state.hasTimedOut else frames:
            for claim, at, status in frame.sort_values("at", kind="stable")[["claim", "at", "status"]].itertuples(index=False):
                if at < now:
                    continue
                changed, again = True, not pd.isna(claim) and recent.get(int(claim), -1) >= at
                if again:
                    counts[4] += 1
                else:
                    for i, met in enumerate((True, status == "VALID", "HALLUCINATION" in status, status == "UNVERIFIED")):
                        counts[i] += met
                    if not pd.isna(claim):
                        recent[int(claim)] = int(at) + lag
        state.update((*counts, np.array(list(recent), "<i8").tobytes(), np.array(list(recent.values()), "<i8").tobytes()))
        if recent:
            state.setTimeoutTimestamp(max(min(recent.values()), now + 1))
        if changed:
            yield pd.DataFrame([(None if pd.isna(key[0]) else key[0], key[1], *counts)], columns=["source_id", "shard", *COUNTS])

    claim = F.when(F.col("original_text") != "", F.xxhash64(F.lower("original_text")))
    shard = F.pmod(F.coalesce(claim, F.xxhash64("ordinal")), F.lit(shards)).cast("int")
    rows = found.withWatermark(time, delay).select("source_id", time, shard.alias("shard"), claim.alias("claim"), F.unix_millis(time).alias("at"), "status")
    kinds = dict(found.dtypes)
    out = f"source_id {kinds['source_id']}, shard int, " + ", ".join(f"{c} long" for c in COUNTS)
    kept = ", ".join(f"{c} long" for c in COUNTS) + ", seen binary, until binary"
    return rows.groupBy("source_id", "shard").applyInPandasWithState(count, out, kept, "update", GroupStateTimeout.EventTimeTimeout)


def total_metrics(rows: DataFrame) -> DataFrame:
    """(source_id, total_claims, ..., repeated) from all rows that ``running_metrics`` has given: the last of each shard, added up."""
    seen = F.col("total_claims") + F.col("repeated")  # only grows
    last = rows.groupBy("source_id", "shard").agg(F.max_by(F.struct(*COUNTS), seen).alias("last"))
    return last.groupBy("source_id").agg(*[F.sum(f"last.{c}").alias(c) for c in COUNTS])
