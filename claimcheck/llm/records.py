"""Token ids in length-delimited binary files, with an offset index.

A record is ``length (8 bytes) | masked CRC of the length (4) | payload | masked CRC of the payload (4)``,
all little-endian. The payload is the document's id (8 bytes, signed) and its token ids, two bytes each
where the vocabulary allows it and four otherwise. The mask rotates the CRC by 15 bits and adds a constant,
so that a checksum of bytes that hold checksums stays sound; the CRC is CRC-32.

Every shard is one file, written by one task under a name of its own attempt. The index, a Parquet table
that Spark commits, names the files of the attempts that succeeded, so that a lost executor leaves a
stray file at worst. With the index, records can be read in any order without a scan.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from claimcheck.llm.shared import new_path, saved, texts_of
from claimcheck.llm.tokens import encoded, vocabulary_size

#: Fixed value: the constant of the checksum mask.
MASK = 0xA282EAD8
#: Bytes of text that a file holds on average, at most.
FILE_BYTES = 256 << 20
INDEX = "shard int, file string, ordinal long, doc_id long, offset long, length long, n_tokens long, width int"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def read_frame(stream) -> bytes | None:
    """The next payload of a file, None at its end; a wrong checksum or a cut file is an error."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12:
        raise ValueError("a record is cut short")
    size, check = struct.unpack("<QI", head)
    if masked(head[:8]) != check:
        raise ValueError("the checksum of a record's length is wrong")
    body = stream.read(size + 4)
    if len(body) < size + 4:
        raise ValueError("a record is cut short")
    if masked(body[:size]) != struct.unpack("<I", body[size:])[0]:
        raise ValueError("the checksum of a record is wrong")
    return body[:size]


def payload_of(doc_id: int, ids: np.ndarray, width: int) -> bytes:
    if len(ids) and int(ids.max()) >> 8 * width:
        raise ValueError(f"id {int(ids.max())} doesn't fit into {width} bytes")
    return struct.pack("<q", doc_id) + ids.astype(f"<u{width}").tobytes()


def from_payload(payload: bytes, width: int) -> tuple[int, bytes]:
    """A payload's document id, and its ids as little-endian unsigned 32-bit integers."""
    return struct.unpack_from("<q", payload)[0], np.frombuffer(payload, dtype=f"<u{width}", offset=8).astype("<u4").tobytes()


def write_records(docs: DataFrame, folder: str, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text", vocabulary: int | None = None) -> DataFrame:
    """Write the documents' ids in ascending order of ``doc_id`` and return the index, one row a record.

    Null texts are empty and hold ``end_id`` alone; rows with equal ids follow each other by text, repeated
    rows are records of their own; rows whose ``doc_id`` is null come first and are stored as the smallest
    long. Other columns don't matter. An empty table gives an empty index and no file.

    Ids take two bytes if ``vocabulary`` (by default the vocabulary's size) and ``end_id`` allow it, else
    four; an id that doesn't fit is an error, never cut.

    Shards are ranges of ``doc_id``, as many as there are shuffle partitions or more, so that a file holds
    ``FILE_BYTES`` of text on average at most. Each task writes one file in one pass and holds about 1 MB of
    texts. Rows of one ``doc_id`` are dealt by their text and place in the input, so that they may fill many shards.
    """
    spark = docs.sparkSession
    width = 2 if max(vocabulary or vocabulary_size(path), end_id + 1) <= 1 << 16 else 4

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        file = f"records-{shard:06d}-{uuid.uuid4().hex}.bin"
        out, at, ordinal = None, 0, 0
        for batch in batches:
            rows = []
            for key, ids in zip(batch.column(0).to_pylist(), (x for run in texts_of(batch.column(1)) for x in encoded(run, path))):
                out = out or store.open_output_stream(f"{base}/{file}")
                tokens = np.append(np.frombuffer(ids, dtype="<u4"), np.uint32(end_id))
                record = frame(payload_of(key, tokens, width))
                out.write(record)
                rows.append((shard, file, ordinal, key, at, len(record), len(tokens), width))
                at += len(record)
                ordinal += 1
            if rows:
                types = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[c.split()[0] for c in INDEX.split(", ")])
        if out:
            out.close()

    least = F.lit(-(1 << 63)).cast("long")
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), least).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    order = ("doc_id", "dealt", "text", "place")
    rows = rows.withColumns({"dealt": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    index = rows.repartitionByRange(shards, "doc_id", "dealt", "place").sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(write, INDEX)
    return saved(index, "record-index")


def shards_of(index: DataFrame) -> DataFrame:
    """One row a file: shard, file, width, n_records, n_tokens and start, the tokens in all files before."""
    sums = index.groupBy("shard", "file", "width").agg(F.count("*").alias("n_records"), F.sum("n_tokens").alias("n_tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as files
    return sums.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


def read_shards(index: DataFrame, folder: str) -> DataFrame:
    """All records in file order: doc_id, start (tokens of all records before), n_tokens, ids (binary, 32-bit).

    Each task streams whole files; checksums are verified.
    """
    spark = index.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                start, rows, size = row["start"], [], 0
                with store.open_input_stream(f"{base}/{row['file']}") as stream:
                    while (payload := read_frame(stream)) is not None:
                        key, ids = from_payload(payload, row["width"])
                        rows.append((key, start, len(ids) // 4, ids))
                        start += len(ids) // 4
                        size += len(ids)
                        if size > 1 << 20:
                            yield _batch(rows)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows)

    files = shards_of(index)
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.select("file", "start", "width").repartition(shards, "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "start", "n_tokens", "ids"])


def read_at(index: DataFrame, folder: str) -> DataFrame:
    """``index`` rows, in any selection and order, with the ids of their records read by offset."""
    schema = index.schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            rows = batch.select(["file", "offset", "width"]).to_pylist()
            found: list[bytes] = [b""] * len(rows)
            by_file: dict[str, list[int]] = {}
            for i, row in enumerate(rows):
                by_file.setdefault(row["file"], []).append(i)
            for name, places in by_file.items():
                with store.open_input_file(f"{base}/{name}") as file:
                    for i in sorted(places, key=lambda i: rows[i]["offset"]):
                        file.seek(rows[i]["offset"])
                        found[i] = from_payload(read_frame(file), rows[i]["width"])[1]
            yield batch.append_column("ids", pa.array(found, pa.binary()))

    return index.mapInArrow(read, StructType([*schema.fields, StructField("ids", BinaryType())]))


def records_folder(spark: SparkSession) -> str:
    """A new folder as a full URI: executors must not take a path without a scheme for their own disk's."""
    path = spark._jvm.org.apache.hadoop.fs.Path(new_path(spark, "records"))
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full
