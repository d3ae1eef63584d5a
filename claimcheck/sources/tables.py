"""Readers of tables by file name."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

READERS = ("csv", "json", "parquet")


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, multi_line: bool | None = None, schema: StructType | str | None = None) -> DataFrame:
    """A CSV file with a header; read as UTF-8, or as Latin-1 if it isn't UTF-8.

    Without ``schema`` types are inferred, by a pass of their own. One more pass finds out the encoding, and
    whether a quoted value goes over several lines, unless both are given: only such files (``multi_line``)
    are read whole by one task each, all others are split.
    """
    if encoding is None or multi_line is None:
        line = F.col("value")
        quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
        odd, cut = spark.read.text(path).agg(F.bool_or(~F.is_valid_utf8(line)), F.bool_or(quotes % 2 == 1)).first()
        encoding = encoding or ("ISO-8859-1" if odd else "UTF-8")
        multi_line = bool(cut) if multi_line is None else multi_line
    reader = spark.read.options(header=True, nullValue="", multiLine=multi_line, escape='"', encoding=encoding)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_json(spark: SparkSession, path: str, multi_line: bool | None = None, schema: StructType | str | None = None) -> DataFrame:
    """JSON lines, split like any text; or one array or object a file (``multi_line``), read by one task each.

    Unless it is given, ``multi_line`` follows from the first line with text: a whole object stands on it or not.
    """
    if multi_line is None:
        first = spark.read.text(path).where(F.trim("value") != "").first()
        text = first.value.strip() if first else ""
        multi_line = bool(text) and (text.startswith("[") or not text.endswith("}"))
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=multi_line)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """The table of a ``.csv``, ``.json`` or ``.parquet`` path.

    An unknown kind is a ValueError, a missing path a FileNotFoundError.
    """
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind not in READERS:
        raise ValueError(f"unsupported kind of file: {path}")
    try:
        if kind == "csv":
            return read_csv(spark, path)
        return read_json(spark, path) if kind == "json" else spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from error
        raise


def _names(spark: SparkSession, path: str, suffix: str) -> dict[str, list[str]]:
    """The files of a folder that end in ``suffix``, by kind, from one listing."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found: dict[str, list[str]] = {}
    for status in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder):
        name = status.getPath().getName()
        kind = name.rpartition(".")[2].lower()
        if name.endswith(suffix) and kind in READERS and not name.startswith(("_", ".")):
            found.setdefault(kind, []).append(status.getPath().toString())
    return found


def load_folder(spark: SparkSession, path: str, suffix: str = "") -> dict[str, DataFrame]:
    """Tables of all files of a folder that end in ``suffix``, by name; files that can't be read are left out."""
    found = {}
    for files in _names(spark, path, suffix).values():
        for file in files:
            try:
                found[file.rpartition("/")[2]] = load_table(spark, file)
            except (ValueError, FileNotFoundError, AnalysisException):
                continue
    return found


def load_folder_by_schema(spark: SparkSession, path: str, suffix: str = "") -> list[tuple[list[str], DataFrame]]:
    """(file names, table) for each set of files of one schema, with ``_file``, the name of a row's file.

    For folders of many files, in a number of jobs that follows from the kinds and schemas and not from the
    files: CSV headers and quotes, and the first lines of JSON files, are read in one distributed pass each,
    Parquet schemas from the files' ends; files of like header or form are one table, and types are inferred over the table. Files of one header
    whose types differ share the wider ones. Empty files are left out.
    """
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    tables: list[tuple[list[str], DataFrame]] = []
    by_kind = _names(spark, path, suffix)
    for kind in ("csv", "json"):
        if files := by_kind.get(kind):
            line = F.col("value")
            lines = spark.read.text(files).where(F.trim(line) != "").select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place"), "value")
            quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
            forms = lines.groupBy("file").agg(F.min_by("value", "place").alias("first"), F.bool_or(~F.is_valid_utf8(line)).alias("odd"), F.bool_or(quotes % 2 == 1).alias("cut")).collect()
            groups: dict[tuple, list[str]] = {}
            for form in forms:
                first = form.first.strip()
                key = (first, form.odd, form.cut) if kind == "csv" else (first.startswith("[") or not first.endswith("}"),)
                groups.setdefault(key, []).append(form.file)
            for key, own in sorted(groups.items(), key=lambda g: str(g[0])):
                if kind == "csv":
                    reader = spark.read.options(header=True, nullValue="", multiLine=bool(key[2]), escape='"', encoding="ISO-8859-1" if key[1] else "UTF-8", inferSchema=True)
                    tables.append((own, reader.csv(sorted(own))))
                else:
                    tables.append((own, spark.read.json(sorted(own), multiLine=key[0])))
    if files := by_kind.get("parquet"):
        groups = {}
        conf, reader = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.parquet.hadoop.ParquetFileReader
        for file in files:  # the schema stands at a file's end, and takes no job
            groups.setdefault(reader.readFooter(conf, spark._jvm.org.apache.hadoop.fs.Path(file)).getFileMetaData().getSchema().toString(), []).append(file)
        tables += [(own, spark.read.parquet(*sorted(own))) for own in groups.values()]
    return [(sorted(f.rpartition("/")[2] for f in own), df.withColumn("_file", name)) for own, df in tables]


def is_usable(df: DataFrame) -> bool:
    """Whether the table has a column and a row."""
    return bool(df.columns) and not df.isEmpty()
