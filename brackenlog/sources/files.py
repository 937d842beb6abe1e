"""Log files in and out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

import pandas as pd
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from brackenlog.functions.text import trim_line_end
from brackenlog.session import shuffle_width

HEAD_BYTES = 8192  # a NUL among them marks a binary file
SAMPLE_LINES = 200  # what schema detection looks at


class HiddenFileError(ValueError):
    """Spark skips files whose names begin with ``_`` or ``.``, even when asked for."""


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Physical lines ``source, split, pos, value`` of log files.

    A split is one file range read by one task, so however large a file is, no split holds
    more than ``spark.sql.files.maxPartitionBytes``.
    """
    paths = [paths] if isinstance(paths, str) else list(dict.fromkeys(paths))
    hidden = [p for p in paths if _is_hidden(p)]
    if hidden:
        raise HiddenFileError(f"rename these files to read them: {', '.join(hidden)}")
    # Only a line feed ends a line; the default would also split at a lone carriage return.
    return (
        spark.read.option("lineSep", "\n")
        .text(paths)
        .select(
            F.col("_metadata.file_path").alias("source"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("pos"),
            trim_line_end(F.col("value")).alias("value"),
        )
    )


def list_files(spark: SparkSession, folder: str) -> list[str]:
    """Files directly in a folder, by name."""
    context = spark.sparkContext
    root = context._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(context._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in fs.listStatus(root) if s.isFile())


def read_heads(spark: SparkSession, paths: Sequence[str] | DataFrame, limit: int = SAMPLE_LINES) -> DataFrame:
    """First lines of many files, ``source, line_no, value``; ``paths`` may be a column ``source``.

    A Spark scan would read the files to their ends; here each task opens its share of the
    paths and stops early. Bytes that are not UTF-8 are replaced: a guess at the schema
    should not fail on one of them. An empty file has no rows.
    """
    return _opened(spark, paths).mapInPandas(partial(_heads, limit=limit), "source string, line_no long, value string")


def _opened(spark: SparkSession, paths: Sequence[str] | DataFrame) -> DataFrame:
    if not isinstance(paths, DataFrame):
        paths = spark.createDataFrame([(p,) for p in paths], "source string")
    return paths.repartition(shuffle_width(spark), "source")


def _heads(frames, limit: int):
    for frame in frames:
        for path in frame["source"]:
            data, feeds = [], 0
            for chunk in _chunks(path, 1 << 16):
                data.append(chunk)
                feeds += chunk.count(b"\n")
                if feeds >= limit:
                    break
            lines = b"".join(data).split(b"\n")
            if lines[-1] == b"":
                lines.pop()
            lines = [line.decode("utf-8", "replace").rstrip("\r") for line in lines[:limit]]
            if lines:  # an empty list is a column of floats to pandas, which the worker cannot send as text
                yield pd.DataFrame({"source": path, "line_no": range(1, len(lines) + 1), "value": lines})


def _binary(frames):
    for frame in frames:
        marked = [b"\0" in next(_chunks(path, HEAD_BYTES), b"") for path in frame["source"]]
        yield pd.DataFrame({"source": frame["source"], "is_binary": marked})


def _chunks(path: str, size: int):
    system, inner = _open_system(path)
    with system.open_input_stream(inner) as stream:
        while chunk := stream.read(size):
            yield chunk


def _open_system(path: str):
    scheme, _, rest = path.partition(":")
    if "/" in scheme or scheme == "file":
        return pa_fs.LocalFileSystem(), "/" + (rest or path).lstrip("/")
    return pa_fs.FileSystem.from_uri(("s3" if scheme == "s3a" else scheme) + ":" + rest)


def text_files(spark: SparkSession, folder: str, skip_hidden: bool = False) -> list[str]:
    """Text files directly in a folder, by name. A NUL near the start means binary."""
    found = list_files(spark, folder)
    heads = _opened(spark, found).mapInPandas(_binary, "source string, is_binary boolean")
    binary = {r.source for r in heads.filter("is_binary").select("source").collect()}
    kept = [p for p in found if p not in binary]
    hidden = [p for p in kept if _is_hidden(p)]
    if hidden and not skip_hidden:
        raise HiddenFileError(f"rename these files to read them: {', '.join(hidden)}")
    return [p for p in kept if not _is_hidden(p)]


def _is_hidden(path: str) -> bool:
    return path.rstrip("/").rsplit("/", 1)[-1][:1] in ("_", ".")


def head_sample(lines: DataFrame, limit: int = SAMPLE_LINES) -> DataFrame:
    """The first lines of every source, numbered from 1."""
    if "line_no" in lines.columns:
        return lines.filter(F.col("line_no") <= limit)
    # Spark keeps only the first rows of each source on the map side of this window.
    first = Window.partitionBy("source").orderBy("split", "pos")
    return (
        lines.withColumn("line_no", F.row_number().over(first))
        .filter(F.col("line_no") <= limit)
        .withColumn("line_no", F.col("line_no").cast("long"))
    )


def invalid_utf8(lines: DataFrame) -> DataFrame:
    """Sources holding bytes that are not UTF-8, with the number of such lines."""
    return (
        lines.filter(~F.is_valid_utf8("value")).groupBy("source").agg(F.count(F.lit(1)).alias("bad_lines"))
    )


def strict_utf8(lines: DataFrame) -> DataFrame:
    """Lines of the sources that are valid UTF-8 throughout."""
    return lines.join(invalid_utf8(lines).select("source"), "source", "left_anti")


def write_parsed(df: DataFrame, path: str, level: str = "level", mode: str = "error") -> None:
    """Parsed entries as Parquet below ``date=/level=``, for pruning by day and severity.

    The rebalance keeps files large without sending one busy day to a single task.
    """
    dated = df.withColumn("date", F.to_date("ts"))
    dated.hint("rebalance", "date", level).write.partitionBy("date", level).mode(mode).parquet(path)


def write_raw(df: DataFrame, path: str, mode: str = "error") -> None:
    """Raw text of the chosen entries."""
    df.select("raw").write.option("lineSep", "\n").mode(mode).text(path)
