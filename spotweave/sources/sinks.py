"""Sinks and file checks."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from spotweave.functions.checks import in_range, one_of


def write_filtered(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """S12."""
    one_of("fmt", fmt, ("parquet", "csv"))
    writer = df.write.mode(mode)
    writer.parquet(path) if fmt == "parquet" else writer.csv(path, header=True)


def write_by_region(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """S13. One folder per region in a single pass and without a shuffle, so a huge region stays spread over
    tasks; rows without a region go to the default partition."""
    one_of("fmt", fmt, ("parquet", "csv"))
    writer = df.write.mode(mode).partitionBy("region")
    writer.parquet(path) if fmt == "parquet" else writer.csv(path, header=True)


def write_report(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """S16. Summary rows as JSON lines."""
    df.write.mode(mode).json(path)


def _files(spark: SparkSession, folder: str, pattern: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    # content is not selected, so no file is loaded
    return reader.load(folder).select("path", "length")


@F.pandas_udf(StringType())
def stream_md5(paths: pd.Series) -> pd.Series:
    """MD5 of whole files read in 4 MiB pieces; a file of any size needs one piece of memory."""
    from pyarrow import fs as pafs

    def digest(path: str) -> str:
        local = path.startswith(("file:", "/"))
        fs, inner = (pafs.LocalFileSystem(), path.removeprefix("file:")) if local else pafs.FileSystem.from_uri(path)
        md5 = hashlib.md5()
        with fs.open_input_stream(inner, compression=None) as handle:
            while piece := handle.read(4 << 20):
                md5.update(piece)
        return md5.hexdigest()

    return paths.map(digest)


def file_manifest(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """S15. MD5 and size of every file."""
    return _files(spark, folder, pattern).select("path", F.col("length").alias("size_bytes"), stream_md5("path").alias("md5"))


def check_files(
    spark: SparkSession, folder: str, extensions: list[str] | None = None, max_size: int | None = None, pattern: str | None = None
) -> DataFrame:
    """V3. Problem per file: extension not allowed (any case) or too large; NULL for a good file. A folder
    name with ``..`` is refused outright."""
    if ".." in folder:
        raise ValueError("paths with '..' are not allowed")
    if max_size is not None:
        in_range("max_size", max_size, 0)
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    problem = F.lit(None).cast("string")
    if max_size is not None:
        problem = F.when(F.col("length") > max_size, "too_large").otherwise(problem)
    if extensions:
        problem = F.when(~extension.isin([e.lower() for e in extensions]), "bad_extension").otherwise(problem)
    return _files(spark, folder, pattern).select("path", "length", problem.alias("problem"))
