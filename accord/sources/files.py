"""Readers and writers of the tabular files that stages exchange. Schemas are given, never inferred."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

URL = r"https?://[^\s<>\"')\]]+"


def exchange_folder(spark: SparkSession) -> str:
    """A new folder in the session's shared folder; without one, in the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")  # both are shared
    return f"{root.rstrip('/')}/exchange-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str) -> str:
    """CSV with a header, or TSV if the path says so; an existing table is replaced. Nulls are written as \\N, so empty texts stay empty."""
    sep = "\t" if path.endswith(".tsv") else ","
    df.write.mode("overwrite").option("header", True).option("sep", sep).option("nullValue", "\\N").csv(path)
    return path


def read_table(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    sep = "\t" if path.endswith(".tsv") else ","
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("nullValue", "\\N").csv(path)


def read_optional(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """An empty table where there is no file."""
    try:
        return read_table(spark, path, schema)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_texts(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".md", ".txt", ".py"), most_bytes: int = 5_000_000) -> DataFrame:
    """path, text of the text files below a folder; larger ones than most_bytes are no notes on datasets and are passed over."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(F.col("length") <= most_bytes)
    wanted = F.lit(False)
    for s in suffixes:
        wanted = wanted | F.col("path").endswith(s)
    return found.filter(wanted).select("path", F.decode("content", "UTF-8").alias("text"))


def first_url(texts: DataFrame, alias: str) -> DataFrame:
    """path, url: the first URL of each text that mentions a name, in any case."""
    hit = texts.filter(F.lower("text").contains(alias.lower()))
    return hit.select("path", F.regexp_extract("text", f"({URL})", 1).alias("url")).filter("url <> ''")


def only_file(spark: SparkSession, root: str, suffix: str) -> str:
    """The one file below a folder with a suffix; none or several are an error."""
    found = [r["path"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root).select("path").limit(2).collect()]
    if len(found) != 1:
        raise FileNotFoundError(f"{len(found)} files like *{suffix} in {root}, where one is needed")
    return found[0]


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"columns that are needed and missing: {missing}")
    return df
