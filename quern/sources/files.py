"""Documents from text files and results from JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """file_name, content_hash, text of the .txt and .md files under path, trimmed; blank files drop out."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.{txt,md}", recursiveFileLookup=True)
    text = F.regexp_replace("value", r"^\s+|\s+$", "")
    rows = files.select(F.regexp_extract("_metadata.file_path", r"[^/]+$", 0).alias("file_name"), text.alias("text"))
    return rows.where("text <> ''").select("file_name", F.sha2("text", 256).alias("content_hash"), "text")


def load_binary(spark: SparkSession, path: str, extract, glob: str = "*.{pdf,docx}") -> DataFrame:
    """file_name, text of binary files, given a column function that extracts text from `content`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", r"[^/]+$", 0).alias("file_name"), extract(F.col("content")).alias("text"))


def parse_batch_results(lines: DataFrame) -> DataFrame:
    """custom_id, outcome, body of a provider's JSON lines (value). Blank and unreadable lines and those without an id
    drop out; a response of status 200 to 299 without an error succeeded, others errored."""
    kind = "custom_id string, response struct<status_code:int,body:string>, error string"
    rows = lines.where(F.trim("value") != "").select(F.from_json("value", kind).alias("r"), "value")
    good = F.col("r.error").isNull() & F.col("r.response.status_code").between(200, 299)
    rows = rows.where("r.custom_id is not null")
    return rows.select("r.custom_id", F.when(good, "succeeded").otherwise("errored").alias("outcome"), "r.response.body")


def vector_from_text(column: str):
    """A vector literal such as [0.1,2] as an array of doubles; null where it cannot be read."""
    return F.from_json(column, "array<double>")


def vector_to_text(column: str):
    return F.to_json(column)
