"""Batch files of an external model: request lines, result lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trimmed
from ..schemas import BODY, RESULT_LINE

ENDPOINT = "/v1/responses"


def request_lines(requests: DataFrame) -> DataFrame:
    """One JSON line (value) for each request; optional fields are left out."""
    body = F.struct(
        F.array(F.struct(F.col("input").alias("content"), F.lit("user").alias("role"))).alias("input"),
        F.col("instructions"),
        F.when(F.col("max_tokens") > 0, F.col("max_tokens")).alias("max_output_tokens"),
        F.col("model"),
        F.struct(F.lit("none").alias("effort")).alias("reasoning"),
        F.when(F.col("json_mode"), F.struct(F.struct(F.lit("json_object").alias("type")).alias("format"))).alias("text"),
    )
    return requests.select(F.to_json(F.struct("custom_id", F.lit("POST").alias("method"), F.lit(ENDPOINT).alias("url"), body.alias("body"))).alias("value"))


def output_text(body: Column) -> Column:
    """All output_text parts of a response body, one after another."""
    parsed = F.from_json(body, BODY)
    parts = F.flatten(F.transform(F.filter(parsed["output"], lambda o: o["type"] == "message"), lambda o: o["content"]))
    return F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "output_text"), lambda p: p["text"]), "")


def parse_results(lines: DataFrame, value: str = "value", strict: bool = True) -> DataFrame:
    """custom_id, content, error of each line that is not blank. An error comes before a missing response, that before a status
    other than 200, that before an unreadable body, and that before an empty text. A line that is not JSON fails the query; with
    ``strict=False`` it becomes an error."""
    line = lines.where(trimmed(F.col(value)) != "").select(trimmed(F.col(value)).alias("v"))
    # The body stays text: it is an object in the line and is read on its own.
    row = F.from_json("v", "custom_id string, error struct<code:string, message:string>, response struct<status_code:int, body:string>, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    line = line.select("v", row.alias("r"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    failed = F.raise_error(F.concat(F.lit("not a result line: "), F.substring("v", 1, 200))).cast("string") if strict else F.lit("not a result line")
    r = F.col("r")
    text = F.coalesce(output_text(r["response"]["body"]), F.lit(""))
    error = (
        F.when(bad, failed)
        .when(r["error"].isNotNull(), F.concat(F.coalesce(r["error"]["code"], F.lit("")), F.lit(": "), F.coalesce(r["error"]["message"], F.lit(""))))
        .when(r["response"].isNull(), "no response in output line")
        .when(r["response"]["status_code"] != 200, F.concat(F.lit("HTTP "), r["response"]["status_code"].cast("string"), F.lit(": "), F.coalesce(r["response"]["body"], F.lit(""))))
        .when(F.from_json(r["response"]["body"], BODY).isNull(), "unreadable response body")
        .when(text == "", "empty output text")
        .otherwise("")
    )
    out = line.select(F.coalesce(r["custom_id"], F.lit("")).alias("custom_id"), text.alias("text"), error.alias("error"))
    return out.select("custom_id", F.when(F.col("error") == "", F.col("text")).otherwise("").alias("content"), "error")


def read_results(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return parse_results(spark.read.text(path), strict=strict)
