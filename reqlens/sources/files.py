"""File scans: JSON lines, corpora in CSV, Parquet datasets. Bad rows are kept apart, never lost silently."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reqlens import schemas
from reqlens.functions import curate
from reqlens.session import where_once

BAD = "_bad"
LABELLED = ["request_id", "method", "uri", "headers", "body", "label", "attack_family"]


def read_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed lines with the file they came from)."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    event = F.from_json("value", f"{schema}, {BAD} string", {"columnNameOfCorruptRecord": BAD})
    parsed = lines.where(F.trim("value") != "").withColumn("e", event)
    good = where_once(parsed, F.col(f"e.{BAD}").isNull()).select("e.*").drop(BAD)
    bad = where_once(parsed, F.col(f"e.{BAD}").isNotNull()).select("file", "value")
    return good, bad


def file_encodings(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Files under a path by encoding: UTF-8 when every line of the file is valid, else UTF-16 when a line starts with
    its mark, else Latin-1. Every file is judged by itself, in one pass over all; a row for each file comes back."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    mark = F.hex(F.substring(F.col("value").cast("binary"), 1, 2)).isin("FFFE", "FEFF")
    judged = lines.groupBy("file").agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_or(mark).alias("utf16"))
    out: dict[str, list[str]] = {}
    for row in judged.orderBy("file").collect():
        encoding = "UTF-8" if row.utf8 else "UTF-16" if row.utf16 else "ISO-8859-1"
        out.setdefault(encoding, []).append(unquote(row.file))
    return out


def csv_parts(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, skipped) of CSV files with a header, as text columns; short rows are padded.

    A row with more fields than its file's header is skipped and comes back with its first fields, its ``file`` and a
    ``skip_reason``. Files of different encodings and columns may lie side by side; a column that a file lacks is null.
    ``multi_line`` allows quoted line breaks and makes a file one split; switch it off for very large files
    without them.
    """
    found = file_encodings(spark, path)
    rows = None
    for encoding, files in found.items():
        options = {"header": True, "encoding": encoding, "escape": '"', "multiLine": multi_line or encoding == "UTF-16"}
        headers: dict[tuple[str, ...], list[str]] = {}
        for file in files if encoding == "UTF-16" or len(found) > 1 else [path]:
            headers.setdefault(tuple(spark.read.options(**options).csv(file).columns), []).append(file)
        for names, same in headers.items():
            fields = ", ".join(f"`{n}` string" for n in [*names, "_extra"])
            part = spark.read.options(**options).schema(fields).csv(same).withColumn("file", F.col("_metadata.file_path"))
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    if rows is None:
        rows = spark.read.options(header=True).csv(path)
        rows = rows.withColumns({"_extra": F.lit(None).cast("string"), "file": F.lit(None).cast("string")}).limit(0)
    good = rows.where(F.col("_extra").isNull()).drop("_extra", "file")
    return good, rows.where(F.col("_extra").isNotNull()).drop("_extra").withColumn("skip_reason", F.lit("too many fields"))


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """The rows of ``csv_parts``; use that where the skipped ones are counted."""
    return csv_parts(spark, path, multi_line)[0]


def _split_skipped(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    marked = rows.withColumn("skip_reason", reason)
    return marked.where(F.col("skip_reason").isNull()).drop("skip_reason"), marked.where(F.col("skip_reason").isNotNull())


def _labelled(rows: DataFrame, request: Column, attack: Column, family: Column, request_id: Column | None) -> DataFrame:
    rid = request_id if request_id is not None else F.uuid()
    return rows.withColumn("_q", request).select(
        rid.alias("request_id"), "_q.method", "_q.uri", "_q.headers", "_q.body",
        F.when(attack, "attack").otherwise("benign").alias("label"),
        F.when(attack, family).otherwise("benign").alias("attack_family"),
    )


def sentence_requests(
    rows: DataFrame, family: str, request_id: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Requests and skipped rows of a ``Sentence, Label`` table."""
    for name in ("Sentence", "Label"):
        if name not in rows.columns:
            return _labelled(rows.limit(0).withColumn("Sentence", F.lit("")), curate.wrap_payload(F.col("Sentence")),
                             F.lit(False), F.lit(family), F.lit("")), rows.withColumn(
                                 "skip_reason", F.lit(f"missing '{name}' column"))
    good, skipped = _split_skipped(rows, curate.sentence_skip_reason(F.col("Sentence"), F.col("Label")))
    attack = curate.sentence_label(F.col("Label")) == 1
    request = curate.wrap_payload(F.trim("Sentence"), request_id)
    return _labelled(good, request, attack, F.lit(family), request_id), skipped


def full_requests(rows: DataFrame, request_id: Column | None = None) -> tuple[DataFrame, DataFrame] | None:
    """Requests and skipped rows of a ``Method, URL, classification`` table; None when a column is absent."""
    if not {"Method", "URL", "classification"} <= set(rows.columns):
        return None
    value = {n: curate.present(F.col(f"`{n}`")) for n in rows.columns}
    reason = (
        F.when(value["Method"].isNull(), "missing Method")
        .when(value["URL"].isNull(), "missing URL")
        .when(value["classification"].isNull(), "missing classification")
    )
    good, skipped = _split_skipped(rows, reason)
    body = F.coalesce(value["content"], F.lit("")) if "content" in rows.columns else F.lit("")
    request = F.struct(
        value["Method"].alias("method"),
        curate.full_request_uri(F.col("URL")).alias("uri"),
        curate.full_request_headers({n: F.col(f"`{n}`") for n in rows.columns}).alias("headers"),
        body.alias("body"),
    )
    attack = F.lower(value["classification"]) != "normal"
    return _labelled(good, request, attack, F.lit("unknown_attack"), request_id), skipped


def flow_requests(rows: DataFrame, request_id: Column | None = None) -> tuple[DataFrame, DataFrame] | None:
    """Requests and skipped rows of a network-flow table; header names may carry blanks."""
    stripped = rows.toDF(*[c.strip() for c in rows.columns])
    if "Label" not in stripped.columns:
        return None
    label = curate.present(F.col("Label"))
    good, skipped = _split_skipped(stripped, F.when(label.isNull(), "missing Label"))

    def number(name: str) -> Column:
        return F.col(f"`{name}`").try_cast("double") if name in stripped.columns else F.lit(None).cast("double")

    rid = request_id if request_id is not None else F.uuid()
    keyed = good.withColumns({"_rid": rid, "_f": curate.flow_family(F.col("Label"))})
    request = curate.flow_request(
        F.col("_f.template"), F.col("_rid"), number("Destination Port"), number("Max Packet Length")
    )
    attack = F.col("_f.family") != "benign"
    return _labelled(keyed, request, attack, F.col("_f.family"), F.col("_rid")), skipped


def union_sources(parts: list[DataFrame]) -> DataFrame:
    out = parts[0].select(*LABELLED)
    for part in parts[1:]:
        out = out.unionByName(part.select(*LABELLED))
    return out


def write_labelled(df: DataFrame, path: str) -> None:
    """JSON lines, one folder per label."""
    df.write.partitionBy("label").json(path)


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LABELLED_REQUEST).json(path)


def write_splits(df: DataFrame, path: str) -> None:
    """Parquet dataset, one folder per split, so a training job reads only its own."""
    df.write.partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == split)


def write_report_csv(df: DataFrame, path: str) -> None:
    """All fields quoted, with a header."""
    df.write.option("quoteAll", True).option("header", True).option("escape", '"').csv(path)


def write_lines(df: DataFrame, path: str) -> None:
    df.write.text(path)


def write_manifest(df: DataFrame, path: str) -> None:
    df.write.json(path)
