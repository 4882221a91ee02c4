"""Checks of the output table."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from deskloom import fixed
from deskloom.functions import json as j, text as t

FINDING = "row_no bigint, severity string, check string, message string"


def header_findings(df: DataFrame) -> DataFrame:
    """Missing columns as an error, extra ones as a warning."""
    spark = df.sparkSession
    missing = sorted(set(fixed.OUTPUT_COLUMNS) - set(df.columns))
    extra = sorted(set(df.columns) - set(fixed.OUTPUT_COLUMNS))
    rows = []
    if missing:
        rows.append((None, "error", "headers", "the table lacks " + ", ".join(missing)))
    if extra:
        rows.append((None, "warning", "headers", "no one reads " + ", ".join(extra)))
    return spark.createDataFrame(rows, FINDING)


def count_findings(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """An error if the two tables differ in their number of rows."""
    counts = inputs.agg(F.count("*").alias("n_in")).withColumn("n_out", outputs.agg(F.count("*")).scalar())
    return counts.where("n_in != n_out").select(
        F.lit(None).cast("bigint").alias("row_no"),
        F.lit("error").alias("severity"),
        F.lit("row_count").alias("check"),
        F.format_string("%d rows for %d tickets", "n_out", "n_in").alias("message"),
    )


def _finding(severity: str, check: str, fails: Column, message: Column) -> Column:
    return F.when(
        F.coalesce(fails, F.lit(False)),
        F.struct(F.lit(severity).alias("severity"), F.lit(check).alias("check"), message.alias("message")),
    )


def row_findings(df: DataFrame, row_no: str) -> DataFrame:
    """(row_no, severity, check, message): every rule broken by every row.

    Columns the table lacks count as empty.
    """
    def field(name: str) -> Column:
        return t.null_safe(F.col(name).cast("string")) if name in df.columns else F.lit("")

    def message(text: str, *values: Column) -> Column:
        return F.format_string(text, *values) if values else F.lit(text)

    clean = df.select(
        F.col(row_no).cast("bigint").alias("row_no"),
        F.lower(field("status")).alias("status"),
        F.lower(field("request_type")).alias("request_type"),
        (field("response") == "").alias("no_response"),
        field("confidence_score").alias("confidence"),
        F.lower(field("risk_level")).alias("risk"),
        F.lower(field("pii_detected")).alias("pii"),
        F.lower(field("language")).alias("language"),
        field("actions_taken").alias("actions"),
    ).withColumns({"score": F.col("confidence").try_cast("double"), "parsed": j.parse(F.col("actions"))})
    c = F.col
    checks = [
        _finding("error", "status", ~c("status").isin(fixed.STATUSES), message("status is %s, not one of " + "/".join(fixed.STATUSES), c("status"))),
        _finding("error", "request_type", ~c("request_type").isin(fixed.REQUEST_TYPES), message("request_type is %s, not one of " + "/".join(fixed.REQUEST_TYPES), c("request_type"))),
        _finding("warning", "response", c("no_response"), message("nothing is answered")),
        _finding("warning", "confidence_score", c("confidence") == "", message("no confidence is given")),
        _finding("error", "confidence_score", (c("confidence") != "") & c("score").isNull(), message("confidence %s is no number", c("confidence"))),
        _finding("error", "confidence_score", ~c("score").between(0.0, 1.0), message("confidence %s lies outside 0 to 1", c("confidence"))),
        _finding("warning", "risk_level", c("risk") == "", message("no risk is given")),
        _finding("error", "risk_level", (c("risk") != "") & ~c("risk").isin(fixed.RISK_LEVELS), message("risk is %s, not one of " + "/".join(fixed.RISK_LEVELS), c("risk"))),
        _finding("warning", "pii_detected", c("pii") == "", message("personal data: neither yes nor no")),
        _finding("error", "pii_detected", (c("pii") != "") & ~c("pii").isin(fixed.PII_FLAGS), message("personal data is %s, not true or false", c("pii"))),
        _finding("warning", "language", c("language") == "", message("no language is given")),
        _finding("warning", "language", F.char_length("language") > 5, message("%s is too long for a language code", c("language"))),
        _finding("warning", "actions_taken", c("actions") == "", message("no list of actions, not even an empty one")),
        _finding("error", "actions_taken", (c("actions") != "") & c("parsed").isNull(), message("the actions cannot be parsed")),
        _finding("error", "actions_taken", c("parsed").isNotNull() & ~j.is_array(c("parsed")), message("the actions are no list")),
    ]
    broken = clean.select("row_no", F.explode(F.array_compact(F.array(*checks))).alias("f"))
    return broken.select("row_no", "f.severity", "f.check", "f.message")


def validate(inputs: DataFrame, outputs: DataFrame, row_no: str = "ticket_id") -> DataFrame:
    """All findings on an output table, as rows."""
    body = outputs.select([c for c in outputs.columns if c != row_no])
    return (
        header_findings(body)
        .unionByName(count_findings(inputs, outputs))
        .unionByName(row_findings(outputs, row_no))
    )


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity", "check").agg(F.count("*").alias("n"))


def passes(findings: DataFrame) -> bool:
    return findings.where("severity = 'error'").isEmpty()


def report(findings: DataFrame) -> DataFrame:
    """The first findings of each severity, as many as a report shows: one pass,
    cut on the map side."""
    order = Window.partitionBy("severity").orderBy(F.asc_nulls_first("row_no"), "check")
    most = max(fixed.REPORT_ERRORS, fixed.REPORT_WARNINGS)
    placed = findings.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= most)
    shown = F.when(F.col("severity") == "error", fixed.REPORT_ERRORS).otherwise(fixed.REPORT_WARNINGS)
    return placed.where(F.col("_place") <= shown).drop("_place")
