"""Findings: stable identity, occurrence numbers, baselines, union comparison, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphwarden.functions.terms import SH, sha256
from graphwarden.operators.closure import checkpointed

FIELDS = ("signature", "severity", "rule", "constraint_component", "focus", "path", "value", "source_module", "message")
VIOLATION, WARNING, INFO = f"<{SH}Violation>", f"<{SH}Warning>", f"<{SH}Info>"


def bag(rule_rows: DataFrame, rule: str, severity: str, component: str, message: str) -> DataFrame:
    """Rows of a rule as findings without signature; the rule's own message stands where a row has none."""
    return rule_rows.select(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), F.lit(component).alias("constraint_component"), "focus", "path", "value", F.col("scope").alias("source_module"), F.coalesce("message", F.lit(message)).alias("message"))


def semantic_key(df: DataFrame):
    """What makes two findings the same whatever their module."""
    return F.concat_ws("\x1f", *[F.coalesce(df[c], F.lit("")) for c in ("severity", "rule", "constraint_component", "focus", "path", "value", "message")])


def signed(findings: DataFrame) -> DataFrame:
    """Findings with their signatures: the hash of what they are about, then of that and a number among equals of a module.

    Severity and message are no part of the hash; they only order equals.
    """
    first = findings.withColumn("sig", sha256(*[F.col(c) for c in ("rule", "constraint_component", "focus", "path", "value", "source_module")])).withColumn("key", semantic_key(findings))
    nth = F.row_number().over(Window.partitionBy("source_module", "sig").orderBy("key"))
    return first.withColumn("signature", sha256(F.col("sig"), nth.cast("string"))).select(*FIELDS)


def new_in_union(local: DataFrame, union: DataFrame) -> DataFrame:
    """Union findings that no module has; every one that matches goes."""
    seen = local.select(semantic_key(local).alias("key")).distinct()
    return union.withColumn("key", semantic_key(union)).join(seen, "key", "left_anti").select(*union.columns)


def regressions(findings: DataFrame, accepted: DataFrame) -> DataFrame:
    """Violations whose signature is not accepted (column signature)."""
    return findings.where(F.col("severity") == VIOLATION).join(accepted.select("signature").distinct(), "signature", "left_anti").select(*findings.columns)


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count_if(F.col("severity") == VIOLATION).alias("violations"), F.count_if(F.col("severity") == WARNING).alias("warnings"), F.count_if(~F.col("severity").isin(VIOLATION, WARNING)).alias("infos"))


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("signature", "source_module", "message")


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """rows with rank, their number in the order given: a sort by ranges, whose tasks' rows are numbered behind those of the tasks before."""
    numbered = checkpointed(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    task = F.shiftright("__at", 33)
    sizes = numbered.groupBy(task.alias("__task")).agg(F.count("*").alias("n"))
    before = sizes.withColumn("__before", F.sum("n").over(Window.orderBy("__task")) - F.col("n")).drop("n")  # a row for each task
    return numbered.withColumn("__task", task).join(F.broadcast(before), "__task").withColumn("rank", F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).select("rank", *rows.columns)
