"""Manifests and baselines as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwarden.functions.terms import IRI, OWL, RDF, RDFS, TYPE, iri_nt, tsv
from graphwarden.operators.findings import FIELDS, INFO, VIOLATION, WARNING

#: Both lines of a baseline's header: its version, and the names of its columns.
HEADER = ("# baseline v2", "# " + "\t".join(FIELDS))
#: Predicates that state a term's roles in a manifest file.
IS_CLASS, IS_PREDICATE = "urn:graphwarden:isClass", "urn:graphwarden:isPredicate"


def manifest(vocabularies: DataFrame, namespaces: list[str]) -> DataFrame:
    """(term, is_class, is_predicate) of the terms that vocabularies (triples) declare in the namespaces; terms with neither role are left out."""
    typed = vocabularies.where((F.col("p") == TYPE) & (F.col("s_kind") == IRI) & (F.col("o_kind") == IRI))
    inside = F.lit(False)
    for n in namespaces:
        inside = inside | (F.col("s").startswith(n) & (F.length("s") > len(n)))
    roles = typed.where(inside).groupBy(F.col("s").alias("term")).agg(F.bool_or(F.col("o").isin(RDFS + "Class", OWL + "Class")).alias("is_class"), F.bool_or((F.col("o") == RDF + "Property") | F.col("o").endswith("Property")).alias("is_predicate"))
    return roles.where("is_class OR is_predicate")


def manifest_from_support(triples: DataFrame, class_term: str = IS_CLASS, predicate_term: str = IS_PREDICATE) -> DataFrame:
    """The same table from triples that state the roles as true."""
    stated = triples.where(F.col("p").isin(class_term, predicate_term) & (F.col("o") == "true"))
    return stated.groupBy(F.col("s").alias("term")).agg(F.bool_or(F.col("p") == class_term).alias("is_class"), F.bool_or(F.col("p") == predicate_term).alias("is_predicate"))


def manifest_lines(terms: DataFrame) -> DataFrame:
    """(value): a manifest as N-Triples lines in order, which manifest_from_support() reads."""
    roles = F.filter(F.array(F.when(F.col("is_class"), F.lit(IS_CLASS)), F.when(F.col("is_predicate"), F.lit(IS_PREDICATE))), lambda x: x.isNotNull())
    return terms.select("term", F.explode(roles).alias("role")).select(F.concat(iri_nt(F.col("term")), F.lit(" "), iri_nt(F.col("role")), F.lit(' "true" .')).alias("value")).distinct().orderBy("value")


def read_baseline(spark: SparkSession, path: str | None) -> DataFrame:
    """(signature) of the accepted violations; a line with fewer than two fields or an unknown severity is an error."""
    if path is None:
        return spark.createDataFrame([], "signature string")
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    fields = lines.select(F.split("value", "\t", -1).alias("f"), "value")
    short = F.when(F.size("f") < 2, F.raise_error(F.concat(F.lit("baseline line without severity: "), F.col("value"))))
    unknown = F.when(~F.get("f", F.lit(1)).isin(VIOLATION, WARNING, INFO), F.raise_error(F.concat(F.lit("unknown severity in baseline: "), F.col("value"))))
    checked = fields.withColumn("fault", F.coalesce(short.cast("string"), unknown.cast("string")))
    return checked.where(F.col("fault").isNull() & (F.get("f", F.lit(1)) == VIOLATION)).select(F.get("f", F.lit(0)).alias("signature")).distinct()


def baseline_lines(findings: DataFrame) -> DataFrame:
    """(value): the lines of a baseline of these findings' violations, in order, without the header."""
    own = findings.where(F.col("severity") == VIOLATION).orderBy("signature", "source_module", "message")
    return own.select(F.concat_ws("\t", *[tsv(F.col(c)) for c in FIELDS]).alias("value"))
