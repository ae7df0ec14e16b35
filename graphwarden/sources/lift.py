"""Relational rows as triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwarden.functions.terms import BNODE, IRI, LITERAL, XSD, literal_nt

EX = "urn:t:"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def iri(kind: str, key: Column | str) -> Column:
    """urn:t:<kind>/<key>"""
    return F.concat(F.lit(f"{EX}{kind}/"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def iri_of(kind: Column, key: Column) -> Column:
    """iri() of a kind that rows tell."""
    return F.concat(F.lit(EX), kind, F.lit("/"), key.cast("string"))


def triples(df: DataFrame, s: Column, p: Column | str, o: Column, *, literal: bool = False, datatype: Column | str = XSD + "string", lang: Column | str = "", scope: Column | str = "m") -> DataFrame:
    """One statement for each row of df, in the form that rules take (column scope). Rows whose subject or object is null have none."""

    def column(x):
        return F.lit(x) if isinstance(x, str) else x

    dt = column(datatype) if literal else F.lit("")
    lg = column(lang) if literal else F.lit("")
    out = df.select(column(scope).alias("scope"), s.alias("s"), F.lit(IRI).alias("s_kind"), column(p).alias("p"), o.cast("string").alias("o"), F.lit(LITERAL if literal else IRI).alias("o_kind"), dt.alias("o_dt"), lg.alias("o_lang"))
    spelled = literal_nt(F.col("o"), F.col("o_dt"), F.col("o_lang")) if literal else F.concat(F.lit("<"), F.col("o"), F.lit(">"))
    return out.where("s IS NOT NULL AND o IS NOT NULL").withColumn("s_nt", F.concat(F.lit("<"), F.col("s"), F.lit(">"))).withColumn("o_nt", spelled)


def blank(df: DataFrame) -> DataFrame:
    """The same statements with blank nodes as objects."""
    return df.withColumn("o_kind", F.lit(BNODE)).withColumn("o_nt", F.concat(F.lit("_:"), F.col("o")))
