"""A triple store of Parquet tables: triples in buckets of their subject, and a dictionary of the terms that are no subjects.

A term's id is 64 bits of its spelling, the same wherever it stands, so statements get their ids where they stand and
are never joined with a dictionary. That no two terms of a scope share an id is looked for in every store that is written;
where two do, it is written again with another seed. The triple table has subjects' ids beside the texts and is bucketed by scope and
subject id and sorted by subject, so that a subject's text and id are kept once for its statements; rules join and group
on longs, and meet statements of one subject without a shuffle. Spellings and objects' ids follow from
the texts, kinds, datatypes and languages, so they are neither shuffled with the triples nor kept. The dictionary is
bucketed as the triples are; findings, which are few beside the data, get their spellings from both at the end.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwarden.functions.terms import spelling
from graphwarden.operators.findings import ranked
from graphwarden.operators.rules import MARK

#: Triples of one bucket that a task sorts in memory, some 500 bytes each.
BUCKET_ROWS = 1_000_000


def term_id(nt: Column, seed: int = 0) -> Column:
    return F.xxhash64(F.lit(seed), nt)


def buckets_for(spark: SparkSession, triples: int) -> int:
    """As many buckets as shuffles have partitions, or as keep each in memory."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-triples // BUCKET_ROWS))


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    tables: tuple[str, str]
    seed: int = 0

    @property
    def triples(self) -> DataFrame:
        """The triples with spellings and ids."""
        spelled = self.spark.table(self.tables[0]).withColumns({"s_nt": spelling("s"), "o_nt": spelling("o")})
        return spelled.withColumn("o_id", term_id(F.col("o_nt"), self.seed))

    @property
    def plain(self) -> DataFrame:
        """The triples with spellings for keys."""
        return self.triples.drop("s_id", "o_id")

    @property
    def keyed(self) -> DataFrame:
        """The triples with ids in place of spellings: s_nt and o_nt are longs."""
        return self.spark.table(self.tables[0]).withColumn("o_nt", term_id(spelling("o"), self.seed)).withColumnRenamed("s_id", "s_nt")

    @property
    def others(self) -> DataFrame:
        """(scope, id, nt) of the terms that are no subjects."""
        return self.spark.table(self.tables[1]).drop("clash")

    @property
    def subjects(self) -> DataFrame:
        """(scope, id, nt) of the subjects, from their statements."""
        return self.spark.table(self.tables[0]).select("scope", F.col("s_id").alias("id"), spelling("s").alias("nt")).distinct()

    def numbered(self) -> DataFrame:
        """The triples with their terms' numbers for ids: the places of the spellings in one sort over all scopes."""
        t = self.triples
        nodes = t.select(F.explode(F.array("s_nt", "o_nt")).alias("nt")).distinct()
        numbers = ranked(nodes, "nt")
        for side in ("s", "o"):
            t = t.drop(f"{side}_id").join(numbers.select(F.col("rank").alias(f"{side}_id"), F.col("nt").alias(f"{side}_nt")), f"{side}_nt")
        return t

    def spelled(self, found: DataFrame, subjects: bool = True) -> DataFrame:
        """Findings of keyed triples with spellings for the ids in focus and value; without subjects where none of these is one, and then it is an error if one is."""
        out = found
        known = (self.others, self.subjects) if subjects else (self.others,)
        scope = "scope" if "scope" in found.columns else "source_module"
        for column in ("focus", "value"):
            marked = F.col(column).startswith(MARK)
            out = out.withColumn("__id", F.when(marked, F.substr(column, F.lit(len(MARK) + 1)).cast("bigint")))
            for n, terms in enumerate(known):
                out = out.join(terms.select(F.col("scope").alias(scope), F.col("id").alias("__id"), F.col("nt").alias(f"__nt{n}")), ["__id", scope], "left")
            spelled = [f"__nt{n}" for n in range(len(known))]
            out = out.withColumn(column, F.coalesce(*spelled, F.when(marked, F.raise_error(F.lit("an id without a spelling"))).otherwise(F.col(column)))).drop("__id", *spelled)
        return out.select(*found.columns)

    def clash(self) -> bool:
        """Whether two terms of a scope share an id: those that were met when the dictionary was written, and those of the dictionary."""
        said = self.spark.table(self.tables[1])
        return not said.where("clash").isEmpty() or not said.groupBy("id", "scope").count().where("count > 1").isEmpty()

    def drop(self) -> None:
        """Forget the tables; their files stay."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def write(t: DataFrame, folder: str, buckets: int | None = None, dealt=None, objects: DataFrame | None = None) -> Store:
    """Triples (scope) as a store in a folder that has none; of equal ones one is kept.

    What is equal meets where the table is dealt by its subjects, so nothing is shuffled for being distinct before.
    dealt: a function of the buckets and the subjects' id (of a spelling) that gives the same triples, distinct, with
    s_id and already dealt by s_id and scope; so what triples are lifted from can be shuffled in their place. objects: statements (scope, o_nt)
    with all objects that are no subjects of their scope, if those are fewer than the triples.
    """
    spark = t.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = [c for c in t.columns if c not in ("s_nt", "o_nt")]
    nodes = (t if objects is None else objects).select("scope", F.col("o_nt").alias("nt")).distinct()
    for seed in count():
        at = folder if seed == 0 else f"{folder}/{seed}"
        name = f"graphwarden_{uuid.uuid4().hex}"
        store = Store(spark, (f"{name}_triples", f"{name}_terms"), seed)
        if dealt is None:
            own = _known(t.select(*columns, term_id(F.col("s_nt"), seed).alias("s_id"))).repartition(buckets, "s_id", "scope").distinct()
        else:
            own = dealt(buckets, lambda nt, seed=seed: term_id(nt, seed)).select(*columns, "s_id")
        _table(own, at + "/triples", store.tables[0], buckets, ["s_id", "scope"], ["s_id"])
        others = _known(nodes.select("scope", "nt", term_id(F.col("nt"), seed).alias("id"))).repartition(buckets, "id", "scope").withColumn("h", _second(F.col("nt")))
        told = spark.table(store.tables[0]).select("scope", F.col("s_id").alias("id"), _second(spelling("s")).alias("h"))
        subjects = told.groupBy("id", "scope").agg(F.min("h").alias("a"), F.max("h").alias("b"))
        met = subjects.join(others.hint("shuffle_hash"), ["id", "scope"], "full").where("a <> b OR (nt IS NOT NULL AND (a IS NULL OR a <> h))")
        _table(met.select("scope", "id", "nt", F.col("a").isNotNull().alias("clash")), at + "/terms", store.tables[1], buckets, ["id", "scope"], ["id"])
        if not store.clash():
            return store
        store.drop()


def _second(nt: Column) -> Column:
    """Another 64 bits of a spelling, which tell apart terms that share an id."""
    return F.xxhash64(F.lit("second"), nt)


def _known(df: DataFrame) -> DataFrame:
    """df with columns that are no constants to the planner, which deals anew what is dealt by a constant scope."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def _table(df: DataFrame, folder: str, name: str, buckets: int, by: list[str], order: list[str]) -> None:
    written = df.write.bucketBy(buckets, *by).sortBy(*order).option("path", folder).option("compression", "zstd")
    for column in ("s", "s_id", "id", "nt"):  # of many values, which no page's dictionary holds
        written = written.option(f"parquet.enable.dictionary#{column}", "false")
    written.saveAsTable(name)
