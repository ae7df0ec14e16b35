"""Guarded repairs: exact substitutions of one IRI by another, in predicates and in types."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphwarden.functions.terms import DCT, IRI, OWL, RDF, RDFS, SKOS, TRIPLE_FIELDS, TYPE, iri_nt
from graphwarden.operators.findings import regressions
from graphwarden.plans.algebra import updated
from graphwarden.plans.sparql import Operation, SparqlError, read_update


class RepairRejected(ValueError):
    """A guard found that a repair would do something else than it says."""


@dataclass(frozen=True)
class Repair:
    id: str
    rule: str
    bad: str
    replacement: str
    profile: str = "core"
    safety: str = "Automatic"
    #: The update that a definition gives; without, the substitution itself.
    text: str = ""

    def __post_init__(self):
        if self.bad == self.replacement:
            raise ValueError(f"{self.id}: the replacement is the bad IRI")
        if self.safety != "Automatic":
            raise ValueError(f"{self.id}: only automatic repairs can be run")
        self.operations()

    def update(self) -> str:
        """The repair as a SPARQL update."""
        if self.text:
            return self.text
        b, r = f"<{self.bad}>", f"<{self.replacement}>"
        return f"DELETE {{ ?s {b} ?o }} INSERT {{ ?s {r} ?o }} WHERE {{ ?s {b} ?o }} ;\nDELETE {{ ?s a {b} }} INSERT {{ ?s a {r} }} WHERE {{ ?s a {b} }}"


    def operations(self) -> tuple[Operation, ...]:
        try:
            return read_update(self.update())
        except SparqlError as e:
            raise ValueError(f"{self.id}: {e}") from e


def standard_catalog(rule: str) -> list[Repair]:
    """Misspelt standard terms and what they stand for."""
    pairs = (
        ("bibliographic-citation", DCT + "bibliographiccitation", DCT + "bibliographicCitation", "core"),
        ("owl-same", OWL + "same", OWL + "sameAs", "core"),
        ("rdfs-property", RDFS + "Property", RDF + "Property", "core"),
        ("rdfs-sub-class-of", RDFS + "subClassof", RDFS + "subClassOf", "core"),
        ("skos-pref-label", SKOS + "preflabel", SKOS + "prefLabel", "skos"),
    )
    return [Repair(f"urn:graphwarden:repair:{i}", rule, b, r, p) for i, b, r, p in pairs]


#: Names of a repair's definition in triples.
REPAIR, RULE, BAD, REPLACEMENT, PROFILE, SAFETY, UPDATE = (f"urn:graphwarden:{n}" for n in ("Repair", "rule", "bad", "replacement", "profile", "safety", "update"))


def read_catalog(triples: DataFrame) -> list[Repair]:
    """The repairs that triples define: resources of type Repair with a rule, the bad IRI and its replacement, each once and an IRI, and a profile, a safety and an update at most once (a literal).

    The update is SPARQL (plans/sparql.py) and is read here, so that a definition with another is an error
    before anything is run; what it does is held against the substitution when it is applied.
    A catalog is a handful of definitions; they are read by the driver.
    """
    typed = triples.where((F.col("p") == TYPE) & (F.col("o") == REPAIR)).select("s").distinct()
    rows = triples.join(typed, "s", "left_semi").where(F.col("p").isin(RULE, BAD, REPLACEMENT, PROFILE, SAFETY, UPDATE)).select("s", "p", "o", "o_kind").distinct().collect()
    named: dict[str, dict[str, str]] = {r.s: {} for r in typed.collect()}
    for r in sorted(rows):
        what = r.p.rsplit(":", 1)[-1]
        if what in named[r.s]:
            raise ValueError(f"{r.s}: more than one {what}")
        if (r.o_kind == IRI) != (r.p in (RULE, BAD, REPLACEMENT)):
            raise ValueError(f"{r.s}: {what} is of the wrong kind")
        named[r.s][what] = r.o
    for i, given in named.items():
        if missing := {"rule", "bad", "replacement"} - set(given):
            raise ValueError(f"{i}: without {', '.join(sorted(missing))}")
    return [Repair(i, f"<{g['rule']}>", g["bad"], g["replacement"], g.get("profile", "core"), g.get("safety", "Automatic"), g.get("update", "")) for i, g in sorted(named.items())]


def selected(catalog: list[Repair], ids: list[str] | None) -> list[Repair]:
    """The repairs with these ids (or local ids), all without; sorted by id."""
    known = {r.id: r for r in catalog}
    if len(known) != len(catalog):
        raise ValueError("two repairs have one id")
    if ids is None:
        return [known[i] for i in sorted(known)]
    out = {}
    for i in ids:
        match = [r for r in catalog if r.id == i or r.id.rsplit(":", 1)[-1] == i]
        if not match:
            raise ValueError(f"unknown repair: {i}")
        out[match[0].id] = match[0]
    return [out[i] for i in sorted(out)]


def matches(t: DataFrame, bad: str) -> DataFrame:
    return t.where((F.col("p") == bad) | ((F.col("p") == TYPE) & (F.col("o_kind") == IRI) & (F.col("o") == bad)))


def replaced(found: DataFrame, repair: Repair) -> DataFrame:
    """Matched triples with the bad IRI replaced wherever it stands as predicate or type; the old term columns are kept as *_before."""
    b, r = repair.bad, repair.replacement
    out = found.select(*TRIPLE_FIELDS, F.col("p").alias("p_before"), F.col("o").alias("o_before"), F.col("o_nt").alias("o_nt_before"))
    swap = (F.col("o_kind") == IRI) & (F.col("o") == b)
    return out.withColumn("o_nt", F.when(swap, iri_nt(F.lit(r))).otherwise(F.col("o_nt"))).withColumn("o", F.when(swap, F.lit(r)).otherwise(F.col("o"))).withColumn("p", F.when(F.col("p") == b, F.lit(r)).otherwise(F.col("p")))


def rewritten(t: DataFrame, repair: Repair) -> DataFrame:
    """The graph after the repair's update, whatever it does."""
    scoped = t.select(*TRIPLE_FIELDS).withColumnRenamed("module", "scope")
    return updated(scoped, repair.operations()).withColumnRenamed("scope", "module").select(*TRIPLE_FIELDS).distinct()


KEY = ["module", "s_nt", "p", "o_nt"]


def delta(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(deleted, added) statements."""
    return before.select(*KEY).subtract(after.select(*KEY)), after.select(*KEY).subtract(before.select(*KEY))


def same_set(a: DataFrame, b: DataFrame) -> bool:
    return a.subtract(b).isEmpty() and b.subtract(a).isEmpty()


def uncorresponding(found: DataFrame, findings: DataFrame, repair: Repair) -> DataFrame:
    """(module): modules with a match, but without a finding of the repair's rule about the bad IRI."""
    named = findings.where((F.col("rule") == repair.rule) & (F.col("path") == f"<{repair.bad}>")).select(F.col("source_module").alias("module")).distinct()
    return found.select("module").distinct().join(named, "module", "left_anti")


def merging(new: DataFrame) -> DataFrame:
    """Replacements that two matches would share."""
    return new.groupBy(*KEY).count().where("count > 1").select(*KEY)


def expected(t: DataFrame, found: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(deleted, added) statements that the matches and their replacements call for; what is there already is not added."""
    return found.select(*KEY), new.select(*KEY).subtract(t.select(*KEY))


def unmet(after: DataFrame, new: DataFrame, repair: Repair) -> DataFrame:
    """Statements that still have the bad IRI, and replacements that are missing."""
    return matches(after, repair.bad).select(*KEY).unionByName(new.select(*KEY).join(after.select(*KEY), KEY, "left_anti"))


CHANGE_FIELDS = ("source_module", "repair_id", "rule_id", "s", "p_before", "o_before", "p_after", "o_after", "replacement_added")


def records(t: DataFrame, new: DataFrame, repair: Repair) -> DataFrame:
    """CHANGE_FIELDS of each replaced statement."""
    had = t.select(*KEY).distinct().withColumn("had", F.lit(True))
    return new.join(had, KEY, "left").select(F.col("module").alias("source_module"), F.lit(repair.id).alias("repair_id"), F.lit(repair.rule).alias("rule_id"), F.col("s_nt").alias("s"), iri_nt(F.col("p_before")).alias("p_before"), F.col("o_nt_before").alias("o_before"), iri_nt(F.col("p")).alias("p_after"), F.col("o_nt").alias("o_after"), F.col("had").isNull().alias("replacement_added"))


@dataclass
class RepairResult:
    triples: DataFrame
    changes: DataFrame
    applied: list[Repair]


def apply(t: DataFrame, repairs: list[Repair], validate: Callable[[DataFrame], DataFrame], cut: Callable[[DataFrame], DataFrame], guard: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> RepairResult:
    """Apply the repairs one after another with all guards; RepairRejected if any fails, and then nothing holds.

    validate gives signed findings of triples; cut materialises a frame. Corresponding findings are
    those before the first repair. guard gives the new violations of the triples after from those before; without one, all
    is validated again.
    """
    start = cut(t.select(*TRIPLE_FIELDS).distinct())
    before = cut(validate(start))
    now, changes, applied = start, None, []
    for repair in repairs:
        found = cut(matches(now, repair.bad))
        if found.isEmpty():
            continue
        if not uncorresponding(found, before, repair).isEmpty():
            raise RepairRejected(f"{repair.id}: no finding corresponds to a match")
        new = cut(replaced(found, repair))
        if not merging(new).isEmpty():
            raise RepairRejected(f"{repair.id}: two statements would become one")
        after = cut(rewritten(now, repair))
        if not all(same_set(is_, want) for is_, want in zip(delta(now, after), expected(now, found, new), strict=True)):
            raise RepairRejected(f"{repair.id}: the update does not do exactly what is expected")
        if not unmet(after, new, repair).isEmpty():
            raise RepairRejected(f"{repair.id}: the bad IRI remains, or a replacement is missing")
        rows = records(now, new, repair)
        changes = cut(rows) if changes is None else cut(changes.unionByName(rows))
        now = after
        applied.append(repair)
    if applied and not (guard(start, now) if guard else regressions(validate(now), before)).isEmpty():
        raise RepairRejected("the repairs introduce a new violation")
    if changes is None:
        changes = start.sparkSession.createDataFrame([], ", ".join(f"{c} {'boolean' if c == 'replacement_added' else 'string'}" for c in CHANGE_FIELDS))
    return RepairResult(now, changes.orderBy(*CHANGE_FIELDS), applied)
