"""Validation: all modules in one plan, then their union."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwarden.functions.terms import RDFS, SKOS, TRIPLE_FIELDS, TYPE
from graphwarden.operators import findings as fd
from graphwarden.operators.bnodes import stable
from graphwarden.operators.closure import checkpointed
from graphwarden.operators.repair import delta
from graphwarden.operators.rules import UNION, subclasses
from graphwarden.plans.profiles import Context, Rule, component, registry, rule_count
from graphwarden.sources.store import write as write_store

#: Called with (rule, None, focus nodes) when a rule begins, and (rule, seconds, findings) when its findings are made.
Progress = Callable[[str, float | None, int], None]

#: Shares in which a support graph is dealt to scopes.
SHARES = 64


class PeakHeap:
    """The most heap that the driver's JVM was seen to use, in MiB, by a thread that looks now and then."""

    def __init__(self, spark: SparkSession, every: float = 0.05):
        self._runtime, self._every, self._done = spark._jvm.java.lang.Runtime.getRuntime(), every, threading.Event()
        self.mib = 0.0

    def __enter__(self) -> "PeakHeap":
        self._thread = threading.Thread(target=self._look, daemon=True)
        self._thread.start()
        return self

    def _look(self) -> None:
        while True:
            self.mib = max(self.mib, (self._runtime.totalMemory() - self._runtime.freeMemory()) / 2**20)
            if self._done.wait(self._every):
                return

    def __exit__(self, *_) -> None:
        self._done.set()
        self._thread.join()


def scoped(triples: DataFrame, support: DataFrame | None, union: bool) -> DataFrame:
    """Distinct triples by scope, with the support graph in every scope: its statements meet the scopes by a join on SHARES shares of them, and neither side is broadcast unseen."""
    cols = [c for c in TRIPLE_FIELDS if c != "module"]
    own = triples.select((F.lit(UNION) if union else F.col("module")).alias("scope"), *cols)
    if support is not None:
        scopes = own.select("scope").distinct().withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
        dealt = support.select(*cols).withColumn("share", F.pmod(F.xxhash64("s_nt", "p", "o_nt"), F.lit(SHARES)).cast("int"))
        own = own.unionByName(dealt.join(scopes, "share").select("scope", *cols))
    return own.distinct()


def _focus_nodes(rule: Rule, t: DataFrame) -> int:
    if not rule.subjects:
        return t.select("scope").distinct().count()
    return t.where(F.col("p").isin(*rule.subjects)).select("scope", "s_nt").distinct().count()


def findings(triples: DataFrame, context: Context, rules: list[Rule], support: DataFrame | None = None, union: bool = False, progress: Progress | None = None, store: str | None = None) -> DataFrame:
    """Findings without signature of the rules over modules, or over their union; every rule is run once, and nothing of the graph stays in memory.

    With a folder `store`, the graph is kept there (sources/store.py) and rules join on its ids; rules of one's
    own, whose text names spellings, read its spellings. With progress, each rule's findings are made one
    after another, and timed.
    """
    t = scoped(triples, support, union)
    kept = write_store(t, store) if store else None
    t = kept.plain if kept else t.persist()  # read once by each rule
    keys = kept.keyed if kept else t
    if any(r.profile == "full" or r.shape for r in rules):
        context = replace(context, below=subclasses(keys))
    own = replace(context, below=subclasses(t)) if kept and any(r.shape for r in rules) else context
    parts = []
    for rule in rules:
        if progress:
            progress(rule.name, None, _focus_nodes(rule, t))
        began = time.monotonic()
        part = fd.bag(rule.build(t, own) if rule.shape else rule.build(keys, context), rule.iri(context), rule.severity, component(rule), rule.message)
        if progress:
            part = checkpointed(part)
            progress(rule.name, time.monotonic() - began, part.count())
        parts.append(part)
    found = reduce(DataFrame.unionByName, parts)
    found = checkpointed(kept.spelled(found) if kept else found)
    out = stable(found, t)
    if kept:
        kept.drop()
    else:
        t.unpersist()
    return out


def local_findings(triples: DataFrame, context: Context, profile: str, support: DataFrame | None = None) -> DataFrame:
    """Signed findings of single modules: what repairs are guarded by."""
    return fd.signed(findings(triples, context, registry(profile, False), support))


def affected(before: DataFrame, after: DataFrame, profile: str) -> tuple[DataFrame, DataFrame]:
    """What of two states of a graph a profile's violations must be looked for in again, from the statements that changed.

    That is: statements of subjects with a change; the subclass links of their modules, and the instances of
    classes that these links place elsewhere than before; the hierarchy of modules where it changed; and all of a module
    where a blank node's statement changed, as names of blank nodes may change with it. Rules see the
    same of what did not change in both states, so it adds no difference.
    """
    lost, won = delta(before, after)
    changed = checkpointed(lost.unionByName(won))
    blank, hierarchy, classes = F.col("s_nt").startswith("_:") | F.col("o_nt").startswith("_:"), F.col("p").isin(SKOS + "broader", SKOS + "related"), F.col("p") == RDFS + "subClassOf"
    modules = checkpointed(changed.groupBy("module").agg(F.max(blank).alias("whole"), F.max(hierarchy).alias("linked"), F.max(classes).alias("classed")))
    # only these modules are read any further
    states = [t.select(*TRIPLE_FIELDS).join(modules, "module") for t in (before, after)]
    subjects = changed.select("module", "s_nt")
    if profile == "full" and not modules.where("classed").isEmpty():
        below = [checkpointed(subclasses(t.where("classed").withColumnRenamed("module", "scope"))) for t in states]
        moved = below[0].subtract(below[1]).unionByName(below[1].subtract(below[0])).select(F.col("scope").alias("module"), F.col("a").alias("o_nt"))
        for t in states:
            subjects = subjects.unionByName(t.where(F.col("p") == TYPE).join(moved, ["module", "o_nt"], "left_semi").select("module", "s_nt"))
    subjects = checkpointed(subjects.distinct().withColumn("__hit", F.lit(True)))
    wanted = F.col("whole") | F.col("__hit").isNotNull() | classes | (F.col("linked") & hierarchy)
    return tuple(checkpointed(t.join(subjects, ["module", "s_nt"], "left").where(wanted).select(*TRIPLE_FIELDS)) for t in states)


def new_violations(before: DataFrame, after: DataFrame, context: Context, profile: str) -> DataFrame:
    """Violations in single modules that `after` has and `before` has not, found by what changed alone."""
    checks = [r for r in registry(profile, False) if r.severity == fd.VIOLATION]
    was, now = (fd.signed(findings(t, context, checks)) for t in affected(before, after, profile))
    return fd.regressions(now, was)


@dataclass
class Run:
    findings: DataFrame
    regressions: DataFrame
    faults: DataFrame
    modules: int
    triples: int
    rules: int
    timings: list[tuple[str, float]] = field(default_factory=list)
    peak_mib: float = 0.0

    @property
    def failed(self) -> bool:
        return not self.faults.isEmpty()

    def summary(self) -> str:
        n = fd.severity_counts(self.findings).first()
        new = fd.ordered(self.regressions).limit(21).collect()
        lines = [f"modules: {self.modules}", f"triples: {self.triples}", f"rules: {self.rules}", f"violations: {n.violations}, warnings: {n.warnings}, info: {n.infos}"]
        lines += [f"failed: {r.module}: {r.fault}" for r in self.faults.orderBy("module").collect()]
        total = self.regressions.count() if len(new) > 20 else len(new)
        lines.append(f"new violations: {total}")
        lines += [f"  {r.signature} {r.rule} {r.focus} {r.path} {r.value} {r.source_module}" for r in new[:20]]
        if total > 20:
            lines.append(f"  ... and {total - 20} more")
        lines += [f"peak driver heap: {self.peak_mib:.0f} MiB"] if self.peak_mib else []
        lines += [f"union rule {name}: {seconds * 1000:.0f} ms" for name, seconds in self.timings]
        return "\n".join(lines) + "\n"


def validate(triples: DataFrame, faults: DataFrame, context: Context, profile: str = "full", cross: bool = False, support: DataFrame | None = None, accepted: DataFrame | None = None, progress: Progress | None = None, store: str | None = None, own: tuple[Rule, ...] = ()) -> Run:
    """One run of a profile's rules and of one's own (shapes.read_shapes()). The union is looked at only if every module could be read; what a module has found already is not told again."""
    spark = triples.sparkSession
    with PeakHeap(spark) as heap:
        triples = triples.select(*TRIPLE_FIELDS).distinct().persist()
        local = findings(triples, context, [*registry(profile, False), *own], support).persist()
        every, timings = fd.signed(local), []
        looked = cross and faults.isEmpty()
        if looked:

            def timed(name: str, seconds: float | None, rows: int) -> None:
                if seconds is not None:
                    timings.append((name, seconds))
                if progress:
                    progress(name, seconds, rows)

            union = findings(triples, context, [*registry(profile, True), *own], support, union=True, progress=timed, store=store)
            every = every.unionByName(fd.signed(fd.new_in_union(local, union)))
        every = every.persist()
        every.count()
        accepted = accepted if accepted is not None else spark.createDataFrame([], "signature string")
        counts = triples.groupBy("module").count().agg(F.count("*").alias("m"), F.coalesce(F.sum("count"), F.lit(0)).alias("t")).first()
        triples.unpersist()
        local.unpersist()
    return Run(every, fd.regressions(every, accepted), faults, counts.m, counts.t, rule_count(profile, looked) + len({r.name for r in own}), timings, heap.mib)


def check_file(spark: SparkSession, path: str, context: Context, profile: str = "full") -> tuple[bool, list]:
    """(whether a file conforms, its findings in order): one file through a profile, for fixtures."""
    from graphwarden.sources import turtle

    triples, faults = turtle.read(spark, [(path, path)])
    found = fd.ordered(validate(triples, faults, context, profile).findings).collect()
    return not found and faults.isEmpty(), found
