"""validate, repair and manifest on the command line. Exit 0: ok, 1: new violations (or another manifest), 2: bad input or failure."""

from __future__ import annotations

import argparse
import os
import sys
from datetime import UTC, datetime

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from graphwarden import sinks
from graphwarden.functions.terms import STANDARD_NAMESPACES
from graphwarden.operators import repair as rp
from graphwarden.operators.closure import checkpointed
from graphwarden.plans.profiles import PROFILES, Context, broadest
from graphwarden.plans.shapes import read_shapes
from graphwarden.plans.validation import local_findings, new_violations, validate
from graphwarden.sources import files, tables, turtle


def options() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="graphwarden")
    sub = top.add_subparsers(dest="command", required=True)
    for name, profile in (("validate", "full"), ("repair", "core")):
        p = sub.add_parser(name)
        p.add_argument("--data", action="append", required=True)
        known = p.add_mutually_exclusive_group(required=True)
        known.add_argument("--vocabulary", action="append", help="files that declare the standard terms")
        known.add_argument("--manifest", help="a manifest of them that was made before")
        p.add_argument("--profile", choices=PROFILES, default=profile)
        p.add_argument("--root", default=".")
        for n in ("domain", "actors", "conflicts"):
            p.add_argument(f"--{n}")
        p.add_argument("--internal", action="append")
        if name == "validate":
            p.add_argument("--cross-module", action="store_true")
            p.add_argument("--shapes", action="append", help="files of SHACL property shapes that are checked beside the profile")
            p.add_argument("--store", help="a new folder for the union on disk; goes with --cross-module")
            for n in ("report", "summary", "baseline", "write-baseline"):
                p.add_argument(f"--{n}")
        else:
            p.add_argument("--catalog", action="append", help="files that define repairs, in place of the standard ones")
            which = p.add_mutually_exclusive_group(required=True)
            which.add_argument("--repair", action="append")
            which.add_argument("--all-automatic", action="store_true")
            how = p.add_mutually_exclusive_group(required=True)
            how.add_argument("--dry-run", action="store_true")
            how.add_argument("--apply", action="store_true")
            for n in ("output-dir", "patch", "provenance"):
                p.add_argument(f"--{n}")
    p = sub.add_parser("manifest")
    p.add_argument("--vocabulary", action="append", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--check", action="store_true", help="compare with the file instead of writing it")
    return top


def _read(spark: SparkSession, paths: list[str], what: str) -> DataFrame:
    triples, faults = turtle.read(spark, [(p, p) for p in paths])
    if not faults.isEmpty():
        raise ValueError(f"{what} cannot be read: {faults.first().fault}")
    return triples


def _context(spark: SparkSession, o) -> Context:
    if o.manifest:
        terms = tables.manifest_from_support(_read(spark, files.discover([o.manifest]), "the manifest"))
    else:
        terms = tables.manifest(_read(spark, _vocabularies(o.vocabulary), "a vocabulary"), list(STANDARD_NAMESPACES))
    given = {n: getattr(o, n) for n in ("domain", "actors", "conflicts") if getattr(o, n)}
    if o.internal:
        given["internal"] = tuple(o.internal)
    return Context(terms.persist(), **given)


def _vocabularies(given: list[str]) -> list[str]:
    """Files; a directory must hold some."""
    return sorted({p for x in given for p in (files.required(x) if os.path.isdir(x) else files.discover([x]))})


def run_manifest(spark: SparkSession, o) -> int:
    terms = tables.manifest(_read(spark, _vocabularies(o.vocabulary), "a vocabulary"), list(STANDARD_NAMESPACES))
    lines = [r.value for r in tables.manifest_lines(terms).collect()]  # the terms of a few vocabularies
    if not o.check:
        sinks.check_outputs([o.output], _vocabularies(o.vocabulary))
        sinks.write_atomically(o.output, lines)
        return 0
    with open(o.output, encoding="utf-8") as there:
        if there.read().splitlines() == lines:
            return 0
    print(f"{o.output} is not what the vocabularies give", file=sys.stderr)
    return 1


def _told(name: str, seconds: float | None, rows: int) -> None:
    print(f"{name}: {rows} focus nodes" if seconds is None else f"{name}: {rows} findings in {seconds * 1000:.0f} ms", file=sys.stderr)


def run_validate(spark: SparkSession, o) -> int:
    if o.store and not o.cross_module:
        raise ValueError("--store goes with --cross-module")
    found = files.discover(o.data)
    outputs = [x for x in (o.report, o.summary, o.write_baseline) if x]
    sinks.check_outputs(outputs, [*found, *([o.baseline] if o.baseline else [])])
    accepted = tables.read_baseline(spark, o.baseline).persist()
    accepted.count()
    triples, faults = turtle.read(spark, [(p, files.module_name(p, o.root)) for p in found])
    run = validate(triples, faults.persist(), _context(spark, o), o.profile, o.cross_module, accepted=accepted, progress=_told, store=o.store, own=tuple(read_shapes(_read(spark, files.discover(o.shapes), "a file of shapes"))) if o.shapes else ())
    text = run.summary()
    if o.summary:
        sinks.write_atomically(o.summary, text.splitlines())
    print(text, end="")
    if run.failed:
        return 2  # a report or baseline of part of the data would mislead
    if o.report:
        sinks.write_report(run.findings, o.report)
    if o.write_baseline:
        sinks.write_baseline(run.findings, o.write_baseline)
    return int(not run.regressions.isEmpty())


def run_repair(spark: SparkSession, o) -> int:
    if o.apply != bool(o.output_dir):
        raise ValueError("--output-dir goes with --apply")
    found = files.discover(o.data)
    outputs = [x for x in (o.patch, o.provenance) if x]
    sinks.check_outputs(outputs, found)
    for x in outputs:
        if os.path.exists(x):
            raise ValueError(f"output exists: {x}")
        if o.output_dir and os.path.abspath(x).startswith(os.path.abspath(o.output_dir) + os.sep):
            raise ValueError(f"output lies in the output directory: {x}")
    context = _context(spark, o)
    defined = rp.read_catalog(_read(spark, files.discover(o.catalog), "a catalog")) if o.catalog else rp.standard_catalog(f"<{context.rules_namespace}KnownVocabularyTerm>")
    repairs = rp.selected(defined, o.repair)
    profile = broadest([o.profile, *(r.profile for r in repairs)])
    modules = {files.module_name(p, o.root): p for p in found}
    triples, faults = turtle.read(spark, [(p, m) for m, p in modules.items()])
    if not faults.isEmpty():
        raise ValueError(f"a module cannot be read: {faults.first().fault}")
    triples = triples.persist()
    done = rp.apply(triples, repairs, lambda t: local_findings(t, context, profile), checkpointed, lambda was, now: new_violations(was, now, context, profile))
    patch = sinks.patch_lines(done.applied)
    if o.apply:
        sinks.publish_copies(triples, done.triples, modules, o.output_dir)
    if o.patch:
        sinks.write_atomically(o.patch, patch)
    else:
        print("\n".join(patch))
    if o.provenance:
        when = datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ")
        sinks.write_sorted(sinks.provenance_lines(done.changes, when), o.provenance)
    print(f"{done.changes.count()} changes by {len(done.applied)} repairs")
    return 0


def main(argv: list[str] | None = None) -> int:
    o = options().parse_args(argv)
    spark = SparkSession.builder.appName("graphwarden").getOrCreate()
    try:
        return {"validate": run_validate, "repair": run_repair, "manifest": run_manifest}[o.command](spark, o)
    except (ValueError, OSError, PySparkException) as e:
        print(f"error: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
