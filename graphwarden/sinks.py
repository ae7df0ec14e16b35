"""Writers: report, baseline, repaired copies, provenance, patch; and where they may write.

Lines that grow with the data are sorted and written by tasks, each its range, into the shared folder; Spark
commits the files of finished tasks alone. The driver's JVM then joins their bytes, in order, to one file beside
the target and moves it there: no line passes through Python.
"""

from __future__ import annotations

import os
import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwarden.functions.terms import LITERAL, SH, TYPE, XSD, iri_nt, literal_nt, sha256
from graphwarden.operators.closure import new_folder
from graphwarden.operators.repair import CHANGE_FIELDS, Repair
from graphwarden.sources.files import syntax
from graphwarden.sources.tables import HEADER, baseline_lines

REPORT = "<urn:graphwarden:validation-report>"
RESULT = "urn:graphwarden:result:"


def write_atomically(path: str, lines) -> None:
    """Write text lines to a file beside `path`, then move it there."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, staged = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="\n") as out:
            out.writelines(line + "\n" for line in lines)
        os.replace(staged, target)
    finally:
        if os.path.exists(staged):
            os.unlink(staged)


def _joined(spark: SparkSession, folder: str, path: str, head: list[str], foot: list[str] | tuple = ()) -> None:
    """The head's lines, the text files of a folder by their names, if there are any, and the foot's lines, as one file at path."""
    jvm, target = spark._jvm, Path(path)
    at = jvm.org.apache.hadoop.fs.Path(folder)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted((x.getPath().toString() for x in (system.listStatus(at) if system.exists(at) else ()) if x.getPath().getName().startswith("part-")))
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, staged = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="\n") as out:
            out.writelines(line + "\n" for line in head)
        out = jvm.java.io.FileOutputStream(staged, True)
        try:
            for part in parts:
                read = system.open(jvm.org.apache.hadoop.fs.Path(part))
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(read, out, 1 << 16, False)
                finally:
                    read.close()
        finally:
            out.close()
        with open(staged, "a", encoding="utf-8", newline="\n") as out:
            out.writelines(line + "\n" for line in foot)
        os.replace(staged, target)
    finally:
        if os.path.exists(staged):
            os.unlink(staged)


def write_sorted(lines: DataFrame, path: str, head: list[str] = ()) -> None:
    """Lines (value) in the order they have, behind a head, as one file."""
    folder = new_folder(lines.sparkSession)
    lines.select("value").write.option("lineSep", "\n").text(folder)
    _joined(lines.sparkSession, folder, path, list(head))


def report_lines(findings: DataFrame) -> DataFrame:
    """(value): the SHACL report as sorted, distinct N-Triples lines; it conforms only if there is no finding at all."""
    conforms = findings.limit(1).agg(F.concat(F.lit(f"{REPORT} <{SH}conforms> \""), (F.count("*") == 0).cast("string"), F.lit('"^^<http://www.w3.org/2001/XMLSchema#boolean> .')).alias("value"))
    kind = findings.sparkSession.createDataFrame([(f"{REPORT} <{TYPE}> <{SH}ValidationReport> .",)], "value string")
    result = iri_nt(F.concat(F.lit(RESULT), F.col("signature")))

    def plain(c):
        return literal_nt(F.col(c), F.lit(""), F.lit(""))

    own = [("resultSeverity", F.col("severity")), ("sourceShape", F.col("rule")), ("sourceConstraintComponent", F.col("constraint_component")), ("focusNode", F.col("focus")), ("resultPath", F.col("path")), ("value", F.col("value")), ("resultMessage", plain("message"))]
    facts = [F.concat(F.lit(f"{REPORT} <{SH}result> "), result, F.lit(" .")), F.concat(result, F.lit(f" <{TYPE}> <{SH}ValidationResult> ."))]
    facts += [F.when((term != "") & (term != '""'), F.concat(result, F.lit(f" <{SH}{name}> "), term, F.lit(" ."))) for name, term in own]
    facts += [F.concat(result, F.lit(f" <urn:graphwarden:{name}> "), plain(column), F.lit(" .")) for name, column in (("sourceModule", "source_module"), ("signature", "signature"))]
    lines = findings.select(F.explode(F.array(*facts)).alias("value")).where("value IS NOT NULL")
    return lines.unionByName(kind).unionByName(conforms).distinct().orderBy("value")


def write_report(findings: DataFrame, path: str) -> None:
    write_sorted(report_lines(findings), path, ["# validation report"])


def write_baseline(findings: DataFrame, path: str) -> None:
    write_sorted(baseline_lines(findings), path, list(HEADER))


def check_outputs(outputs: list[str], inputs: list[str]) -> None:
    """Outputs are no directories, and none equals, holds or lies in another output or an input."""
    seen: list[Path] = []
    for given in outputs:
        path = Path(given).absolute()
        if path.is_dir():
            raise ValueError(f"output is a directory: {given}")
        for other in [*seen, *(Path(i).absolute() for i in inputs)]:
            if path == other or path in other.parents or (other in path.parents and not other.is_dir()):
                raise ValueError(f"output {given} collides with {other}")
        seen.append(path)


def triple_lines(triples: DataFrame, *more: str) -> DataFrame:
    """(module, more, value): N-Triples lines; blank nodes get labels from the hash of their names."""

    def term(c):
        return F.when(F.col(c).startswith("_:"), F.concat(F.lit("_:b"), F.substring(F.sha2(F.col(c), 256), 1, 24))).otherwise(F.col(c))

    return triples.select("module", *more, F.concat(term("s_nt"), F.lit(" "), iri_nt(F.col("p")), F.lit(" "), term("o_nt"), F.lit(" .")).alias("value"))


#: A local name that needs no escape.
_LOCAL = r"[A-Za-z_][A-Za-z0-9_-]*"


PREFIXES = "array<struct<name:string,iri:string>>"


def turtle_lines(triples: DataFrame, prefixes: dict[str, str] | Column) -> DataFrame:
    """(module, value): Turtle statements, a line each, with names shortened by the prefixes where that needs no escape. prefixes may be a column of PREFIXES, of each module its own."""
    if isinstance(prefixes, dict):
        prefixes = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(i).alias("iri")) for n, i in sorted(prefixes.items())]).cast(PREFIXES)

    def short(term):
        def local(x):
            return F.substr(term, F.length(x["iri"]) + 2, F.length(term) - F.length(x["iri"]) - 2)

        fits = F.filter("__prefixes", lambda x: term.startswith(F.concat(F.lit("<"), x["iri"])) & local(x).rlike(f"^{_LOCAL}\\z"))
        # the longest start that fits
        best = F.array_max(F.transform(fits, lambda x: F.struct(F.length(x["iri"]).alias("size"), x["name"].alias("name"), x["iri"].alias("iri"))))
        return F.coalesce(F.concat(best["name"], F.lit(":"), local(best)), term)

    own = triple_lines(triples.withColumn("__prefixes", prefixes), "__prefixes").select("module", "__prefixes", F.split("value", " ", 3).alias("t"))
    statement = F.regexp_replace(F.get("t", F.lit(2)), r" \.$", "")
    return own.select("module", F.concat(short(F.get("t", F.lit(0))), F.lit(" "), short(F.get("t", F.lit(1))), F.lit(" "), short(statement), F.lit(" .")).alias("value"))


RDFXML_HEAD, RDFXML_FOOT = f'<rdf:RDF xmlns:rdf="{TYPE.removesuffix("type")}">', "</rdf:RDF>"


def rdfxml_lines(triples: DataFrame) -> DataFrame:
    """(module, value): elements of RDF/XML, a statement each and a line each. A predicate that does not end in a name, and characters that XML has not, are errors, as the syntax cannot say them."""

    def escaped(c, *more: tuple[str, str]):
        for char, said in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;"), ("\n", "&#10;"), *more):
            c = F.replace(c, F.lit(char), F.lit(said))
        return c

    def attribute(name: str, c):
        return F.concat(F.lit(f' {name}="'), escaped(c, ('"', "&quot;"), ("\t", "&#9;")), F.lit('"'))

    def node(name: str, c):
        return F.when(F.col(c).startswith("_:"), attribute("rdf:nodeID", F.concat(F.lit("b"), F.substring(F.sha2(F.col(c), 256), 1, 24)))).otherwise(attribute(name, F.expr(f"substr({c}, 2, length({c}) - 2)")))

    local = F.regexp_extract("p", r"([\p{L}_][\p{L}\p{N}_.\-]*)$", 1)
    start = F.substr(F.col("p"), F.lit(1), F.length("p") - F.length(local))
    tag = F.concat(F.lit("p:"), local)
    said = F.when(F.col("o_lang") != "", attribute("xml:lang", F.col("o_lang"))).when(F.col("o_dt") != XSD + "string", attribute("rdf:datatype", F.col("o_dt"))).otherwise("")
    value = F.when(F.col("o_kind") == LITERAL, F.concat(said, F.lit(">"), escaped(F.col("o")), F.lit("</"), tag, F.lit(">"))).otherwise(F.concat(node("rdf:resource", "o_nt"), F.lit("/>")))
    line = F.concat(F.lit("<rdf:Description"), node("rdf:about", "s_nt"), F.lit("><"), tag, attribute("xmlns:p", start), value, F.lit("</rdf:Description>"))
    odd = (local == "") | ((F.col("o_kind") == LITERAL) & F.col("o").rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]"))
    return triples.select("module", F.when(odd, F.raise_error(F.concat(F.lit("RDF/XML cannot say: "), "s_nt", F.lit(" "), "p"))).otherwise(line).alias("value"))


def _prefixes(path: str) -> dict[str, str]:
    """The prefixes that a Turtle file binds, but those bound twice."""
    found: dict[str, set[str]] = {}
    with open(path, encoding="utf-8-sig") as lines:
        for line in lines:
            if m := re.match(r"\s*(?:@prefix|PREFIX)\s+([A-Za-z][A-Za-z0-9_-]*|):\s*<([A-Za-z][A-Za-z0-9+.-]*:[^>\\]*)>", line, re.IGNORECASE):
                found.setdefault(m[1], set()).add(m[2])
    return {name: next(iter(starts)) for name, starts in found.items() if len(starts) == 1}


def publish_copies(before: DataFrame, after: DataFrame, files: dict[str, str], directory: str) -> list[str]:
    """Copies of all modules in a new directory, written beside it and moved as a whole; unchanged modules keep their bytes, changed ones are in their own syntax, Turtle with the prefixes it had. Gives the changed modules."""
    target = Path(directory).absolute()
    if target.exists() and (not target.is_dir() or any(target.iterdir())):
        raise ValueError(f"the destination is not an empty directory: {directory}")
    key = ["module", "s_nt", "p", "o_nt"]
    lost, won = before.select(*key).subtract(after.select(*key)), after.select(*key).subtract(before.select(*key))
    changed = {r.module for r in lost.unionByName(won).select("module").distinct().collect()}
    target.parent.mkdir(parents=True, exist_ok=True)
    spark, folder = after.sparkSession, new_folder(after.sparkSession)
    numbered = sorted(changed)
    kinds = [syntax(files[m]) for m in numbered]
    own = [{} if kind in ("ntriples", "rdfxml") else _prefixes(files[m]) for m, kind in zip(numbered, kinds, strict=True)]
    # a row for each changed module
    rows = spark.createDataFrame([(m, n, sorted(p.items())) for n, (m, p) in enumerate(zip(numbered, own, strict=True))], f"module string, __n int, __own {PREFIXES}")
    if numbered:
        xml = F.col("module").isin([m for m, kind in zip(numbered, kinds, strict=True) if kind == "rdfxml"])
        lines = turtle_lines(after.where(~xml).join(F.broadcast(rows.drop("__n")), "module"), F.col("__own"))
        lines = lines.unionByName(rdfxml_lines(after.where(xml))).join(F.broadcast(rows.select("module", "__n")), "module")
        lines.repartitionByRange("__n", "value").sortWithinPartitions("__n", "value").select("__n", "value").write.partitionBy("__n").option("lineSep", "\n").text(folder)
    staged = Path(tempfile.mkdtemp(dir=target.parent, prefix=f".{target.name}."))
    try:
        for module, path in sorted(files.items()):
            name = module if not os.path.isabs(module) else os.path.basename(module)
            copy = (staged / name).resolve()
            if staged.resolve() not in copy.parents or copy.exists():
                raise ValueError(f"module {module} has no place of its own in {directory}")
            copy.parent.mkdir(parents=True, exist_ok=True)
            if module in changed:
                at = numbered.index(module)
                xml = kinds[at] == "rdfxml"
                _joined(spark, f"{folder}/__n={at}", str(copy), [RDFXML_HEAD] if xml else [f"@prefix {n}: <{i}> ." for n, i in sorted(own[at].items())], [RDFXML_FOOT] if xml else [])
            else:
                shutil.copyfile(path, copy)
        if target.exists():
            target.rmdir()
        os.replace(staged, target)
    finally:
        shutil.rmtree(staged, ignore_errors=True)
    return sorted(changed)


def patch_lines(applied: list[Repair]) -> list[str]:
    if not applied:
        return ["# no applicable repair"]
    parts = [f"# repair: {r.id}\n# rule: {r.rule}\n{r.update()}" for r in applied]
    return " ;\n".join(parts).split("\n")


def provenance_lines(changes: DataFrame, when: str) -> DataFrame:
    """(value): one graph update for each change, with its deleted and (if it was new) added statement, sorted."""
    dash = "http://datashapes.org/dash#"
    rdf = TYPE.removesuffix("type")
    run = F.lit(f"<urn:graphwarden:run:{when}>")
    change = changes.withColumn("id", sha256(*[F.col(c).cast("string") for c in CHANGE_FIELDS]))
    me = iri_nt(F.concat(F.lit("urn:graphwarden:change:"), F.col("id")))

    def statement(role: str, p: str, o: str):
        node = iri_nt(F.concat(F.lit(f"urn:graphwarden:{role}:"), F.col("id")))
        return [F.concat(me, F.lit(f" <{dash}{role}Triple> "), node, F.lit(" .")), F.concat(node, F.lit(f" <{rdf}subject> "), F.col("s"), F.lit(" .")), F.concat(node, F.lit(f" <{rdf}predicate> "), F.col(p), F.lit(" .")), F.concat(node, F.lit(f" <{rdf}object> "), F.col(o), F.lit(" ."))]

    facts = [F.concat(run, F.lit(f" <{TYPE}> <urn:graphwarden:RepairRun> .")), F.concat(run, F.lit(" <urn:graphwarden:update> "), me, F.lit(" .")), F.concat(me, F.lit(f" <{TYPE}> <{dash}GraphUpdate> .")), F.concat(me, F.lit(" <urn:graphwarden:repair> "), iri_nt(F.col("repair_id")), F.lit(" ."))]
    facts += statement("deleted", "p_before", "o_before")
    facts += [F.when(F.col("replacement_added"), x) for x in statement("added", "p_after", "o_after")]
    return change.select(F.explode(F.array(*facts)).alias("value")).where("value IS NOT NULL").distinct().orderBy("value")
