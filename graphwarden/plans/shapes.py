"""Rules as data: SHACL node shapes with property shapes and SPARQL constraints, read from triples.

A shape has targets (sh:targetClass, sh:targetSubjectsOf, sh:targetNode), properties (sh:property), each with
one predicate as sh:path and any of sh:minCount, sh:maxCount and sh:nodeKind sh:IRI, and queries (sh:sparql with
sh:select, and sh:prefixes by sh:declare), each with a sh:message and a sh:severity. Anything else of SHACL in it,
and of SPARQL beyond plans/sparql.py, is an error rather than left out.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphwarden.functions.terms import IRI, SH, TYPE
from graphwarden.operators import rules
from graphwarden.operators.findings import INFO, VIOLATION, WARNING
from graphwarden.plans import algebra
from graphwarden.plans.profiles import Context, Rule
from graphwarden.plans.sparql import SparqlError, read_select

TARGETS = ("targetClass", "targetSubjectsOf", "targetNode")
PARTS = ("path", "minCount", "maxCount", "nodeKind", "message", "severity", "name", "description")


def _targets(given: dict[str, list[str]]):
    """The focus nodes of a shape, as a function of triples and context."""

    def found(t: DataFrame, c: Context) -> DataFrame:
        parts = [rules.target_class(t, x, c.below) for x in given.get("targetClass", ())]
        parts += [rules.target_node(t, x) for x in given.get("targetNode", ())]
        if given.get("targetSubjectsOf"):
            parts.append(rules.target_subjects_of(t, *given["targetSubjectsOf"]))
        return reduce(DataFrame.unionByName, parts).distinct()

    return found


def read_shapes(triples: DataFrame) -> list[Rule]:
    """The rules that the shapes in triples define, by shape and path. Only statements in SHACL's terms, and types that are, go to the driver: definitions are a handful, whatever else the triples have."""
    said: dict[str, dict[str, list]] = defaultdict(lambda: defaultdict(list))
    stated = triples.where(F.col("p").startswith(SH) | ((F.col("p") == TYPE) & F.col("o").startswith(SH)))
    for r in sorted(stated.select("s_nt", "p", "o", "o_nt", "o_kind").distinct().collect()):
        said[r.s_nt]["type" if r.p == TYPE else r.p.removeprefix(SH)].append(r)
    out = []
    for node, own in said.items():
        if not any(r.o == SH + "NodeShape" for r in own["type"]):
            continue
        if not node.startswith("<"):
            raise ValueError("a node shape needs an IRI, which its findings bear")
        given = {k: [r.o for r in own[k]] for k in TARGETS if own.get(k)}
        if not given or any(r.o_kind != IRI for k in given for r in own[k]):
            raise ValueError(f"{node}: targets are IRIs, and there is one at least")
        if unknown := {k for k in own if k not in ("type", "property", "sparql", *TARGETS, *PARTS[4:])}:
            raise ValueError(f"{node}: {', '.join(sorted(unknown))} is not supported")
        for prop in own["property"]:
            out += _property(node[1:-1], _targets(given), said[prop.o_nt])
        for constraint in own["sparql"]:
            out.append(_query(node[1:-1], given, own, said[constraint.o_nt], said))
    return sorted(out, key=lambda r: (r.shape, r.source, r.component))


def _query(shape: str, given: dict[str, list[str]], own: dict[str, list], constraint: dict[str, list], said) -> Rule:
    """A SPARQL constraint as a rule. Its own message comes before the shape's, and a row's ?message before both."""
    if unknown := {k for k in constraint if k not in ("type", "select", "message", "prefixes")}:
        raise ValueError(f"{shape}: {', '.join(sorted(unknown))} is not supported")
    if len(constraint.get("select", ())) != 1:
        raise ValueError(f"{shape}: a SPARQL constraint has one sh:select")
    prefixes = {}
    for holder in constraint.get("prefixes", ()):
        for declared in said[holder.o_nt]["declare"]:
            stated = said[declared.o_nt]
            if len(stated.get("prefix", ())) != 1 or len(stated.get("namespace", ())) != 1:
                raise ValueError(f"{shape}: a declared prefix has one name and one namespace")
            prefixes[stated["prefix"][0].o] = stated["namespace"][0].o
    try:
        query = read_select(constraint["select"][0].o, prefixes)
    except SparqlError as e:
        raise ValueError(f"{shape}: {e}") from e
    if several := [k for k in ("message", "severity") if len(own.get(k, ())) > 1]:
        raise ValueError(f"{shape}: more than one {several[0]}")
    severity = own["severity"][0].o_nt if own.get("severity") else VIOLATION
    if severity not in (VIOLATION, WARNING, INFO):
        raise ValueError(f"{shape}: unknown severity {severity}")
    messages = [r.o for k in (constraint, own) for r in k.get("message", ())]
    several_nodes = {k: v for k, v in given.items() if k != "targetNode"}

    def build(t: DataFrame, c: Context) -> DataFrame:
        parts = [algebra.rule_rows(t, query, node=n) for n in given.get("targetNode", ())]
        if several_nodes:
            parts.append(algebra.rule_rows(t, query, _targets(several_nodes)(t, c)))
        return reduce(DataFrame.unionByName, parts)

    return Rule(shape, "core", severity, messages[0] if messages else "A solution of the shape's query.", "sh:sparql", "own", build, local=True, union=True, shape=shape)


def _property(shape: str, targets, own: dict[str, list]) -> list[Rule]:
    if unknown := {k for k in own if k != "type"} - set(PARTS):
        raise ValueError(f"{shape}: {', '.join(sorted(unknown))} is not supported")
    if several := [k for k in PARTS if len(own.get(k, ())) > 1]:
        raise ValueError(f"{shape}: more than one {several[0]}")
    value = {k: own[k][0] for k in PARTS if own.get(k)}
    if "path" not in value or value["path"].o_kind != IRI:
        raise ValueError(f"{shape}: a property needs one predicate as its path")
    path = value["path"].o
    severity = value["severity"].o_nt if "severity" in value else VIOLATION
    if severity not in (VIOLATION, WARNING, INFO):
        raise ValueError(f"{shape}: unknown severity {severity}")
    message = value["message"].o if "message" in value else f"The values of {path} are not as the shape asks."
    checks = []
    for name, component, check in (("minCount", "MinCountConstraintComponent", rules.min_count), ("maxCount", "MaxCountConstraintComponent", rules.max_count)):
        if name in value:
            checks.append((component, lambda t, c, n=int(value[name].o), check=check: check(t, targets(t, c), path, n)))
    if "nodeKind" in value:
        if value["nodeKind"].o != SH + "IRI":
            raise ValueError(f"{shape}: of node kinds sh:IRI is supported")
        checks.append(("NodeKindConstraintComponent", lambda t, c: rules.node_kind_iri(t, targets(t, c), path)))
    return [Rule(shape, "core", severity, message, path, "own", build, component, local=True, union=True, shape=shape) for component, build in checks]
