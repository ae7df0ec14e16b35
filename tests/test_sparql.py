"""SPARQL text as plans: values and patterns by small graphs, rules as text beside the built ones, updates, and what is refused."""

import random

import pytest
from pyspark.sql import functions as F
from test_validation import HEAD, Data

from graphwarden.functions.terms import SKOS, TYPE, XSD
from graphwarden.operators import repair as rp
from graphwarden.operators import rules
from graphwarden.operators.closure import checkpointed
from graphwarden.plans import algebra, rule_texts
from graphwarden.plans.shapes import read_shapes
from graphwarden.plans.sparql import SparqlError, read_select, read_update
from graphwarden.plans.validation import local_findings, validate

E = "urn:graphwarden:data:"
NAMES = {"e": E, "xsd": XSD, "skos": SKOS}


@pytest.fixture
def data(spark, tmp_path):
    return Data(spark, tmp_path)


def graph(data, **modules):
    triples, faults = data.read(**modules)
    assert faults.isEmpty()
    return triples.withColumnRenamed("module", "scope").persist()


def solved(t, text):
    """Solutions as sorted tuples of spellings, in the order of what is selected; None where unbound."""
    query = read_select(text, NAMES)
    rel = algebra.Graph(t).select(query)
    short = [tuple(x if x is None else x.replace(E, "").strip("<>") for x in r) for r in rel.df.select(*[algebra.name(v) for v, _ in query.items]).collect()]
    return sorted(short, key=str)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    return graph(Data(spark, tmp_path_factory.mktemp("small")), a=SMALL).coalesce(1).persist()


SMALL = """e:a e:p e:b , e:c ; e:n 1 , 2.5 , "x" , "y"@en . e:b e:p e:c ; e:n 10 ; e:day "1940-01-31"^^xsd:date . e:c e:p e:c ; e:day "1939-12-01"^^xsd:date . [] e:p e:a ."""


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("SELECT ?x { ?x e:p ?x }", [("c",)]),
        ("SELECT ?x ?y { ?x e:p ?y . ?y e:p e:c }", [("a", "b"), ("a", "c"), ("b", "c"), ("c", "c"), ("_", "a")]),
        ("SELECT ?x ?y { ?x e:p ?y FILTER(?x != ?y && isIRI(?x)) }", [("a", "b"), ("a", "c"), ("b", "c")]),
        ("SELECT DISTINCT ?p { ?x ?p ?y }", [("p",), ("n",), ("day",)]),
        ("SELECT ?v { ?x e:n ?v FILTER(?v > 1) }", [('"2.5"^^xsd:decimal',), ('"10"^^xsd:integer',)]),
        ("SELECT ?v { ?x e:n ?v FILTER(!(?v > 1)) }", [('"1"^^xsd:integer',)]),
        ('SELECT ?v { ?x e:n ?v FILTER(?v = "x" || LANG(?v) = "en") }', [('"x"',), ('"y"@en',)]),
        ("SELECT ?v { ?x e:n ?v FILTER(?v = 1.0) }", [('"1"^^xsd:integer',)]),
        ('SELECT ?v { ?x e:n ?v FILTER(?v != "x") }', [('"1"^^xsd:integer',), ('"10"^^xsd:integer',), ('"2.5"^^xsd:decimal',), ('"y"@en',)]),
        ("SELECT ?v { ?x e:n ?v FILTER(DATATYPE(?v) IN (xsd:integer)) }", [('"1"^^xsd:integer',), ('"10"^^xsd:integer',)]),
        ("SELECT ?v { ?x e:n ?v FILTER(?v NOT IN (1, 10)) }", [('"2.5"^^xsd:decimal',), ('"x"',), ('"y"@en',)]),
        ('SELECT ?v { ?x e:n ?v FILTER(REGEX(STR(?v), "^[0-9]+$") && STRLEN(STR(?v)) = 2) }', [('"10"^^xsd:integer',)]),
        ("SELECT ?x (STR(?x) AS ?s) { ?x e:p e:a }", [("_", None)]),
        ('SELECT (CONCAT(STR(?x), "-", "y") AS ?s) { ?x e:p e:c FILTER(isIRI(?x)) }', [('"a-y"',), ('"b-y"',), ('"c-y"',)]),
        ("SELECT (COALESCE(?s, ?x) AS ?v) { ?x e:p e:a BIND(STR(?x) AS ?s) }", [("_",)]),
        ('SELECT (IF(?x = e:a, "one", STR(?x)) AS ?v) { ?x e:p e:c }', [('"one"',), ('"b"',), ('"c"',)]),
        ("SELECT ?x { ?x e:p e:c FILTER NOT EXISTS { ?x e:day ?d } }", [("a",)]),
        ("SELECT ?x { ?x e:p e:c FILTER EXISTS { ?x e:day ?d FILTER(?d > \"1940-01-01\"^^xsd:date) } }", [("b",)]),
        ("SELECT ?x ?d { { ?x e:p e:b } UNION { ?x e:day ?d } }", [("a", None), ("b", '"1940-01-31"^^xsd:date'), ("c", '"1939-12-01"^^xsd:date')]),
        ("SELECT ?x (COUNT(DISTINCT ?y) AS ?n) { ?x e:p ?y } GROUP BY ?x HAVING (COUNT(DISTINCT ?y) > 1)", [("a", '"2"^^xsd:integer')]),
        ("SELECT (MAX(?d) AS ?m) (MIN(?d) AS ?l) (COUNT(*) AS ?n) { ?x e:day ?d }", [('"1940-01-31"^^xsd:date', '"1939-12-01"^^xsd:date', '"2"^^xsd:integer')]),
        ("SELECT (MAX(?v) AS ?m) { e:a e:n ?v FILTER(?v < 5) }", [('"2.5"^^xsd:decimal',)]),
        ("SELECT ?x ?k { VALUES (?x ?k) { (e:a 1) (e:b 2) (e:none 3) } ?x e:n ?v . FILTER(isLiteral(?v)) }", [("a", '"1"^^xsd:integer')] * 4 + [("b", '"2"^^xsd:integer')]),
        ("SELECT ?x { ?x ?p ?y . VALUES ?p { e:day } }", [("b",), ("c",)]),
        ("SELECT ?x ?n { ?x e:day ?d { SELECT ?x (COUNT(?y) AS ?n) { ?x e:p ?y } GROUP BY ?x } }", [("b", '"1"^^xsd:integer'), ("c", '"1"^^xsd:integer')]),
        ("SELECT ?x ?y { ?x e:p+ ?y . ?x e:n 10 }", [("b", "c")]),
        ("SELECT ?y { e:a e:p+ ?y }", [("b",), ("c",)]),
        ("SELECT ?x { ?x e:p+ ?x }", [("c",)]),
    ],
)
def test_solutions(small, text, wanted):
    found = solved(small, text)
    named = [tuple(x if x is None else "_" if x.startswith("_:") else x.replace(XSD, "xsd:").replace("^^<", "^^") for x in r) for r in found]
    assert sorted(named, key=str) == sorted(wanted, key=str)


def test_scopes_do_not_meet(data):
    t = graph(data, a="e:a e:p e:b .", b="e:b e:p e:c .")
    assert solved(t, "SELECT ?x ?z { ?x e:p ?y . ?y e:p ?z }") == []
    assert solved(t.withColumn("scope", F.lit("u")), "SELECT ?x ?z { ?x e:p ?y . ?y e:p ?z }") == [("a", "c")]


def test_strings_are_ordered_by_utf_16(data):
    t = graph(data, a='e:a e:p "�" , "\U0001f600" .')
    assert solved(t, 'SELECT (MIN(?v) AS ?m) { ?x e:p ?v }') == [('"\U0001f600"',)]
    assert solved(t, 'SELECT ?v { ?x e:p ?v FILTER(?v < "\\uFFFD") }') == [('"\U0001f600"',)]


@pytest.mark.parametrize(
    "text",
    [
        "SELECT ?x { ?x e:p ?y OPTIONAL { ?y e:p ?z } }",
        "SELECT ?x { ?x e:p ?y MINUS { ?y e:p ?z } }",
        "SELECT ?x { GRAPH e:g { ?x e:p ?y } }",
        "SELECT ?x { ?x e:p/e:q ?y }",
        "SELECT ?x { ?x e:p* ?y }",
        "SELECT ?x { ?x ^e:p ?y }",
        "SELECT ?x { ?x e:p ?y } ORDER BY ?x",
        "SELECT ?x { ?x e:p ?y } LIMIT 3",
        "SELECT (SUM(?y) AS ?n) { ?x e:p ?y }",
        "SELECT ?x { ?x e:p ?y FILTER(RAND() > 1) }",
        "SELECT ?x { ?x e:p ?y FILTER(?x + 1 > 2) }",
        "SELECT ?x { ?x e:p [] }",
        "SELECT ?x { ?x none:p ?y }",
        "SELECT ?x { ?x e:p ?y ",
        "SELECT { ?x e:p ?y }",
        "ASK { ?x e:p ?y }",
        "SELECT ?x { ?x e:p 'a\\q' }",
    ],
)
def test_text_beyond_the_supported_part_is_refused(text):
    with pytest.raises(SparqlError):
        read_select(text, NAMES)


@pytest.mark.parametrize(
    "text",
    [
        "SELECT ?x { ?x e:p ?y . ?z e:p ?w }",  # a cross product
        "SELECT ?x { { ?x e:p ?y } UNION { ?x e:q ?z } ?y e:n ?v }",  # a join key that may be unbound
        "SELECT ?none { ?x e:p ?y }",
        "SELECT ?x { ?x e:p ?y FILTER NOT EXISTS { ?y e:p ?z FILTER(?x = ?z) } }",  # over a variable of the outer group
        "SELECT ?x (COUNT(?y) AS ?n) { ?x e:p ?y BIND(STR(?y) AS ?s) } GROUP BY ?s",
        "SELECT ?x { ?x e:p ?y BIND(?x AS ?y) }",
        "SELECT ?x { ?x e:p ?y FILTER(REGEX(STR(?y), STR(?x))) }",
    ],
)
def test_plans_that_would_be_something_else_are_refused(small, text):
    with pytest.raises(SparqlError):
        solved(small, text)


def shown(rows):
    return sorted(tuple(r) for r in rows.select("scope", "focus", "path", "value", F.coalesce("message", F.lit("")), "occurrence").collect())


def test_rules_as_text_equal_the_built_ones_on_random_graphs(data, spark):
    rng = random.Random(4)
    nodes = [f"e:n{i}" for i in range(7)] + ["_:x", "_:y"]
    nodes_to = [f"e:m{i}" for i in range(5)]
    modules = {}
    for m in ("a", "b"):
        out = []
        for _ in range(120):
            s, o = rng.choice(nodes), rng.choice(nodes)
            label = rng.choice(['"é"', '"e"@en', '"f"@en', '"f"@de', '"f"', '"\U0001f600"@en'])
            out += [f"{s} {rng.choice(['skos:broader', 'skos:related', 'skos:related', 'rdfs:range', 'd:first', 'd:second'])} {o} ."]
            out += [f"{s} d:to {rng.choice([*nodes, *nodes_to])} ."]
            out += [f"{s} {rng.choice(['skos:prefLabel', 'skos:altLabel', 'skos:hiddenLabel', 'dct:identifier', 'skos:made'])} {label} ."] if rng.random() < 0.5 else []
            out += [f"{s} a {rng.choice(['rdfs:Class', 'd:Birth', 'd:Death', 'skos:Made', 'owl:Class', 'rdf:Property'])} ."] if rng.random() < 0.2 else []
        for i in range(16):
            out += [f'e:ev{i} a d:{rng.choice(["Birth", "Death"])} ; d:who e:n{rng.randrange(4)} ; crm:P4_has_time-span e:s{i} . e:s{i} d:at "19{rng.randint(10, 45)}-0{rng.randint(1, 9)}-11"^^xsd:date .']
        modules[m] = " ".join([*out, "e:n1 rdfs:range e:n2 . e:n3 a rdfs:Class ."])
    t = graph(data, **modules)
    manifest = spark.createDataFrame([(SKOS + "broader", False, True), (TYPE, False, True), (SKOS + "prefLabel", False, True), (rules.RDFS + "Class", True, False)], "term string, is_class boolean, is_predicate boolean")
    said = " ".join(f'<{r.term}> <urn:graphwarden:{"isClass" if r.is_class else "isPredicate"}> "true" .' for r in manifest.collect())
    with_manifest = graph(data, **{m: x + " " + said for m, x in modules.items()})
    d, broader, related = "urn:graphwarden:domain:", SKOS + "broader", SKOS + "related"
    labels = [SKOS + x for x in ("prefLabel", "altLabel", "hiddenLabel")]
    span = "http://www.cidoc-crm.org/cidoc-crm/P4_has_time-span"
    audit = rules.AUDIT_TARGET[1:-1]
    born, died = (d + "Birth", d + "who", d + "at"), (d + "Death", d + "who", d + "at")
    cases = [
        (rules.known_terms(t, manifest), rule_texts.known_terms(), {"node": audit}, with_manifest),
        (rules.preferred_label_language(t), rule_texts.preferred_label_language(), {"targets": rules.target_subjects_of(t, labels[0])}, t),
        (rules.label_disjointness(t), rule_texts.label_disjointness(), {"targets": rules.target_subjects_of(t, *labels)}, t),
        (rules.self_link(t, broader), rule_texts.self_link(broader), {"targets": rules.target_subjects_of(t, broader)}, t),
        (rules.link_cycle(t), rule_texts.link_cycle(), {"targets": rules.target_subjects_of(t, broader)}, t),
        (rules.closure_disjoint(t), rule_texts.closure_disjoint(), {"targets": rules.target_subjects_of(t, broader, related)}, t),
        (rules.duplicate_identifier(t), rule_texts.duplicate_identifier(), {"node": audit}, t),
        (rules.chronology(t, born, died, span), rule_texts.chronology(born, died, span), {"node": audit}, t),
        (rules.dangling_reference(t, [E]), rule_texts.dangling_reference([E]), {"node": audit}, t),
        (rules.typed_participant(t, d + "to", E, [d + "Birth", rules.RDFS + "Class"]), rule_texts.typed_participant(d + "to", E, [d + "Birth", rules.RDFS + "Class"]), {"node": audit}, t),
        (rules.same_value(t, rules.target_class(t, d + "Birth"), d + "first", d + "second"), rule_texts.same_value(d + "first", d + "second"), {"targets": rules.target_class(t, d + "Birth")}, t),
        (rules.node_target_pair(t, E + "n1", E + "n2", E + "n3"), rule_texts.node_target_pair(E + "n2", E + "n3"), {"node": E + "n1"}, t),
    ]
    empty = 0
    for built, text, how, triples in cases:
        want, found = shown(built), shown(algebra.rule_rows(triples, read_select(text), **how))
        assert found == want, text
        empty += not want
    assert not empty


SHAPES = """@prefix sh: <http://www.w3.org/ns/shacl#> .
e:names sh:declare [ sh:prefix "skos" ; sh:namespace "http://www.w3.org/2004/02/skos/core#" ] .
e:Quoted a sh:NodeShape ; dct:source e:book ; sh:targetSubjectsOf skos:altLabel ; sh:severity sh:Warning ; sh:message "of the shape" ;
  sh:sparql [ a sh:SPARQLConstraint ; sh:prefixes e:names ; sh:select \"\"\"SELECT $this (skos:altLabel AS ?path) ?value { $this skos:altLabel ?value FILTER(STRSTARTS(STR(?value), "'")) }\"\"\" ] .
e:Whole a sh:NodeShape ; sh:targetNode e:audit ; sh:sparql [ sh:message "of the query" ; sh:select \"\"\"PREFIX skos: <http://www.w3.org/2004/02/skos/core#>
  SELECT $this ?value ?message { ?value a skos:Concept FILTER NOT EXISTS { ?value skos:prefLabel ?any } BIND(CONCAT("no label on ", STR(?value)) AS ?message) }\"\"\" ] .
"""


def test_shapes_with_queries(data):
    shapes, _ = data.read(s=SHAPES)
    own = read_shapes(shapes)
    triples, faults = data.read(a="""e:a a skos:Concept ; skos:altLabel "'x" , "y" . _:b a skos:Concept . e:c a skos:Concept ; skos:prefLabel "c" .""")
    run = validate(triples, faults, data.context(), "core", own=tuple(own))
    told = sorted((r.rule.rsplit(":")[-1].strip(">"), r.severity.rsplit("#")[-1].strip(">"), r.focus.rsplit(":")[-1].strip(">"), r.path.rsplit("#")[-1].strip(">"), r.message) for r in run.findings.collect())
    assert told == [("Quoted", "Warning", "a", "altLabel", "of the shape"), ("Whole", "Violation", "audit", "", f"no label on {E}a"), ("Whole", "Violation", "audit", "", "of the query")]
    for bad in ('sh:select "SELECT ?x { ?x ?p ?y } LIMIT 2"', 'sh:ask "ASK {}"', 'sh:select "SELECT $this { }" , "SELECT $this {}"', "sh:message 'none'"):
        with pytest.raises(ValueError):
            read_shapes(data.read(s=HEAD.splitlines()[0] + f"@prefix sh: <http://www.w3.org/ns/shacl#> . e:S a sh:NodeShape ; sh:targetNode e:a ; sh:sparql [ {bad} ] .")[0])


def test_updates(data, spark):
    rng = random.Random(8)
    said = {(f"n{rng.randrange(9)}", rng.choice(["p", "q", "r"]), f"n{rng.randrange(9)}") for _ in range(70)}
    t = graph(data, a=" ".join(f"e:{s} e:{p} e:{o} ." for s, p, o in said))
    cases = [
        ("DELETE { ?x e:p ?y } INSERT { ?y e:p ?x } WHERE { ?x e:p ?y }", lambda g: {x for x in g if x[1] != "p"} | {(o, "p", s) for s, p, o in g if p == "p"}),
        ("DELETE { ?x e:q ?x } WHERE { ?x e:q ?x }", lambda g: {x for x in g if not (x[1] == "q" and x[0] == x[2])}),
        ("DELETE { ?x e:q ?y } WHERE { ?x e:q ?y ; e:p ?z }", lambda g: {x for x in g if not (x[1] == "q" and any(y[0] == x[0] and y[1] == "p" for y in g))}),
        ("INSERT DATA { e:n1 e:r e:n1 . e:n1 e:p e:new } ; DELETE DATA { e:n1 e:r e:n1 }", lambda g: {x for x in g if x != ("n1", "r", "n1")} | {("n1", "p", "new")}),
        ("DELETE WHERE { ?x e:r e:n2 }", lambda g: {x for x in g if not (x[1] == "r" and x[2] == "n2")}),
        ("INSERT { ?x ?y e:n0 } WHERE { ?x e:p ?y }", lambda g: g | {(s, o, "n0") for s, p, o in g if p == "p"}),
        ('INSERT { ?v e:bad ?x . ?x ?v e:n0 . ?x e:kept ?v } WHERE { ?x e:p ?y BIND("v" AS ?v) }', lambda g: g | {(s, "kept", '"v"') for s, p, o in g if p == "p"}),
    ]
    for text, plain in cases:
        found = algebra.updated(t, read_update(text, NAMES))
        assert found.count() == found.distinct().count()
        assert {tuple(x.replace(E, "").strip("<>") for x in r) for r in found.select("s_nt", "p", "o_nt").collect()} == plain(set(said)), text
    for bad in ("DELETE { ?x e:p ?none } WHERE { ?x e:p ?y }", "INSERT DATA { ?x e:p e:n1 }", "CLEAR ALL", "DELETE { ?x e:p+ ?y } WHERE { ?x e:p ?y }", "LOAD <urn:x>"):
        with pytest.raises(SparqlError):
            read_update(bad, NAMES)


DEFINE = '<urn:r:1> a <urn:graphwarden:Repair> ; <urn:graphwarden:rule> <urn:graphwarden:rule:KnownVocabularyTerm> ; <urn:graphwarden:bad> skos:altlabel ; <urn:graphwarden:replacement> skos:altLabel ; <urn:graphwarden:update> """PREFIX skos: <http://www.w3.org/2004/02/skos/core#> {}""" .'


def test_repairs_run_their_own_update_and_are_refused_if_it_does_something_else(data):
    own = "DELETE { ?s skos:altlabel ?o } INSERT { ?s skos:altLabel ?o } WHERE { ?s skos:altlabel ?o }"

    def repaired(update, text):
        catalog = rp.read_catalog(data.read(c=DEFINE.format(update))[0])
        assert catalog[0].update().endswith(update)
        return rp.apply(data.read(a=text)[0], catalog, lambda t: local_findings(t, data.context(), "core"), checkpointed)

    text = "e:a skos:altlabel 'x' ; skos:prefLabel 'y' . e:b skos:altlabel 'z' ."
    assert repaired(own, text).changes.count() == 2
    for other in (
        own + " ; DELETE WHERE { ?s skos:prefLabel ?o }",
        own.replace("INSERT { ?s skos:altLabel ?o }", "INSERT { ?s skos:altLabel ?o . ?s skos:hiddenLabel ?o }"),
        own.replace("INSERT { ?s skos:altLabel ?o }", ""),
        own.replace("WHERE { ?s skos:altlabel ?o }", "WHERE { ?s skos:altlabel ?o ; skos:prefLabel ?y }"),
    ):
        with pytest.raises(rp.RepairRejected, match="exactly"):
            repaired(other, text)
    with pytest.raises(ValueError, match="not supported"):
        repaired(own.replace("WHERE {", "WHERE { OPTIONAL"), text)


def test_deletions_touch_only_what_their_templates_name(small, spark):
    """The rest of the graph meets no join: the anti join is over statements with the template's predicate."""
    t = spark.createDataFrame(small.collect(), small.schema)
    plan = algebra.updated(t, read_update("DELETE { ?x e:p ?y } WHERE { ?x e:p ?y ; e:n ?n }", NAMES))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") == 1
    plan = algebra.updated(t, read_update("DELETE { ?x e:p ?y } WHERE { ?x e:p ?y }", NAMES))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan
