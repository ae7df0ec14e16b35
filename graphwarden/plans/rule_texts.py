"""The rules of operators/rules.py that are queries, written as SPARQL text.

Each function gives the text for the IRIs at hand; plans/algebra.py runs it. A rule of one's own is such a text
in a shape file (plans/shapes.py). Messages are fixed values, as they are in operators/rules.py.
"""

from __future__ import annotations

from graphwarden.functions.terms import DCT, LEXICAL, OWL, RDF, RDFS, SKOS, STANDARD_NAMESPACES, XSD
from graphwarden.sources.tables import IS_CLASS, IS_PREDICATE

PROLOGUE = f"""PREFIX rdf: <{RDF}>
PREFIX rdfs: <{RDFS}>
PREFIX owl: <{OWL}>
PREFIX skos: <{SKOS}>
PREFIX dct: <{DCT}>
PREFIX xsd: <{XSD}>
"""


def _quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def ill_typed_literals() -> str:
    outside = " || ".join(f"(?type = xsd:{name} && !REGEX(STR(?value), {_quoted(f'^(?:{form})$')}))" for name, form in LEXICAL.items())
    return f"""{PROLOGUE}SELECT DISTINCT $this ?path ?value ?message {{
  ?owner ?path ?value .
  FILTER(isLiteral(?value))
  BIND(DATATYPE(?value) AS ?type)
  FILTER(?type IN ({", ".join(f"xsd:{name}" for name in LEXICAL)}))
  FILTER({outside})
  BIND(CONCAT("Ill-typed ", STR(?type), " literal on ", STR(?owner)) AS ?message)
}}"""


def known_terms(is_class: str = IS_CLASS, is_predicate: str = IS_PREDICATE) -> str:
    """The manifest is a part of the graph: statements that a term has a role, with the object "true"."""
    spaces = " || ".join(f"STRSTARTS(STR(?path), {_quoted(n)})" for n in STANDARD_NAMESPACES)
    declared = spaces.replace("?path", "?value")
    members = _quoted("^" + RDF.replace(".", "[.]") + "_[1-9][0-9]*$")
    return f"""{PROLOGUE}SELECT DISTINCT $this ?path ?value ?message ?object {{
  {{
    ?value ?path ?object .
    FILTER(({spaces}) && !REGEX(STR(?path), {members}))
    FILTER NOT EXISTS {{ ?path <{is_predicate}> "true" }}
    BIND(?path AS ?term)
    BIND(?value AS ?user)
  }} UNION {{
    ?value a ?path .
    FILTER(isIRI(?path) && ({spaces}))
    FILTER NOT EXISTS {{ ?path <{is_class}> "true" }}
    BIND(?path AS ?term)
    BIND(?value AS ?user)
  }} UNION {{
    ?value a ?kind .
    VALUES ?kind {{ rdf:Property owl:ObjectProperty owl:DatatypeProperty owl:AnnotationProperty }}
    FILTER(isIRI(?value) && ({declared}) && !REGEX(STR(?value), {members}))
    FILTER NOT EXISTS {{ ?value <{is_predicate}> "true" }}
    BIND(rdf:type AS ?path)
    BIND(?value AS ?term)
  }} UNION {{
    ?value a ?kind .
    VALUES ?kind {{ rdfs:Class rdfs:Datatype owl:Class }}
    FILTER(isIRI(?value) && ({declared}))
    FILTER NOT EXISTS {{ ?value <{is_class}> "true" }}
    BIND(rdf:type AS ?path)
    BIND(?value AS ?term)
  }}
  BIND(CONCAT("Unknown standard vocabulary term ", STR(?term), " used by ", STR(COALESCE(?user, ?term))) AS ?message)
}}"""


def preferred_label_language(predicate: str = SKOS + "prefLabel") -> str:
    return f"""SELECT DISTINCT $this (<{predicate}> AS ?path) ?value ?message {{
  $this <{predicate}> ?value .
  {{ SELECT $this ?language (MIN(?text) AS ?least) {{
      $this <{predicate}> ?label .
      FILTER(isLiteral(?label))
      BIND(LANG(?label) AS ?language)
      BIND(STR(?label) AS ?text)
      FILTER(BOUND(?language) && BOUND(?text))
    }} GROUP BY $this ?language }}
  FILTER(LANG(?value) = ?language && STR(?value) > ?least)
  BIND(CONCAT("Duplicate preferred-label language '", ?language, "'") AS ?message)
}}"""


def label_disjointness(predicates=(SKOS + "prefLabel", SKOS + "altLabel", SKOS + "hiddenLabel")) -> str:
    names = sorted(predicates)
    pairs = " ".join(f"(<{a}> <{b}>)" for i, a in enumerate(names) for b in names[i + 1 :])
    return f"""SELECT DISTINCT $this ?path ?value ?message {{
  VALUES (?lesser ?path) {{ {pairs} }}
  $this ?lesser ?value .
  $this ?path ?value .
  BIND(CONCAT("Label is used by both ", STR(?lesser), " and ", STR(?path)) AS ?message)
}}"""


def self_link(predicate: str) -> str:
    return f"SELECT $this (<{predicate}> AS ?path) ($this AS ?value) {{ $this <{predicate}> $this }}"


def link_cycle(predicate: str = SKOS + "broader") -> str:
    return f"SELECT $this (<{predicate}> AS ?path) ($this AS ?value) {{ $this <{predicate}>+ $this }}"


def closure_disjoint(hierarchy: str = SKOS + "broader", relation: str = SKOS + "related") -> str:
    return f"""SELECT DISTINCT $this (<{relation}> AS ?path) ?value {{
  $this <{relation}> ?value .
  FILTER(!isLiteral(?value))
  {{ $this <{hierarchy}>+ ?value }} UNION {{ ?value <{hierarchy}>+ $this }}
}}"""


def same_value(first: str, second: str) -> str:
    return f"SELECT $this (<{second}> AS ?path) ?value {{ $this <{first}> ?value ; <{second}> ?value }}"


def node_target_pair(range_: str, declared: str) -> str:
    return f"{PROLOGUE}SELECT $this (rdfs:range AS ?path) (<{range_}> AS ?value) {{ $this rdfs:range <{range_}> . <{declared}> a rdfs:Class }}"


def duplicate_identifier(predicate: str = DCT + "identifier") -> str:
    return f"""SELECT $this (<{predicate}> AS ?path) ?value ?message {{
  {{ SELECT ?value (COUNT(DISTINCT ?owner) AS ?n) {{ ?owner <{predicate}> ?value }} GROUP BY ?value HAVING (COUNT(DISTINCT ?owner) > 1) }}
  BIND(CONCAT("Identifier is shared by ", STR(?n), " resources") AS ?message)
}}"""


def chronology(birth: tuple[str, str, str], death: tuple[str, str, str], span: str) -> str:
    """birth and death: (event class, event to person, span to bound)."""

    def bound(event: tuple[str, str, str], aggregate: str, as_: str) -> str:
        cls, person, at = event
        return f"{{ SELECT ?value ({aggregate}(?day) AS ?{as_}) {{ ?event a <{cls}> ; <{person}> ?value ; <{span}> ?time . ?time <{at}> ?day }} GROUP BY ?value }}"

    return f"""SELECT $this (<{span}> AS ?path) ?value ?message {{
  {bound(birth, "MAX", "born")}
  {bound(death, "MIN", "died")}
  FILTER(?born > ?died)
  BIND(CONCAT("Person ", STR(?value), " has birth end ", STR(?born), " after death begin ", STR(?died)) AS ?message)
}}"""


def dangling_reference(namespaces) -> str:
    inside = " || ".join(f"STRSTARTS(STR(?value), {_quoted(n)})" for n in namespaces)
    return f"""SELECT $this ?path ?value ?message {{
  {{ SELECT DISTINCT ?path ?value {{ ?from ?path ?value . FILTER(isIRI(?value) && ({inside})) }} }}
  FILTER NOT EXISTS {{ ?value ?says ?what }}
  BIND(CONCAT("Unresolved internal IRI ", STR(?value)) AS ?message)
}}"""


def typed_participant(predicate: str, namespace: str, classes) -> str:
    return f"""SELECT $this (<{predicate}> AS ?path) ?value ?message {{
  {{ SELECT DISTINCT ?value {{ ?event <{predicate}> ?value . FILTER(isIRI(?value) && STRSTARTS(STR(?value), {_quoted(namespace)})) }} }}
  FILTER NOT EXISTS {{ ?value a ?class . VALUES ?class {{ {" ".join(f"<{c}>" for c in classes)} }} }}
  BIND(CONCAT("Untyped participant ", STR(?value)) AS ?message)
}}"""
