"""The rule registry and the profiles: core is part of skos, skos of full."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from graphwarden.functions.terms import CRM, DCT, SH, SKOS
from graphwarden.operators import rules
from graphwarden.operators.findings import VIOLATION, WARNING

PROFILES = ("core", "skos", "full")


@dataclass(frozen=True)
class Context:
    """What rules need beside the triples: the manifest and the namespaces of one's own data."""

    manifest: DataFrame
    domain: str = "urn:graphwarden:domain:"
    actors: str = "urn:graphwarden:actors:"
    conflicts: str = "urn:graphwarden:conflicts:"
    internal: tuple[str, ...] = ("urn:graphwarden:data:",)
    rules_namespace: str = "urn:graphwarden:rule:"
    #: rules.subclasses() of the triples at hand, made once a run; without it each rule makes its own.
    below: DataFrame | None = None


@dataclass(frozen=True)
class Rule:
    name: str
    profile: str
    severity: str
    message: str
    source: str
    layer: str
    build: Callable[[DataFrame, Context], DataFrame]
    component: str = "SPARQLConstraintComponent"
    local: bool = True
    union: bool = False
    #: Predicates whose subjects the rule looks at; none: the scope as a whole.
    subjects: tuple[str, ...] = ()
    #: The IRI of a rule that was read from data.
    shape: str = ""

    def iri(self, context: Context) -> str:
        return f"<{self.shape or context.rules_namespace + self.name}>"


def _exactly_one(name: str, cls: str, path: str) -> list[Rule]:
    """The cardinality and node-kind components of one property; findings of all bear the property's name."""
    checks = (("MinCountConstraintComponent", rules.min_count), ("MaxCountConstraintComponent", rules.max_count), ("NodeKindConstraintComponent", rules.node_kind_iri))
    message = f"{cls}: state {path} once, with an IRI as its value."

    def build(check):
        return lambda t, c: check(t, rules.target_class(t, c.domain + cls, c.below), CRM + path)

    return [Rule(name, "full", VIOLATION, message, f"requirement:{name}", "domain", build(check), component) for component, check in checks]


_SKOS_REFERENCE = "https://www.w3.org/TR/skos-reference/"
_BROADER, _RELATED, _LABELS = SKOS + "broader", SKOS + "related", (SKOS + "prefLabel", SKOS + "altLabel", SKOS + "hiddenLabel")
_BIRTH, _DEATH = ("Birth", "P98_brought_into_life", "P82b_end_of_the_end"), ("Death", "P100_was_death_of", "P82a_begin_of_the_begin")


def _event(c: Context, event: tuple[str, str, str]) -> tuple[str, str, str]:
    return c.domain + event[0], CRM + event[1], CRM + event[2]


_RULES = (
    Rule("IllTypedLiteral", "core", VIOLATION, "The text of this literal is outside its XSD datatype: mend the text, or name another datatype.", "https://www.w3.org/TR/xmlschema11-2/", "core", lambda t, c: rules.ill_typed_literals(t)),
    Rule("KnownVocabularyTerm", "core", VIOLATION, "The vocabularies declare no such class or predicate: check its spelling and its place in the statement.", "https://www.w3.org/TR/rdf-schema/", "core", lambda t, c: rules.known_terms(t, c.manifest)),
    Rule("PreferredLabelLanguage", "skos", VIOLATION, "skos:prefLabel: keep one text a language, and make others skos:altLabel.", _SKOS_REFERENCE, "vocabulary", lambda t, c: rules.preferred_label_language(t), union=True, subjects=_LABELS[:1]),
    Rule("LabelDisjointness", "skos", VIOLATION, "Two label predicates have this text: leave it under one.", _SKOS_REFERENCE, "vocabulary", lambda t, c: rules.label_disjointness(t), union=True, subjects=_LABELS),
    Rule("BroaderSelf", "skos", WARNING, "skos:broader leads from here to here: drop the statement.", _SKOS_REFERENCE, "vocabulary", lambda t, c: rules.self_link(t, _BROADER), union=True, subjects=(_BROADER,)),
    Rule("BroaderCycle", "skos", WARNING, "Steps of skos:broader come back here: one of them points the wrong way.", _SKOS_REFERENCE, "vocabulary", lambda t, c: rules.link_cycle(t), union=True, subjects=(_BROADER,)),
    Rule("RelatedSelf", "skos", WARNING, "skos:related leads from here to here: drop the statement.", _SKOS_REFERENCE, "vocabulary", lambda t, c: rules.self_link(t, _RELATED), union=True, subjects=(_RELATED,)),
    Rule("BroaderRelatedDisjoint", "skos", VIOLATION, "skos:related and steps of skos:broader join the same two: only one of these holds.", _SKOS_REFERENCE, "vocabulary", lambda t, c: rules.closure_disjoint(t), union=True, subjects=(_BROADER, _RELATED)),
    *_exactly_one("BirthPerson", *_BIRTH[:2]),
    *_exactly_one("DeathPerson", *_DEATH[:2]),
    Rule("UnitJoining", "full", VIOLATION, "P143_joined and P144_joined_with have one value: one of the two is wrong.", "requirement:UnitJoining", "domain", lambda t, c: rules.same_value(t, rules.target_class(t, c.domain + "UnitJoining", c.below), CRM + "P143_joined", CRM + "P144_joined_with")),
    *_exactly_one("UnitJoiningChild", "UnitJoining", "P143_joined"),
    *_exactly_one("UnitJoiningParent", "UnitJoining", "P144_joined_with"),
    *_exactly_one("MedalAwardingMedal", "MedalAwarding", "P141_assigned"),
    *_exactly_one("MedalAwardingRecipient", "MedalAwarding", "P11_had_participant"),
    Rule("ConflictClassNamespace", "full", WARNING, "rdfs:range names a Conflict in another namespace than its declaration: use the declared IRI.", "requirement:ConflictClass", "domain", lambda t, c: rules.node_target_pair(t, c.domain + "actors/hasConflict", c.conflicts + "Conflict", c.domain + "Conflict")),
    Rule("DuplicateIdentifier", "core", WARNING, "dct:identifier: several subjects have this value, so it tells none of them apart.", "https://www.dublincore.org/specifications/dublin-core/dcmi-terms/", "integration", lambda t, c: rules.duplicate_identifier(t, DCT + "identifier"), local=False, union=True),
    Rule("BirthDeathChronology", "full", VIOLATION, "By its time-spans this life begins after its end: check both dates, and whether the events are of one person.", "requirement:Chronology", "domain", lambda t, c: rules.chronology(t, _event(c, _BIRTH), _event(c, _DEATH)), local=False, union=True),
    Rule("InternalReference", "full", WARNING, "No module says anything about this IRI of the data's own namespaces: add its description, or mend the reference.", "requirement:InternalReference", "integration", lambda t, c: rules.dangling_reference(t, list(c.internal)), local=False, union=True),
    Rule("EventParticipantType", "full", WARNING, "P11_had_participant has an actor of unknown kind: give it the class of persons or of units.", "requirement:EventParticipant", "integration", lambda t, c: rules.typed_participant(t, CRM + "P11_had_participant", c.actors, [c.domain + "Person", c.domain + "MilitaryUnit"]), local=False, union=True),
)


def registry(profile: str, union: bool) -> list[Rule]:
    """Rules of a profile for single modules, or for their union."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile: {profile}")
    upto = PROFILES.index(profile)
    return [r for r in _RULES if PROFILES.index(r.profile) <= upto and (r.union if union else r.local)]


def rule_count(profile: str, cross: bool) -> int:
    return len({r.name for r in registry(profile, False)} | ({r.name for r in registry(profile, True)} if cross else set()))


def broadest(profiles) -> str:
    return max(profiles, key=PROFILES.index)


def component(rule: Rule) -> str:
    return f"<{SH}{rule.component}>"
