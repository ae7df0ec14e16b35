"""The guard by difference against validating everything again, on random changes of random modules."""

import random

from graphwarden.functions.terms import CRM, RDFS, SKOS, TYPE
from graphwarden.operators.findings import VIOLATION, regressions, signed
from graphwarden.plans.profiles import Context, registry
from graphwarden.plans.validation import affected, findings, new_violations
from graphwarden.sources.turtle import RAW, with_spelling

E, D = "urn:graphwarden:data:", "urn:graphwarden:domain:"


def statement(rng):
    """(s, s_kind, p, o, o_kind, o_dt, o_lang), most of it about few nodes."""
    node, cls = lambda: E + rng.choice("abcde"), lambda: D + rng.choice(["Birth", "Early", "Late", "UnitJoining", "Thing"])
    kind = rng.choice([0, 1, 2, 3, 3, 3, 4, 4, 5, 6, 7])
    if kind < 2:
        return node(), "iri", TYPE, cls(), "iri", "", ""
    if kind == 2:
        return cls(), "iri", RDFS + "subClassOf", cls(), "iri", "", ""
    if kind == 3:
        return E + rng.choice("ab"), "iri", SKOS + rng.choice(["prefLabel", "altLabel", "preflabel"]), rng.choice("xyz"), "literal", "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString", rng.choice(["en", "de"])
    if kind == 4:
        low, high = sorted(rng.sample("abcde", 2))  # no cycles, whose rule gives no violation
        return E + low, "iri", SKOS + rng.choice(["broader", "broader", "related"]), E + high, "iri", "", ""
    if kind == 5:
        return node(), "iri", CRM + rng.choice(["P98_brought_into_life", "P143_joined", "P144_joined_with"]), node(), "iri", "", ""
    if kind == 6:
        return "m#" + rng.choice("uvw"), "bnode", SKOS + rng.choice(["preflabel", "prefLabel"]), rng.choice("xy"), "literal", "http://www.w3.org/2001/XMLSchema#string", ""
    return node(), "iri", CRM + "P98_brought_into_life", "m#" + rng.choice("uvw"), "bnode", "", ""


def test_guard_by_difference_equals_validating_again(spark):
    rng, states = random.Random(11), ([], [])
    for m in range(60):
        was = {statement(rng) for _ in range(rng.randint(6, 16))}
        now = set(was)
        if m % 8:  # some modules stay as they are
            for t in rng.sample(sorted(was), rng.randint(0, 2)):
                now.discard(t)
            now |= {statement(rng) for _ in range(rng.randint(1, 8))}
        for rows, found in zip(states, (was, now), strict=True):
            rows += [(f"m{m}", *t, None) for t in sorted(found)]
    before, after = (with_spelling(spark.createDataFrame(rows, RAW)).persist() for rows in states)
    known = [(SKOS + x, False, True) for x in ("prefLabel", "altLabel", "broader", "related")] + [(TYPE, False, True), (RDFS + "subClassOf", False, True)]
    context = Context(spark.createDataFrame(known, "term string, is_class boolean, is_predicate boolean").persist())

    def told(found):
        return sorted((r.source_module, r.rule, r.constraint_component, r.focus, r.path, r.value) for r in found.collect())

    checks = [r for r in registry("full", False) if r.severity == VIOLATION]  # others are no violations, and go
    want = told(regressions(*(signed(findings(t, context, checks)) for t in (after, before))))
    got = told(new_violations(before, after, context, "full"))
    assert got == want
    assert len({r for _, r, *_ in want}) >= 5 and len(want) > 20


def test_rows_read_follow_the_change(spark):
    rows = [("m", f"{E}{i}", "iri", SKOS + "prefLabel", str(i), "literal", "http://www.w3.org/2001/XMLSchema#string", "", None) for i in range(5000)]
    other = [("n", *r[1:]) for r in rows]
    before = with_spelling(spark.createDataFrame(rows + other, RAW))
    after = with_spelling(spark.createDataFrame([("m", f"{E}7", "iri", SKOS + "altLabel", "7", *rows[0][5:])] + rows + other, RAW))
    assert [t.count() for t in affected(before, after, "full")] == [1, 2]
