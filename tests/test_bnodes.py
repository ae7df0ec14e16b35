"""Names of blank nodes: equal where the graphs are, whatever their labels and whatever other scopes hold."""

import random
import time

from graphwarden.operators.bnodes import colours

SCHEMA = "scope string, s string, s_blank boolean, p string, o string, o_blank boolean"


def chain(scope, n, last, labels):
    rows = [(scope, labels[i], True, "next", labels[i + 1], True) for i in range(n - 1)]
    return rows + [(scope, x, True, "is", "same", False) for x in labels[:n]] + [(scope, labels[n - 1], True, "end", last, False)]


def labelled(n, seed):
    return [f"_:{x}" for x in random.Random(seed).sample(range(10 * n), n)]


def names(spark, rows):
    found = {}
    for r in colours(spark.createDataFrame(rows, SCHEMA)).collect():
        found.setdefault(r.scope, {})[r.node] = r.colour
    return found


def test_chains_that_differ_at_their_ends(spark):
    n, labels = 60, {s: labelled(60, s) for s in "abc"}
    rows = chain("a", n, "x", labels["a"]) + chain("b", n, "x", labels["b"]) + chain("c", n, "y", labels["c"])
    began = time.monotonic()
    found = names(spark, rows)
    assert time.monotonic() - began < 120  # a logarithm of rounds, not sixty
    a, b, c = ([found[s][x] for x in labels[s]] for s in "abc")
    assert a == b and len(set(a)) == n and not set(a) & set(c)
    # a scope's names do not depend on what other scopes hold
    assert names(spark, chain("a", n, "x", labels["a"]) + [("z", "_:q", True, "is", "same", False)])["a"] == found["a"]


def test_refinement_against_a_plain_version(spark):
    """Nodes share a name just where plain refinement, with neither pointers nor hashes, never tells them apart."""
    rng = random.Random(5)
    rows = []
    for g in range(12):
        n = rng.randint(1, 9)
        for _ in range(rng.randint(1, 14)):
            s, o = rng.randrange(n), rng.randrange(n)
            blank = rng.random() < 0.8
            rows.append((f"g{g}", f"_:{s}", True, rng.choice("pq"), f"_:{o}" if blank else "v", blank))
    rows = sorted(set(rows))
    found = names(spark, rows)
    for g in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == g]
        nodes = {r[0] for r in own} | {r[3] for r in own if r[4]}
        kind = dict.fromkeys(nodes, 0)
        for _ in nodes:
            told = {v: (kind[v], tuple(sorted([("of", p, kind[o] if b else o) for s, _, p, o, b in own if s == v] + [("in", p, kind[s]) for s, _, p, o, b in own if b and o == v], key=str))) for v in nodes}
            numbers = {x: i for i, x in enumerate(sorted(set(told.values()), key=str))}
            kind = {v: numbers[told[v]] for v in nodes}
        assert set(found[g]) == nodes
        assert {(a, b) for a in nodes for b in nodes if kind[a] == kind[b]} == {(a, b) for a in nodes for b in nodes if found[g][a] == found[g][b]}
