"""Files of triples through validation and repair, by small modules written for each case."""

import pytest
from pyspark.sql import functions as F

from graphwarden import cli, sinks
from graphwarden.functions.terms import strict_fault
from graphwarden.operators import repair as rp
from graphwarden.operators.bnodes import colours
from graphwarden.operators.closure import checkpointed, closure, cyclic_nodes, reached_pairs
from graphwarden.plans.profiles import Context, broadest, registry, rule_count
from graphwarden.plans.shapes import read_shapes
from graphwarden.plans.validation import check_file, local_findings, validate
from graphwarden.sources import files, tables, turtle

HEAD = """@prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
@prefix owl: <http://www.w3.org/2002/07/owl#> .
@prefix skos: <http://www.w3.org/2004/02/skos/core#> .
@prefix dct: <http://purl.org/dc/terms/> .
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
@prefix crm: <http://www.cidoc-crm.org/cidoc-crm/> .
@prefix d: <urn:graphwarden:domain:> .
@prefix e: <urn:graphwarden:data:> .
"""
VOCABULARY = HEAD + "\n".join(f"{t} a rdf:Property ." for t in "rdf:type rdf:first rdf:rest rdfs:range rdfs:subClassOf rdfs:label owl:sameAs dct:identifier dct:date dct:bibliographicCitation skos:prefLabel skos:altLabel skos:hiddenLabel skos:broader skos:related".split()) + "\n" + "\n".join(f"{t} a rdfs:Class ." for t in "rdf:Property rdfs:Class owl:Class skos:Concept rdf:List".split())


class Data:
    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder
        (folder / "vocabulary.ttl").write_text(VOCABULARY)

    def read(self, **modules):
        named = []
        for name, text in modules.items():
            path = self.folder / f"{name}.ttl"
            path.write_text(HEAD + text, encoding="utf-8")
            named.append((str(path), f"{name}.ttl"))
        return turtle.read(self.spark, named)

    def context(self):
        triples, _ = turtle.read(self.spark, [(str(self.folder / "vocabulary.ttl"), "v")])
        return Context(tables.manifest(triples, ["http://www.w3.org/", "http://purl.org/dc/terms/"]).persist())

    def run(self, profile="full", cross=False, accepted=None, **modules):
        triples, faults = self.read(**modules)
        return validate(triples, faults.persist(), self.context(), profile, cross, accepted=accepted)

    def rules(self, *args, **kw):
        return sorted(r.rule.rsplit(":", 1)[-1].rstrip(">") + ":" + r.source_module for r in self.run(*args, **kw).findings.collect())


@pytest.fixture
def data(spark, tmp_path):
    return Data(spark, tmp_path)


def test_valid_module_has_no_findings(data):
    run = data.run("core", a='e:c a skos:Concept ; skos:prefLabel "x"@en ; dct:date "1940-01-31"^^xsd:date ; rdf:_1 e:m .')
    assert run.findings.isEmpty() and not run.failed and run.modules == 1 and run.triples == 4


def test_one_file_through_a_profile(data):
    for text, conforms in (("e:c a skos:Concept .", True), ("e:c a skos:Concepts .", False), ("e:c dct:date '1940-02-30'^^xsd:date .", False)):
        data.read(f=text)
        ok, found = check_file(data.spark, str(data.folder / "f.ttl"), data.context(), "core")
        assert ok == conforms and len(found) == int("Concepts" in text)


def test_unknown_terms_and_roles(data):
    assert data.rules("core", a="e:c skos:preflabel 'x' .") == ["KnownVocabularyTerm:a.ttl"]
    assert len(data.rules("core", b="e:c skos:Concept e:d ; a skos:prefLabel .")) == 2
    assert len(data.rules("core", c="skos:madeUp a rdf:Property .")) == 1


def test_equal_findings_keep_their_number(data):
    run = data.run("core", a="e:c skos:preflabel 'x', 'y' .")
    assert len({r.signature for r in run.findings.collect()}) == 2
    run = data.run("core", b="[] skos:preflabel 'x' . [] skos:preflabel 'x' .")
    rows = run.findings.collect()
    assert len(rows) == 2 and len({r.signature for r in rows}) == 2 and len({r.value for r in rows}) == 1
    assert rows[0].value.startswith("_:c")


def test_a_bad_literal_fails_its_module_alone(data):
    run = data.run("core", True, bad="e:x dct:date '1940-13-42'^^xsd:date .", good="e:c skos:preflabel 'x' .")
    assert run.failed and run.modules == 1 and run.findings.count() == 1
    assert data.run("core", bad="e:x dct:date '1940-02-30'^^xsd:date .").failed


def test_labels_and_hierarchy(data):
    text = """e:a skos:prefLabel "x"@en, "y"@en ; skos:altLabel "x"@en . e:b skos:broader e:b . e:c skos:broader e:d . e:d skos:broader e:c .
    e:r skos:related e:r . e:k skos:broader e:l . e:l skos:broader e:m . e:k skos:related e:m ."""
    found = data.rules("skos", a=text)
    assert [x.split(":")[0] for x in found] == ["BroaderCycle"] * 3 + ["BroaderRelatedDisjoint", "BroaderSelf", "LabelDisjointness", "PreferredLabelLanguage", "RelatedSelf"]


def test_cardinalities(data):
    text = f"""e:b a d:Birth ; crm:P98_brought_into_life e:p, e:q . e:x a d:Death . e:j a d:UnitJoining ; crm:P143_joined e:u ; crm:P144_joined_with e:u .
    e:w a d:MedalAwarding ; crm:P11_had_participant e:p, e:q . d:Sub <{'http://www.w3.org/2000/01/rdf-schema#'}subClassOf> d:Birth . e:s a d:Sub ; crm:P98_brought_into_life "no" ."""
    found = [x.split(":")[0] for x in data.rules("full", a=text)]
    assert found == ["BirthPerson", "BirthPerson", "DeathPerson", "MedalAwardingMedal", "MedalAwardingRecipient", "UnitJoining"]


def test_union_rules(data):
    a, b = "e:x skos:broader e:y ; dct:identifier '1' .", "e:y skos:broader e:x ; dct:identifier '1' ."
    found = data.rules("skos", True, a=a, b=b)
    assert found == ["BroaderCycle:@union"] * 2 + ["DuplicateIdentifier:@union"]
    life = """e:b{n} a d:Birth ; crm:P98_brought_into_life e:p ; crm:P4_has_time-span e:s{n} . e:s{n} crm:P82b_end_of_the_end "19{n}0-01-01"^^xsd:date .
    e:d{n} a d:Death ; crm:P100_was_death_of e:p ; crm:P4_has_time-span e:t{n} . e:t{n} crm:P82a_begin_of_the_begin "19{m}0-01-01"^^xsd:date . e:p a d:Person ."""
    found = data.rules("full", True, a=life.format(n=4, m=1), b=life.format(n=5, m=2))
    assert [x for x in found if "Chronology" in x] == ["BirthDeathChronology:@union"]
    found = data.rules("full", True, a="e:v crm:P11_had_participant <urn:graphwarden:actors:1> ; crm:x e:gone .")
    assert found == ["EventParticipantType:@union", "InternalReference:@union"]


def test_baseline_round_trip(data, tmp_path, spark):
    run = data.run("core", a="e:c skos:preflabel 'x\\ty' .")
    sinks.write_baseline(run.findings, str(tmp_path / "b.tsv"))
    accepted = tables.read_baseline(spark, str(tmp_path / "b.tsv"))
    assert data.run("core", a="e:c skos:preflabel 'x\\ty' .", accepted=accepted).regressions.isEmpty()
    (tmp_path / "bad.tsv").write_text("abc\t<urn:severe>\n")
    with pytest.raises(Exception, match="unknown severity"):
        tables.read_baseline(spark, str(tmp_path / "bad.tsv")).collect()


def test_shapes_as_data(data):
    head = "@prefix sh: <http://www.w3.org/ns/shacl#> .\n"
    shapes, _ = data.read(s=head + """e:S a sh:NodeShape ; sh:targetClass d:Birth ; sh:targetNode e:lone ; sh:property [ sh:path dct:date ; sh:minCount 1 ; sh:maxCount 2 ; sh:message "dates" ; sh:severity sh:Warning ] ,
      [ sh:path dct:creator ; sh:nodeKind sh:IRI ] .""")
    own = read_shapes(shapes)
    assert [(r.component[:8], r.severity.rsplit("#")[-1]) for r in own] == [("NodeKind", "Violation>"), ("MaxCount", "Warning>"), ("MinCount", "Warning>")]
    triples, faults = data.read(a="d:Early rdfs:subClassOf d:Birth . e:b a d:Early ; dct:date '1', '2', '3' ; dct:creator 'x' . e:c a d:Birth ; dct:date '1' ; dct:creator e:y .")
    run = validate(triples, faults, data.context(), "skos", own=tuple(own))
    found = sorted((r.rule, r.constraint_component.rsplit("#")[-1][:8], r.focus.rsplit(":")[-1], r.message) for r in run.findings.where("rule LIKE '%data:S>'").collect())
    assert found == [("<urn:graphwarden:data:S>", "MaxCount", "b>", "dates"), ("<urn:graphwarden:data:S>", "MinCount", "lone>", "dates"), ("<urn:graphwarden:data:S>", "NodeKind", "b>", own[0].message)]
    assert run.rules == rule_count("skos", False) + 1
    for bad in ("sh:property [ sh:path dct:date ; sh:pattern 'x' ]", "sh:property [ sh:minCount 1 ]", "sh:property [ sh:path dct:date ; sh:nodeKind sh:Literal ]", "sh:closed true"):
        with pytest.raises(ValueError):
            read_shapes(data.read(s=head + f"e:S a sh:NodeShape ; sh:targetClass d:Birth ; {bad} .")[0])


def test_support_is_in_every_scope(data):
    triples, _ = data.read(a="e:x skos:broader e:y .", b="e:z skos:broader e:w .")
    support, _ = data.read(s="e:y skos:broader e:x . e:w skos:broader e:z .")
    run = validate(triples, triples.select("module", "module").limit(0).toDF("module", "fault"), data.context(), "skos", support=support)
    assert sorted((r.source_module, r.rule.rsplit(":", 1)[-1]) for r in run.findings.collect()) == [(m, "BroaderCycle>") for m in ("a.ttl", "a.ttl", "b.ttl", "b.ttl")]


def test_report_is_deterministic_and_parses(data, tmp_path):
    for name in ("r1.nt", "r2.nt"):
        sinks.write_report(data.run("core", a="e:c skos:preflabel 'x\"\\n' .").findings, str(tmp_path / name))
    assert (tmp_path / "r1.nt").read_bytes() == (tmp_path / "r2.nt").read_bytes()
    found = turtle.parse((tmp_path / "r1.nt").read_text(), "urn:b", "m")
    assert any(t[2].endswith("conforms") and t[3] == "false" for t in found)


def test_files(tmp_path):
    (tmp_path / "a.ttl").write_text("")
    (tmp_path / "n.txt").write_text("")
    assert files.discover([str(tmp_path)]) == [str(tmp_path / "a.ttl")]
    assert files.module_name(str(tmp_path / "a.ttl"), str(tmp_path)) == "a.ttl"
    (tmp_path / "g.trig").write_text("")
    with pytest.raises(ValueError):
        files.discover([str(tmp_path)])
    with pytest.raises(FileNotFoundError):
        files.discover([str(tmp_path / "no")])


def test_turtle_syntax():
    text = """@base <http://b/> . PREFIX p: <http://p/>
    <x> a p:C ; p:s 'a', "b"@EN-us, '''l"ong\n''' , 1, -2.5, 3e4, true ; p:n [ p:q _:b1 ; ] . p:l p:m ( 1 p:z\\,k ) . # end
    [ p:q p:r ] ."""
    found = turtle.parse(text, "urn:x", "m")
    objects = {(t[3], t[5].rsplit("#", 1)[-1], t[6]) for t in found if t[2] == "http://p/s"}
    assert objects == {("a", "string", ""), ("b", "langString", "en-us"), ('l"ong\n', "string", ""), ("1", "integer", ""), ("-2.5", "decimal", ""), ("3e4", "double", ""), ("true", "boolean", "")}
    assert found[0][0] == "http://b/x" and len([t for t in found if t[2].endswith("#rest")]) == 2
    assert ("http://p/z,k", "iri") in {(t[3], t[4]) for t in found}
    for bad in ("<a> <b> .", "q:x <b> <c> .", "<a> <b> 'x", "<a> <b> <c>"):
        with pytest.raises(turtle.TurtleError):
            turtle.parse(bad, "urn:x", "m")


def test_ntriples_agree_with_turtle(spark, tmp_path):
    lines = '<urn:a> <urn:p> "x\\"\\n\\\\n\\t\\b\\f\\u00e9\\U0001F600\\\\u0041"@en .\n# note\n_:b <urn:p> <urn:c\\u00e9> . # more\r\n\n<urn:a> <urn:p> "1"^^<http://www.w3.org/2001/XMLSchema#integer> .\n<urn:a> <urn:q> _:b .\n<urn:a><urn:q>"" .\n'
    (tmp_path / "t.nt").write_text(lines)
    (tmp_path / "t.ttl").write_text(lines)
    a, faults = turtle.read(spark, [(str(tmp_path / "t.nt"), "m")])
    b = turtle.read(spark, [(str(tmp_path / "t.ttl"), "m")])[0]
    assert sorted(a.collect()) == sorted(b.collect()) and a.count() == 5 and faults.isEmpty()
    assert 'x"\n\\n\t\b\f\u00e9\U0001F600\\u0041' in {r.o for r in a.collect()}
    for i, bad in enumerate(("@prefix p: <urn:p:> . p:a p:b 'x' , 'y' .", "<urn:a> <urn:b> 1 .", "<urn:a> <b> <urn:c> .", "<urn:a> <urn:b> <urn:c>", '<urn:a> <urn:b> "x\\q" .', "<urn:a> <urn:b> 'x' .")):
        (tmp_path / f"bad{i}.nt").write_text("<urn:a> <urn:b> <urn:c> .\n" + bad + "\n")
    t, faults = turtle.read(spark, [(str(tmp_path / f"bad{i}.nt"), f"m{i}") for i in range(6)] + [(str(tmp_path / "t.nt"), "m")])
    assert sorted(r.module for r in faults.collect()) == [f"m{i}" for i in range(6)] and t.count() == 5


def test_strict_datatypes(spark):
    good = {"int": "-0012", "long": "9223372036854775807", "unsignedByte": "255", "byte": "-128", "nonNegativeInteger": "-0", "positiveInteger": "+" + "9" * 60, "negativeInteger": "-1", "gYear": "-0044", "gYearMonth": "1940-12Z", "gMonthDay": "--02-29", "gDay": "---31", "gMonth": "--12", "time": "24:00:00", "duration": "P1Y2M3DT4H5M6.7S", "dayTimeDuration": "-PT1S", "yearMonthDuration": "P1Y", "hexBinary": "0aFF", "base64Binary": "YWI=", "language": "en-GB", "token": "a b", "NCName": "a-b", "float": "-INF", "dateTimeStamp": "1940-01-01T00:00:00Z", "anyURI": "x y"}
    bad = {"int": "abc", "long": "9223372036854775808", "unsignedByte": "-1", "byte": "128", "nonNegativeInteger": "-" + "9" * 60, "positiveInteger": "0", "negativeInteger": "0", "gYear": "x", "gYearMonth": "1940-13", "gMonthDay": "--02-30", "gDay": "---32", "gMonth": "--13", "time": "25:00:00", "duration": "P", "dayTimeDuration": "P1Y", "yearMonthDuration": "P1D", "hexBinary": "0aF", "base64Binary": "YWI", "language": "e_n", "token": " a", "NCName": "a:b", "float": "1,5", "dateTimeStamp": "1940-01-01T00:00:00", "unsignedLong": "18446744073709551616", "date": "1940-02-30"}
    xsd = "http://www.w3.org/2001/XMLSchema#"
    rows = spark.createDataFrame([(xsd + k, v, w) for w, given in ((False, good), (True, bad)) for k, v in given.items()], "dt string, o string, want boolean")
    assert [tuple(r) for r in rows.where(strict_fault(F.col("dt"), F.col("o")) != F.col("want")).collect()] == []


def test_blank_nodes_by_colours(spark):
    def named(*rows):
        frame = spark.createDataFrame([("m", s, s.startswith("_"), p, o, o.startswith("_")) for s, p, o in rows], "scope string, s string, s_blank boolean, p string, o string, o_blank boolean")
        return {r.node: r.colour for r in colours(frame).collect()}

    a = named(("_a", "p", "x"), ("_b", "p", "x"), ("_c", "p", "y"), ("_d", "q", "_c"), ("_e", "q", "_a"))
    assert a["_a"] != a["_b"] != a["_c"] and a["_d"] != a["_e"]  # _a is pointed at, _b is not
    b = named(("_1", "p", "y"), ("_2", "q", "_1"))
    assert {b["_1"], b["_2"]} <= set(named(("_9", "q", "_8"), ("_8", "p", "y")).values())
    ring = named(*[(f"_{i}", "p", f"_{(i + 1) % 8}") for i in range(8)])
    assert len(set(ring.values())) == 1
    assert len(set(named(*[(f"_{i}", "p", f"_{j}") for i in range(9) for j in range(9) if i != j]).values())) == 1  # a clique, in no time


def test_cycles_against_brute_force(spark):
    import random

    rng = random.Random(5)
    for case in range(2):
        n = (12, 24)[case]
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range((14, 27)[case])}
        if case == 1:
            edges |= {(100 + i, 101 + i) for i in range(40)} | {(140, 100)} | {(200 + i, 201 + i) for i in range(40)} | {(1, 300), (300, 301), (301, 1)}
        want = set(edges)
        while more := {(a, d) for a, b in want for c, d in edges if b == c} - want:
            want |= more
        frame = spark.createDataFrame([("m", str(a), str(b)) for a, b in edges], "scope string, a string, b string")
        assert {int(r.node) for r in cyclic_nodes(frame).collect()} == {a for a, b in want if a == b}
        pairs = spark.createDataFrame([("m", str(rng.randrange(n)), str(rng.randrange(n))) for _ in range(50)], "scope string, a string, b string")
        assert {(int(r.a), int(r.b)) for r in reached_pairs(frame, pairs).collect()} == {(int(r.a), int(r.b)) for r in pairs.collect()} & want


def test_long_chains_take_few_tables(spark, monkeypatch):
    """Rounds grow with the logarithm of a chain: 100,000 links take fewer than 40 written tables, and nothing of all pairs."""
    from graphwarden.operators import closure as paths

    written, real = [], paths.checkpointed
    monkeypatch.setattr(paths, "checkpointed", lambda df: written.append(1) or real(df))
    chain = spark.range(100_000).select(F.lit("m").alias("scope"), F.col("id").cast("string").alias("a"), (F.col("id") + 1).cast("string").alias("b"))
    pairs = spark.createDataFrame([("m", "0", "100000"), ("m", "5", "3"), ("m", "70", "90000"), ("m", "9", "9"), ("x", "1", "2")], "scope string, a string, b string")
    assert sorted((r.a, r.b) for r in reached_pairs(chain, pairs).collect()) == [("0", "100000"), ("70", "90000")]
    assert len(written) < 40
    written.clear()
    ring = chain.unionByName(spark.createDataFrame([("m", "100000", "0")], chain.schema))
    assert cyclic_nodes(ring).count() == 100_001 and len(written) < 40


def test_closure_against_brute_force(spark):
    import random

    rng = random.Random(3)
    edges = {(rng.randrange(30), rng.randrange(30)) for _ in range(35)}
    want = set(edges)
    while True:
        more = {(a, d) for a, b in want for c, d in edges if b == c} - want
        if not more:
            break
        want |= more
    got = closure(spark.createDataFrame([("m", str(a), str(b)) for a, b in edges], "scope string, a string, b string"))
    assert {(int(r.a), int(r.b)) for r in got.collect()} == want


def repaired(data, ids=None, profile="core", **modules):
    triples, _ = data.read(**modules)
    context = data.context()
    repairs = rp.selected(rp.standard_catalog("<urn:graphwarden:rule:KnownVocabularyTerm>"), ids)
    guard = broadest([profile, *(r.profile for r in repairs)])
    return rp.apply(triples.persist(), repairs, lambda t: local_findings(t, context, guard), checkpointed)


TYPOS = "e:a rdfs:subClassof e:b ; dct:bibliographiccitation 'c' ; skos:preflabel 'l'@en ; owl:same e:d . e:p a rdfs:Property ."


def test_repairs(data):
    done = repaired(data, a=TYPOS)
    assert done.changes.count() == 5 and len(done.applied) == 5
    assert local_findings(done.triples, data.context(), "core").isEmpty()
    again = rp.apply(done.triples, done.applied, lambda t: local_findings(t, data.context(), "skos"), checkpointed)
    assert again.changes.isEmpty() and not again.applied
    assert repaired(data, ["rdfs-property"], a=TYPOS).changes.count() == 1


def test_repair_guards(data):
    with pytest.raises(rp.RepairRejected, match="new violation"):
        repaired(data, a="e:a skos:preflabel 'x'@en ; skos:prefLabel 'y'@en .")
    row = repaired(data, a="e:a skos:preflabel 'x'@en ; skos:prefLabel 'x'@en .").changes.collect()
    assert len(row) == 1 and not row[0].replacement_added
    with pytest.raises(rp.RepairRejected, match="exactly"):
        repaired(data, a="e:a owl:same owl:same .")
    with pytest.raises(ValueError):
        rp.selected(rp.standard_catalog("r"), ["nothing"])


def test_cli(data, tmp_path, capsys):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.ttl").write_text(HEAD + TYPOS)
    common = ["--vocabulary", str(tmp_path / "vocabulary.ttl"), "--data", str(source), "--root", str(source)]
    assert cli.main(["validate", *common, "--profile", "core", "--report", str(tmp_path / "r.nt"), "--write-baseline", str(tmp_path / "b.tsv")]) == 1
    assert cli.main(["validate", *common, "--profile", "core", "--baseline", str(tmp_path / "b.tsv")]) == 0
    assert cli.main(["repair", *common, "--all-automatic", "--apply", "--output-dir", str(tmp_path / "out"), "--provenance", str(tmp_path / "p.nt")]) == 0
    assert cli.main(["validate", "--vocabulary", str(tmp_path / "vocabulary.ttl"), "--data", str(tmp_path / "out"), "--profile", "core"]) == 0
    assert cli.main(["repair", *common, "--all-automatic", "--apply", "--output-dir", str(tmp_path / "out")]) == 2
    assert cli.main(["validate", *common[:2], "--data", str(tmp_path / "none")]) == 2
    kept = (tmp_path / "out" / "a.ttl").read_text()
    assert "@prefix skos: <http://www.w3.org/2004/02/skos/core#> ." in kept and "e:a skos:prefLabel \"l\"@en ." in kept
    (tmp_path / "bad.tsv").write_text("abc\n")
    capsys.readouterr()
    for baseline in ("bad.tsv", "missing.tsv"):  # a broken baseline is bad input, no violation
        assert cli.main(["validate", *common, "--profile", "core", "--baseline", str(tmp_path / baseline)]) == 2
    assert capsys.readouterr().err.count("error:") == 2
    assert (tmp_path / "b.tsv").read_text().splitlines()[1].startswith("# signature\tseverity\trule")
    manifest = str(tmp_path / "known.nt")
    assert cli.main(["manifest", "--vocabulary", str(tmp_path / "vocabulary.ttl"), "--output", manifest]) == 0
    assert cli.main(["manifest", "--vocabulary", str(tmp_path / "vocabulary.ttl"), "--output", manifest, "--check"]) == 0
    assert cli.main(["validate", "--manifest", manifest, "--data", str(source), "--root", str(source), "--profile", "core", "--baseline", str(tmp_path / "b.tsv"), "--cross-module", "--store", str(tmp_path / "store")]) == 0
    told = capsys.readouterr()
    assert "DuplicateIdentifier: 1 focus nodes" in told.err and "union rule DuplicateIdentifier" in told.out and "peak driver heap" in told.out
    (tmp_path / "known.nt").write_text("")
    assert cli.main(["manifest", "--vocabulary", str(tmp_path / "vocabulary.ttl"), "--output", manifest, "--check"]) == 1
    assert cli.main(["validate", *common, "--store", str(tmp_path / "s2")]) == 2
    (tmp_path / "shapes.ttl").write_text("@prefix sh: <http://www.w3.org/ns/shacl#> . <urn:s> a sh:NodeShape ; sh:targetNode <urn:graphwarden:data:a> ; sh:property [ sh:path <urn:p> ; sh:minCount 1 ] .")
    assert cli.main(["validate", *common, "--profile", "core", "--baseline", str(tmp_path / "b.tsv"), "--shapes", str(tmp_path / "shapes.ttl")]) == 1


def test_catalog_of_repairs(data):
    define = "<urn:r:1> a <urn:graphwarden:Repair> ; <urn:graphwarden:rule> <urn:graphwarden:rule:KnownVocabularyTerm> ; <urn:graphwarden:bad> skos:preflabel ; <urn:graphwarden:replacement> skos:prefLabel {more}."
    read = rp.read_catalog(data.read(c=define.format(more='; <urn:graphwarden:profile> "skos" '))[0])
    assert [(r.id, r.rule, r.bad.rsplit("#")[-1], r.replacement.rsplit("#")[-1], r.profile) for r in read] == [("urn:r:1", "<urn:graphwarden:rule:KnownVocabularyTerm>", "preflabel", "prefLabel", "skos")]
    for more in ("; <urn:graphwarden:bad> skos:other ", '; <urn:graphwarden:safety> "Manual" ', "; <urn:graphwarden:profile> skos:x "):
        with pytest.raises(ValueError):
            rp.read_catalog(data.read(c=define.format(more=more))[0])
    with pytest.raises(ValueError, match="without"):
        rp.read_catalog(data.read(c="<urn:r:1> a <urn:graphwarden:Repair> .")[0])


def test_registry():
    for profile in ("core", "skos", "full"):
        for union in (False, True):
            for r in registry(profile, union):
                assert r.message and r.source and r.layer and r.severity
    assert [rule_count(p, False) for p in ("core", "skos", "full")] == [2, 8, 16]
    assert rule_count("full", True) == 20



def test_store_gives_the_same_findings_with_fewer_exchanges(data, spark, tmp_path):
    """Every rule of the full profile over ids and over spellings, and what each shuffles."""
    from graphwarden.operators import rules
    from graphwarden.plans.validation import findings, scoped
    from graphwarden.sources import store

    modules = {
        "a": 'e:x skos:prefLabel "a"@en , "b"@en ; skos:altLabel "a"@en ; skos:broader e:y ; skos:related e:y ; dct:identifier "1" . e:y skos:broader e:x ; dct:identifier "1" . e:z skos:broader e:z ; skos:related e:z ; skos:made e:q .',
        "b": 'e:b1 a d:Birth ; crm:P98_brought_into_life e:p ; crm:P4_has_time-span e:s1 . e:s1 crm:P82b_end_of_the_end "1950-01-01"^^xsd:date . e:b2 a d:Birth ; crm:P98_brought_into_life "x" , e:q . e:sub rdfs:subClassOf d:UnitJoining . e:j a e:sub ; crm:P143_joined e:u ; crm:P144_joined_with e:u .',
        "c": 'e:d1 a d:Death ; crm:P100_was_death_of e:p ; crm:P4_has_time-span e:s2 . e:s2 crm:P82a_begin_of_the_begin "1940-01-01"^^xsd:date . e:m a d:MedalAwarding ; crm:P11_had_participant <urn:graphwarden:actors:n> , [] . d:Conflict a rdfs:Class . <urn:graphwarden:domain:actors/hasConflict> rdfs:range <urn:graphwarden:conflicts:Conflict> .',
    }
    triples, faults = data.read(**modules)
    assert faults.isEmpty()
    context = data.context()
    for n, union in enumerate((True,)):
        every = [r for r in registry("full", union) if r.name != "BroaderRelatedDisjoint"]
        plain = sorted(map(tuple, findings(triples, context, every, union=union).collect()))
        kept = sorted(map(tuple, findings(triples, context, every, union=union, store=str(tmp_path / f"s{n}")).collect()))
        assert plain == kept and len(plain) > 12
    t = scoped(triples, None, True)
    kept = store.write(t, str(tmp_path / "s"))
    assert sorted(map(tuple, kept.plain.select(*t.columns).collect())) == sorted(map(tuple, t.collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ids = [f for f in registry("full", True) if f.name == "BirthDeathChronology"][0].build
        counts = [ids(x, context)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for x in (spark.createDataFrame(t.collect(), t.schema), kept.keyed)]
        stars = [rules.same_value(x, rules.target_subjects_of(x, "urn:p"), "urn:q", "urn:r")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for x in (t, kept.keyed)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert counts[1] * 2 <= counts[0] and stars[1] < stars[0], (counts, stars)
    kept.drop()
