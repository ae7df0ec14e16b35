"""What queries cost as tables grow: work that must not multiply with equal rows, pairs, files or columns."""

from graphwarden import catalog
from graphwarden.sources.lift import EX

DATA = "/root/testdata/sf0.001"


def test_labels_are_distinct_before_they_meet(spark):
    t = catalog.brand_labels(spark, DATA)
    assert t.count() == t.distinct().count()


def test_paths_both_ways_are_looked_for_once(spark, monkeypatch):
    from graphwarden.operators import closure

    calls, plain = [], closure.reached_pairs
    monkeypatch.setattr(closure, "reached_pairs", lambda *a: calls.append(1) or plain(*a))
    got = sorted(map(tuple, catalog.queries()["text_broader_related"](spark, DATA).collect()))
    assert len(calls) == 1
    assert got == sorted(map(tuple, catalog.queries()["broader_related"](spark, DATA).collect()))


def test_statements_of_small_files_share_a_frame():
    import pandas as pd

    from graphwarden.sources import turtle

    class Rows:
        def select(self, *_):
            return self

        def mapInPandas(self, run, _):
            return run

    one = "<urn:s> <urn:p> <urn:o> ."
    files = pd.DataFrame([("p", (one if i % 10 else "no").encode(), f"m{i}") for i in range(100)], columns=["path", "content", "module"])
    frames = list(turtle.whole_files(Rows())(iter([files])))
    assert len(frames) == 1 and len(frames[0]) == 100 and frames[0]["fault"].notna().sum() == 10


def test_references_are_dealt_before_they_are_distinct(spark):
    from graphwarden.operators import rules

    found = rules.dangling_reference(catalog.order_references(spark, DATA), [EX + "order/"])
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "HashAggregate" not in plan[plan.index("Join") :]
    assert found.count() == found.distinct().count() > 0


def test_store_keeps_no_spelling_twice(spark, tmp_path):
    from graphwarden.sources import store

    t = catalog.event_terms(spark, DATA).limit(50)
    kept = store.write(t.unionByName(t), str(tmp_path / "s"))
    assert not {"s_nt", "o_nt"} & set(spark.table(kept.tables[0]).columns)
    assert sorted(map(tuple, kept.plain.select(*t.columns).collect())) == sorted(set(map(tuple, t.collect())))
    kept.drop()


def test_what_a_store_keeps_is_dealt_before_it_is_lifted(spark, tmp_path):
    from graphwarden.functions.terms import iri_nt
    from graphwarden.sources import store

    t = catalog.life_events(spark, DATA)
    dealt = catalog.life_events_dealt(spark, DATA)(4, store.term_id)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if "Exchange" in x]
    assert len(moved) == 1 and plan.index("Exchange") > plan.index("Generate inline(CASE")
    columns = [c for c in t.columns if not c.endswith("_nt")]
    want = t.select(*columns, store.term_id(iri_nt(t["s"])).alias("s_id")).distinct()
    assert dealt.select(*want.columns).exceptAll(want).isEmpty() and dealt.count() == want.count()
    kept = store.write(t, str(tmp_path / "s"), 4, catalog.life_events_dealt(spark, DATA), catalog.life_objects(spark, DATA))
    nodes = {r[0] for r in kept.others.union(kept.subjects).select("nt").collect()}
    assert nodes == {x for r in t.select("s_nt", "o_nt").collect() for x in r}
    # a span is a subject, and its spelling is kept as that alone
    assert kept.others.where("nt LIKE '%-span/%'").isEmpty() and kept.others.where("nt LIKE '%order/%'").count() > 0
    assert len(spark.table(kept.tables[0]).inputFiles()) <= 4
    kept.drop()


def test_a_store_whose_ids_clash_is_written_anew(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from graphwarden.sources import store

    plain = store.term_id
    t = catalog.event_terms(spark, DATA).limit(60).persist()
    few = [lambda nt: F.xxhash64(nt) % 20, lambda nt: F.when(nt.startswith("<urn:t:user"), plain(nt)).otherwise(F.xxhash64(nt) % 20), lambda nt: F.coalesce(F.regexp_extract(nt, "([0-9]+)>", 1).cast("bigint") % 40, F.lit(0))]
    for n, bad in enumerate(few):
        monkeypatch.setattr(store, "term_id", lambda nt, seed=0, bad=bad: bad(nt) if seed == 0 else plain(nt, seed))
        kept = store.write(t, str(tmp_path / f"s{n}"))
        assert kept.seed == 1
        assert sorted(map(tuple, kept.plain.select(*t.columns).collect())) == sorted(set(map(tuple, t.collect())))
        said = kept.keyed.select("scope", F.concat(F.lit("#"), "s_nt").alias("focus"), F.concat(F.lit("#"), "o_nt").alias("value"))
        assert sorted(map(tuple, kept.spelled(said).collect())) == sorted({(r.scope, r.s_nt, r.o_nt) for r in t.collect()})
        kept.drop()
    t.unpersist()


def test_colours_of_a_round_are_dealt_once_and_short(spark):
    from graphwarden.operators import bnodes

    now = spark.createDataFrame([("m", f"_:{i}", i % 3, 0) for i in range(50)], "scope string, node string, c1 long, c2 long")
    looks = spark.createDataFrame([("m", f"_:{i}", "of\x1fp", f"_:{i // 2}") for i in range(50)], "scope string, looking string, how string, node string")
    kept = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in kept}
    try:
        for k, v in kept.items():
            spark.conf.set(k, v)
        found = bnodes._refined(now, looks, None)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ReusedExchange") == 1 and plan.count("- Exchange hashpartitioning") == 3
        assert found.count() == 50
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_no_pointers_where_no_node_lies_between_two(spark, monkeypatch):
    from graphwarden.operators import bnodes

    monkeypatch.setattr(bnodes, "_doubled", lambda pointers, scopes: None if pointers is None else 1 / 0)
    rows = [("m", f"_:{i}", True, "p", f"_:behind{i}", True) for i in range(4)] + [("m", f"_:{i}", True, "q", f"v{i % 2}", False) for i in range(4)]
    found = {r.node: r.colour for r in bnodes.colours(spark.createDataFrame(rows, "scope string, s string, s_blank boolean, p string, o string, o_blank boolean")).collect()}
    assert len(found) == 8 and len(set(found.values())) == 4 and all(len(c) == 32 for c in found.values())
    assert found["_:behind0"] == found["_:behind2"] != found["_:behind1"]


def test_a_line_is_matched_once(spark):
    from graphwarden.sources import turtle

    said = [
        '<urn:s> <urn:p> "a\\\\\\"b\\n\\u00e9" . # a "comment" .',
        '_:x <urn:p> "" .',
        '<urn:s> <urn:p> "x"@EN-gb.',
        '<urn:s>\t<urn:p>"5"^^<urn:d#t> .',
        "<urn:s> <urn:p> _:y .",
        "<urn:s> <urn:p> <urn:o> .",
        '<urn:s> <urn:p> "' + "long \\t text" * 9999 + '" .',
    ]
    bad = ['<urn:s> <urn:p> "a"b" .', '<urn:s> <urn:p> "a\\x" .', "<s> <urn:p> <urn:o> .", '<urn:s> <urn:p> "a"^^<d> .', '"a" <urn:p> <urn:o> .']
    lines = spark.createDataFrame([("m", x) for x in [*said, *bad, "", " # note"]], "module string, value string")
    found = turtle.statements(lines)
    plan = found.where("fault IS NULL").select("s", "o", "o_lang")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 3
    got = [tuple(r)[1:8] for r in found.where("fault IS NULL").collect()]
    assert sorted(got) == sorted(x for line in said for x in turtle.parse(line, "urn:b", "m"))
    assert found.where("fault IS NOT NULL").count() == len(bad)


def test_spellings_meet_by_numbers(spark):
    from graphwarden.operators import rules

    a = spark.createDataFrame([("m", "x", 1), ("m", "xy", 2), ("n", "x", 3), ("m", "y", 7)], "scope string, e string, i int")
    b = spark.createDataFrame([("m", "x", 4), ("m", "xyz", 5), ("m", "", 6), ("m", "x", 8), ("m", "y", 9)], "scope string, e string, j int")
    found = rules.met(a, ["scope", "e"], b, having=b.where("e <> 'y'"))
    assert sorted(map(tuple, found.collect())) == [("m", "x", 1, 4), ("m", "x", 1, 8)] and found.columns == ["scope", "e", "i", "j"]
    kept = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in kept}
    try:
        for k, v in kept.items():
            spark.conf.set(k, v)
        plan = rules.met(a, ["scope", "e"], b, having=b)._jdf.queryExecution().executedPlan().toString()
        # each side is dealt once, the left one for both joins
        assert plan.count("- Exchange hashpartitioning(__key") == 3 and plan.count("- Exchange") == 3
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_most_dates_are_read_without_a_pattern(spark):
    from pyspark.sql import functions as F

    from graphwarden.functions.terms import strict_date

    texts = ["2024-02-29", "2023-02-29", "2024-2-9", "2024-02-09Z", "2024-02-09T10:00:00", "2024-02-09 x", "+2024-02-09", "02024-02-09", "12024-02-09", "-0044-03-15", "2024-02-09\\n", "2024", " 2024-02-09", ""]
    d = spark.createDataFrame([(x,) for x in texts], "o string").select("o", strict_date(F.col("o")).cast("string").alias("d"))
    got = {r.o: r.d for r in d.collect()}
    want = {"2024-02-29": "2024-02-29", "2024-02-09Z": "2024-02-09", "2024-02-09T10:00:00": "2024-02-09", "02024-02-09": "2024-02-09"}
    assert {k: v for k, v in got.items() if k in want} == want
    assert all(got[x] is None for x in ("2023-02-29", "2024-2-9", "2024-02-09 x", "+2024-02-09", "2024-02-09\\n", "2024", " 2024-02-09", ""))


def test_days_of_a_person_with_other_spellings(spark):
    from graphwarden.functions.terms import CRM, TYPE, XSD
    from graphwarden.operators import rules

    def one(s, p, o, dt=""):
        return ("m", s, "iri", p, o, "literal" if dt else "iri", dt, "", f"<{s}>", f'"{o}"' if dt else f"<{o}>")

    rows = []
    for kind, at, days in (("B", "end", ["2001-01-01", "2001-01-02T00:00:00", "2001-01-02", "2001-01-02Z"]), ("D", "begin", ["2000-05-05Z", "2000-05-05", "2000-06-01"])):
        rows += [one("e" + kind, TYPE, kind), one("e" + kind, "who" + kind, "p"), one("e" + kind, CRM + "P4_has_time-span", "t" + kind)] + [one("t" + kind, at, d, XSD + "date") for d in days]
    t = spark.createDataFrame(rows, "scope string, s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string, s_nt string, o_nt string")
    got = [r.message for r in rules.chronology(t, ("B", "whoB", "end"), ("D", "whoD", "begin")).collect()]
    assert got == ["Person p has birth end 2001-01-02Z after death begin 2000-05-05"]


def test_patterns_of_one_subject_are_dealt_once(spark):
    from graphwarden.plans import algebra
    from graphwarden.plans.sparql import read_select

    text = "SELECT $this ?b ?c { $this <urn:a> ?a ; <urn:b> ?b ; <urn:c> ?c }"
    t = catalog.event_terms(spark, DATA)
    kept = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.optimizer.excludedRules": "org.apache.spark.sql.catalyst.optimizer.PropagateEmptyRelation"}
    t = spark.createDataFrame(t.limit(5).collect(), t.schema)
    old = {k: spark.conf.get(k, None) for k in kept}
    try:
        for k, v in kept.items():
            spark.conf.set(k, v)
        found = algebra.rule_rows(t, read_select(text))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("- Exchange hashpartitioning(__key") == plan.count("- Exchange hashpartitioning") == 3
        assert not [c for c in found.columns if c.startswith("__")]
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
