"""The rules, each one set-based plan over triples of any number of scopes.

A scope is a module, or the union of all (UNION). Input triples have the columns of TRIPLE_FIELDS with
`scope` for `module`, and are distinct within a scope; s_nt and o_nt are keys to rules: spellings, or the ids of
a store (sources/store.py), which stand marked in the rows of a rule until they are spelled. A rule gives rows (scope, focus, path, value,
message, occurrence): terms in N-Triples spelling ('' where absent). occurrence tells apart findings
that are otherwise equal and is dropped by findings().

The messages that rules build from their rows are part of a finding's identity: fixed values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphwarden.functions.terms import BNODE, CRM, DCT, IRI, LITERAL, OWL, RDF, RDFS, SKOS, STANDARD_NAMESPACES, TYPE, XSD, LEXICAL, ill_typed, iri_nt, once, starts_with_any, strict_date
from graphwarden.operators import closure as paths

UNION = "@union"
#: What stands before an id in a rule's row; no spelling begins so.
MARK = "#"
#: How columns of met() begin.
KEY = "__key"
#: The focus of rules that run once over a whole scope.
AUDIT_TARGET = "<urn:graphwarden:audit-target>"
FIELDS = ("scope", "focus", "path", "value", "message", "occurrence")


def rows(df: DataFrame, *, focus: Column | str, path: Column | str = "", value: Column | str = "", message: Column | str | None = None, occurrence: Column | str = "", distinct: bool = True) -> DataFrame:
    def column(x):
        return F.lit(x) if isinstance(x, str) else x

    text = F.lit(None).cast("string") if message is None else column(message)
    out = df.select("scope", column(focus).alias("focus"), column(path).alias("path"), column(value).alias("value"), text.alias("message"), column(occurrence).alias("occurrence"))
    ids = [f.name for f in out.schema.fields if isinstance(f.dataType, T.LongType)]
    out = out.withColumns({c: F.concat(F.lit(MARK), F.col(c).cast("string")) for c in ids}) if ids else out
    return out.distinct() if distinct else out


def is_iri(side: str, *iris: str) -> Column:
    """Whether a statement's subject (s) or object (o) is one of the IRIs, by its text: keys may be ids."""
    return (F.col(f"{side}_kind") == IRI) & F.col(side).isin(*iris)


def resource(nt: Column, kind: Column, text: Column) -> Column:
    """STR() of a term: unbound for a blank node."""
    return F.when(kind != BNODE, text)


def met(a: DataFrame, on: list[str], *others: DataFrame, having: DataFrame | None = None, keep: bool = False) -> DataFrame:
    """a joined with others by spellings, of rows that having has: by 128 bits of the spellings, dealt and sorted as two longs.

    Spellings begin alike, so sorting by them compares them whole; they are longer; and a side whose scope is a constant would be
    dealt anew for the next join. Among a thousand million spellings two share their bits with a chance of 2e-21. Keys that are
    a store's ids are joined as they are. keep: the bits stay in columns KEY, for the next join on the same.
    """
    parts = [*([] if having is None else [(having.select(*on), "left_semi")]), *((x, "inner") for x in others)]
    if any(isinstance(a.schema[c].dataType, T.LongType) for c in on):
        return reduce(lambda x, part: x.join(part[0], on, part[1]), parts, a)
    keys = {f"{KEY}{seed} {' '.join(on)}": F.xxhash64(F.lit(seed), *on) for seed in (1, 2)}
    out = a.withColumns({k: x for k, x in keys.items() if k not in a.columns})
    for x, how in parts:
        out = out.join(x.select(*[F.xxhash64(F.lit(seed), *on).alias(k) for seed, k in zip((1, 2), keys, strict=True)], *[c for c in x.columns if c not in on and not c.startswith(KEY)]), list(keys), how)
    return out if keep else out.drop(*keys)


def ill_typed_literals(t: DataFrame) -> DataFrame:
    """Literals outside their datatype's lexical form, once for each predicate, value and subject."""
    found = t.where((F.col("o_kind") == LITERAL) & F.col("o_dt").isin([XSD + d for d in LEXICAL]) & ill_typed(F.col("o_dt"), F.col("o")))
    message = F.concat(F.lit("Ill-typed "), F.col("o_dt"), F.lit(" literal on "), resource(F.col("s_nt"), F.col("s_kind"), F.col("s")))
    # DISTINCT covers the message only: blank subjects share the unbound one
    return rows(found, focus=AUDIT_TARGET, path=iri_nt(F.col("p")), value=F.col("o_nt"), message=message)


def known_terms(t: DataFrame, manifest: DataFrame, namespaces=STANDARD_NAMESPACES) -> DataFrame:
    """Terms of the checked namespaces in a role that the manifest (term, is_class, is_predicate) does not list.

    Each statement tells up to three uses in one scan. What the manifest lists goes before anything is
    shuffled for being distinct; Spark broadcasts the manifest where it is small.
    """
    subject = resource(F.col("s_nt"), F.col("s_kind"), F.col("s"))
    typed = (F.col("p") == TYPE) & (F.col("o_kind") == IRI)

    def use(role: str, term: Column, path: Column, occurrence: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), term.alias("term"), path.alias("path"), F.col("s_nt").alias("value"), occurrence.cast("string").alias("occurrence"), subject.alias("user"), F.col("s_kind").alias("user_kind"))

    def declared(kinds: list[str], role: str) -> Column:
        return F.when(typed & F.col("o").isin(kinds) & (F.col("s_kind") == IRI), use(role, F.col("s"), F.lit(f"<{TYPE}>"), F.lit("")))

    as_predicate = use("predicate", F.col("p"), iri_nt(F.col("p")), F.col("o_nt"))
    as_class = F.when(typed, use("class", F.col("o"), iri_nt(F.col("o")), F.lit("")))
    of_predicates = declared([RDF + "Property", OWL + "ObjectProperty", OWL + "DatatypeProperty", OWL + "AnnotationProperty"], "predicate")
    of_classes = declared([RDFS + "Class", RDFS + "Datatype", OWL + "Class"], "class")
    checked = F.filter(F.array(as_predicate, as_class, of_predicates, of_classes), lambda x: x.isNotNull() & starts_with_any(x["term"], namespaces) & ~((x["role"] == "predicate") & x["term"].rlike("^" + RDF.replace(".", "[.]") + r"_[1-9][0-9]*\z")))
    uses = t.select("scope", F.explode(checked).alias("x")).select("scope", "x.*")
    listed = manifest.select("term", F.explode(F.filter(F.array(F.when(F.col("is_class"), F.lit("class")), F.when(F.col("is_predicate"), F.lit("predicate"))), lambda r: r.isNotNull())).alias("role"))
    bad = uses.join(listed, ["term", "role"], "left_anti")
    message = F.concat(F.lit("Unknown standard vocabulary term "), F.col("term"), F.lit(" used by "), F.col("user"))
    return rows(bad, focus=AUDIT_TARGET, path=F.col("path"), value=F.col("value"), message=message, occurrence=F.col("occurrence"))


def preferred_label_language(t: DataFrame, predicate: str = SKOS + "prefLabel") -> DataFrame:
    """Further preferred labels of a resource in one language: all but those with the least text.

    Only the least texts of resources with several are joined back, so a resource with most labels of
    all is aggregated in parts and its labels stay dealt as they were.
    """
    labels = t.where((F.col("p") == predicate) & (F.col("o_kind") == LITERAL))
    least = labels.groupBy("scope", "s_nt", "o_lang").agg(F.min("o").alias("least"), F.max("o").alias("most")).where("least < most").drop("most")
    late = labels.join(least, ["scope", "s_nt", "o_lang"]).where(F.col("o") > F.col("least"))
    message = F.concat(F.lit("Duplicate preferred-label language '"), F.col("o_lang"), F.lit("'"))
    return rows(late, focus=F.col("s_nt"), path=f"<{predicate}>", value=F.col("o_nt"), message=message)


def label_disjointness(t: DataFrame, predicates=(SKOS + "prefLabel", SKOS + "altLabel", SKOS + "hiddenLabel")) -> DataFrame:
    """Labels that a resource has under two label predicates, once for each pair.

    The few predicates of one label are collected per key and paired there, so no self-join is needed.
    """
    labels = t.where(F.col("p").isin(*predicates)).groupBy("scope", "s_nt", "o_nt").agg(F.array_sort(F.collect_set("p")).alias("ps")).where(F.size("ps") > 1)
    pairs = labels.select("scope", "s_nt", "o_nt", F.explode(F.flatten(F.transform("ps", lambda b, j: F.transform(F.slice("ps", 1, j), lambda a: F.struct(a.alias("a"), b.alias("b")))))).alias("x"))
    message = F.concat(F.lit("Label is used by both "), F.col("x.a"), F.lit(" and "), F.col("x.b"))
    return rows(pairs, focus=F.col("s_nt"), path=iri_nt(F.col("x.b")), value=F.col("o_nt"), message=message)


def self_link(t: DataFrame, predicate: str) -> DataFrame:
    """Resources linked to themselves."""
    found = t.where((F.col("p") == predicate) & (F.col("s_nt") == F.col("o_nt")))
    return rows(found, focus=F.col("s_nt"), path=f"<{predicate}>", value=F.col("s_nt"), distinct=False)


def links(t: DataFrame, predicate: str) -> DataFrame:
    return t.where((F.col("p") == predicate) & (F.col("o_kind") != LITERAL)).select("scope", F.col("s_nt").alias("a"), F.col("o_nt").alias("b"))


def link_cycle(t: DataFrame, predicate: str = SKOS + "broader") -> DataFrame:
    """Resources on a cycle of the link (a self-link is one)."""
    return rows(paths.cyclic_nodes(links(t, predicate)), focus=F.col("node"), path=f"<{predicate}>", value=F.col("node"), distinct=False)


def closure_disjoint(t: DataFrame, hierarchy: str = SKOS + "broader", relation: str = SKOS + "related") -> DataFrame:
    """Resources related to one above or below them in the hierarchy."""
    related = links(t, relation)
    turned = related.select("scope", F.col("b").alias("a"), F.col("a").alias("b"))
    met = paths.reached_pairs(links(t, hierarchy), related.unionByName(turned))
    found = met.unionByName(met.select("scope", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return rows(related.join(found, ["scope", "a", "b"], "left_semi"), focus=F.col("a"), path=f"<{relation}>", value=F.col("b"))


def node_target_pair(t: DataFrame, node: str, range_: str, declared: str) -> DataFrame:
    """The node where its range is one class while another is declared as a class."""
    ranged = t.where(is_iri("s", node) & (F.col("p") == RDFS + "range") & is_iri("o", range_)).select("scope").distinct()
    other = t.where(is_iri("s", declared) & (F.col("p") == TYPE) & is_iri("o", RDFS + "Class")).select("scope").distinct()
    return rows(ranged.join(other, "scope", "left_semi"), focus=f"<{node}>", path=f"<{RDFS}range>", value=f"<{range_}>", distinct=False)


def duplicate_identifier(t: DataFrame, predicate: str = DCT + "identifier") -> DataFrame:
    """Identifiers of more than one resource. Resources are made distinct by key first, so a hot identifier is counted in parts."""
    pairs = t.where(F.col("p") == predicate).select("scope", "o_nt", "s_nt").distinct()
    shared = pairs.groupBy("scope", "o_nt").agg(F.count("*").alias("n")).where("n > 1")
    return rows(shared, focus=AUDIT_TARGET, path=f"<{predicate}>", value=F.col("o_nt"), message=F.concat(F.lit("Identifier is shared by "), F.col("n").cast("string"), F.lit(" resources")))


def chronology(t: DataFrame, birth: tuple[str, str, str], death: tuple[str, str, str], span: str = CRM + "P4_has_time-span") -> DataFrame:
    """Persons whose latest birth bound is after their earliest death bound.

    birth and death: (event class, event to person, span to bound). Persons, spans and classes of events
    are dealt once by the event, and each side is one row for each person before the two meet. Of a person's days
    with like spellings only the first or last is sorted.
    """

    def bound(event: tuple[str, str, str], latest: bool) -> DataFrame:
        cls, person, at = event
        events = t.where((F.col("p") == TYPE) & is_iri("o", cls)).select("scope", F.col("s_nt").alias("e"))
        persons = t.where(F.col("p") == person).select("scope", F.col("s_nt").alias("e"), F.col("o_nt").alias("person"), *([resource(F.col("o_nt"), F.col("o_kind"), F.col("o")).alias("name")] if latest else []))
        spans = t.where(F.col("p") == span).select("scope", F.col("s_nt").alias("e"), F.col("o_nt").alias("sp"))
        said = once(t.where((F.col("p") == at) & (F.col("o_kind") == LITERAL)).select("scope", F.col("s_nt").alias("sp"), "o"), F.col("o").alias("text"))
        days = said.select("scope", "sp", "text", strict_date(F.col("text")).alias("day")).where("day IS NOT NULL")
        # a text that is spelled as its date is follows from it, and only others are keys
        days = days.select("scope", "sp", "day", F.when(F.col("text") != F.col("day").cast("string"), F.col("text")).alias("odd"))
        joined = met(met(persons, ["scope", "e"], spans, having=events), ["scope", "sp"], days)
        few = joined.groupBy(*persons.columns[2:], "scope", "odd").agg((F.max if latest else F.min)("day").alias("day"))
        bounds = F.struct("day", F.coalesce("odd", F.col("day").cast("string")).alias("text"))
        return few.groupBy("scope", "person").agg((F.max if latest else F.min)(bounds).alias("x"), *[F.min(c).alias(c) for c in persons.columns[3:]])

    born = bound(birth, True).select("scope", "person", F.col("x").alias("b"), "name")
    died = bound(death, False).select("scope", "person", F.col("x").alias("d"))
    bad = met(born, ["scope", "person"], died).where(F.col("b.day") > F.col("d.day"))
    message = F.concat(F.lit("Person "), F.col("name"), F.lit(" has birth end "), F.col("b.text"), F.lit(" after death begin "), F.col("d.text"))
    return rows(bad, focus=AUDIT_TARGET, path=f"<{span}>", value=F.col("person"), message=message, distinct=False)


def dangling_reference(t: DataFrame, namespaces: list[str]) -> DataFrame:
    """(predicate, object) pairs whose object is an IRI of the namespaces without a statement of its own.

    References are made distinct behind the join, dealt in as many parts as shuffles have at most: before it a task
    would keep all that its split of the input names, and in fewer, larger parts more at once. Only subjects of the
    namespaces can be what is looked for.
    """
    parts = int(t.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    used = t.where((F.col("o_kind") == IRI) & starts_with_any(F.col("o"), namespaces)).select("scope", "p", "o", "o_nt")
    described = t.where((F.col("s_kind") == IRI) & starts_with_any(F.col("s"), namespaces)).select("scope", F.col("s_nt").alias("o_nt"))
    dangling = used.join(described, ["scope", "o_nt"], "left_anti").repartition(parts, "scope", "o_nt").distinct()
    return rows(dangling, focus=AUDIT_TARGET, path=iri_nt(F.col("p")), value=F.col("o_nt"), message=F.concat(F.lit("Unresolved internal IRI "), F.col("o")), distinct=False)


def typed_participant(t: DataFrame, predicate: str, namespace: str, classes: list[str]) -> DataFrame:
    """Participants of a namespace that have none of the classes."""
    used = t.where((F.col("p") == predicate) & (F.col("o_kind") == IRI) & F.col("o").startswith(namespace)).select("scope", "o", "o_nt").distinct()
    typed = t.where((F.col("p") == TYPE) & is_iri("o", *classes)).select("scope", F.col("s_nt").alias("o_nt")).distinct()
    return rows(used.join(typed, ["scope", "o_nt"], "left_anti"), focus=AUDIT_TARGET, path=f"<{predicate}>", value=F.col("o_nt"), message=F.concat(F.lit("Untyped participant "), F.col("o")))


# Targets and constraint components


def target_node(t: DataFrame, node: str) -> DataFrame:
    """The node in every scope, whether or not the data have it."""
    return t.select("scope").distinct().select("scope", F.lit(f"<{node}>").alias("focus"))


def target_subjects_of(t: DataFrame, *predicates: str) -> DataFrame:
    return t.where(F.col("p").isin(*predicates)).select("scope", F.col("s_nt").alias("focus")).distinct()


def subclasses(t: DataFrame) -> DataFrame:
    """(scope, a, b): a is a subclass of b, by any number of links that the scope declares. One for all rules of a run."""
    return paths.closure(links(t, RDFS + "subClassOf"))


def target_class(t: DataFrame, cls: str, below: DataFrame | None = None) -> DataFrame:
    """Instances of a class or of a subclass that the same scope declares; below: subclasses(t)."""
    below = subclasses(t) if below is None else below
    named = t.where((F.col("p") == RDFS + "subClassOf") & is_iri("o", cls)).select("scope", F.col("o_nt").alias("b")).distinct()
    under = below.join(named, ["scope", "b"], "left_semi").select("scope", "a")
    direct = t.where(F.col("p") == TYPE).select("scope", F.col("s_nt").alias("focus"), F.col("o_nt").alias("a"))
    own = t.where((F.col("p") == TYPE) & is_iri("o", cls)).select("scope", F.col("s_nt").alias("focus"))
    return own.unionByName(direct.join(under, ["scope", "a"], "left_semi").select("scope", "focus")).distinct()


def _values(t: DataFrame, targets: DataFrame, path: str) -> DataFrame:
    values = t.where(F.col("p") == path).select("scope", F.col("s_nt").alias("focus"), "o_nt", "o_kind").distinct()
    return targets.join(values, ["scope", "focus"], "left")


def min_count(t: DataFrame, targets: DataFrame, path: str, least: int = 1) -> DataFrame:
    few = _values(t, targets, path).groupBy("scope", "focus").agg(F.count("o_nt").alias("n")).where(F.col("n") < least)
    return rows(few, focus=F.col("focus"), path=f"<{path}>", distinct=False)


def max_count(t: DataFrame, targets: DataFrame, path: str, most: int = 1) -> DataFrame:
    many = _values(t, targets, path).groupBy("scope", "focus").agg(F.count("o_nt").alias("n")).where(F.col("n") > most)
    return rows(many, focus=F.col("focus"), path=f"<{path}>", distinct=False)


def node_kind_iri(t: DataFrame, targets: DataFrame, path: str) -> DataFrame:
    bad = _values(t, targets, path).where("o_kind IS NOT NULL").where(F.col("o_kind") != IRI)
    return rows(bad, focus=F.col("focus"), path=f"<{path}>", value=F.col("o_nt"), distinct=False)


def same_value(t: DataFrame, targets: DataFrame, first: str, second: str) -> DataFrame:
    """Targets with one value under both predicates."""
    a = t.where(F.col("p") == first).select("scope", F.col("s_nt").alias("focus"), "o_nt")
    b = t.where(F.col("p") == second).select("scope", F.col("s_nt").alias("focus"), "o_nt")
    found = targets.join(a, ["scope", "focus"]).join(b, ["scope", "focus", "o_nt"], "left_semi")
    return rows(found, focus=F.col("focus"), path=f"<{second}>", value=F.col("o_nt"), distinct=False)
