"""SPARQL trees (plans/sparql.py) as DataFrame plans over triples of any number of scopes.

A solution is a row: its scope, and five columns for each variable (PARTS), all null where it is unbound, as an
expression's value is where it has an error. Patterns become filtered scans and equi-joins on scope and
spellings, VALUES a filter or an inline table, FILTER EXISTS a semi join, NOT EXISTS an anti join, UNION a union,
GROUP BY an aggregation, `p+` the closure of operators/closure.py, and the pre-bound $this a constant
or a join with the targets. Spark plans and runs the rest. What would need another kind of join (patterns
without a shared variable, join keys that may be unbound, filters over variables of an outer group) is an error.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwarden.functions.terms import BNODE, IRI, LITERAL, RDF, XSD, literal_nt, strict_date
from graphwarden.operators import closure as paths
from graphwarden.operators.rules import KEY, links, met
from graphwarden.plans.sparql import AGGREGATES, Bind, Call, Exists, Filter, Group, Operation, Select, SparqlError, Term, Triple, Union, Values, Var, variables

#: Columns of a variable: N-Triples spelling, kind, IRI or lexical form, datatype, language.
PARTS = ("nt", "kind", "text", "dt", "lang")
_STRING, _LANG = XSD + "string", RDF + "langString"
_NUMERIC = [XSD + n for n in ("integer", "decimal", "double", "float", "byte", "short", "int", "long", "unsignedByte", "unsignedShort", "unsignedInt", "unsignedLong", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger")]


def name(var: str, part: str = "nt") -> str:
    return f"{var}__{part}"


@dataclass(frozen=True)
class X:
    """A value: a term's columns. constant: the term itself, where it is one; sure: whether it cannot be unbound."""

    nt: Column
    kind: Column
    text: Column
    dt: Column
    lang: Column
    constant: Term | None = None
    sure: bool = False
    #: Of a test, its value as a boolean column.
    test: Column | None = None

    def columns(self, var: str) -> list[Column]:
        return [getattr(self, p).alias(name(var, p)) for p in PARTS]


@dataclass(frozen=True)
class Rel:
    """Solutions, the variables that they have columns of, and those of them that are bound in every one."""

    df: DataFrame
    bound: frozenset[str] = frozenset()
    certain: frozenset[str] = frozenset()


# values


def spelled(term: Term) -> str | Column:
    return f"<{term.text}>" if term.kind == IRI else literal_nt(F.lit(term.text), F.lit(term.dt), F.lit(term.lang))


def constant(term: Term) -> X:
    nt = spelled(term)
    return X(F.lit(nt) if isinstance(nt, str) else nt, F.lit(term.kind), F.lit(term.text), F.lit(term.dt), F.lit(term.lang), term, True)


def literal(text: Column, dt: str, sure: bool = False) -> X:
    """A literal without language; null where its text is."""
    on = text.isNotNull()
    return X(literal_nt(text, F.lit(dt), F.lit("")), F.when(on, LITERAL), text, F.when(on, dt), F.when(on, ""), sure=sure)


def boolean(test: Column) -> X:
    return replace(literal(test.cast("string"), XSD + "boolean"), test=test)


def of_variable(var: str, sure: bool = False) -> X:
    return X(*[F.col(name(var, p)) for p in PARTS], sure=sure)


def of_node(nt: Column) -> list[Column]:
    """The columns of a term that is no literal, from its spelling (an IRI or a blank node, as links() have them)."""
    blank = nt.startswith("_:")
    return [nt, F.when(blank, BNODE).otherwise(IRI), F.when(blank, F.substr(nt, F.lit(3))).otherwise(F.substr(nt, F.lit(2), F.length(nt) - 2)), F.lit(""), F.lit("")]


def utf16(text: Column) -> Column:
    """Text as bytes whose order is that of UTF-16 code units."""
    return F.encode(text, "UTF-16BE")


@dataclass(frozen=True)
class Key:
    """What values are compared by; each is null but for values of its kind."""

    number: Column
    day: Column
    time: Column
    text: Column
    truth: Column

    def all(self) -> list[Column]:
        return [self.number, self.day, self.time, self.text, self.truth]


def key(x: X) -> Key:
    lit = x.kind == LITERAL
    return Key(
        F.when(lit & x.dt.isin(_NUMERIC), x.text.try_cast("double")),
        F.when(lit & (x.dt == XSD + "date"), strict_date(x.text)),
        F.when(lit & (x.dt == XSD + "dateTime"), x.text.try_cast("timestamp")),
        F.when(lit & (x.dt == _STRING), x.text),
        F.when(lit & (x.dt == XSD + "boolean"), x.text.isin("true", "1")),
    )


def _static(x: X) -> str:
    """number, day, time, text, truth, iri, or '' where only the data tell."""
    t = x.constant
    if t is None:
        return ""
    if t.kind == IRI:
        return "iri"
    kinds = {XSD + "date": "day", XSD + "dateTime": "time", _STRING: "text", XSD + "boolean": "truth", **dict.fromkeys(_NUMERIC, "number")}
    return kinds.get(t.dt, "")


def compared(mark: str, a: X, b: X) -> Column:
    """a mark b by value; null (an error) for values that have no such order, or no known equality."""
    kind = _static(a) or _static(b)
    if mark == "=" and kind == "iri":
        return a.nt == b.nt
    ka, kb = key(a), key(b)
    tests = {"=": lambda p, q: p == q, "<": lambda p, q: p < q, ">": lambda p, q: p > q, "<=": lambda p, q: p <= q, ">=": lambda p, q: p >= q}
    cases = []
    for part in ("number", "day", "time", "text", "truth"):
        if kind in ("", part):
            p, q = getattr(ka, part), getattr(kb, part)
            cases.append(tests[mark](utf16(p), utf16(q)) if part == "text" and mark != "=" else tests[mark](p, q))
    found = F.coalesce(*cases)
    if mark != "=":
        return found
    known = F.lit(False)
    for x in (a, b):
        known = known | (x.kind != LITERAL) | (x.dt == _LANG)
    both = a.nt.isNotNull() & b.nt.isNotNull()
    # a term equals itself, and nothing of another kind; literals of unknown types that differ are an error
    unlike = known | ((a.dt == _STRING) & b.dt.isin([*_NUMERIC, XSD + "date", XSD + "dateTime", XSD + "boolean"])) | ((b.dt == _STRING) & a.dt.isin([*_NUMERIC, XSD + "date", XSD + "dateTime", XSD + "boolean"]))
    return F.when(both, F.when(a.nt == b.nt, True).otherwise(F.coalesce(found, F.when(unlike, False))))


def truth(x: X) -> Column:
    """The effective boolean value; null (an error) where there is none."""
    if x.test is not None:
        return x.test
    k = key(x)
    return F.when(x.dt == XSD + "boolean", k.truth).when(x.dt.isin(_NUMERIC), F.coalesce(k.number, F.lit(0.0)) != 0).when(x.dt.isin(_STRING, _LANG), F.length(x.text) > 0)


def _words(x: X) -> Column:
    """The text of a string literal."""
    return F.when((x.kind == LITERAL) & x.dt.isin(_STRING, _LANG), x.text)


def _pattern(x: X) -> str:
    """A pattern for Spark: `$` is the end of the text alone, not the place before a last line feed too."""
    if x.constant is None or x.constant.kind != LITERAL:
        raise SparqlError("the pattern of REGEX is a constant")
    out, inside, at, text = [], False, 0, x.constant.text
    while at < len(text):
        c = text[at]
        if c == "\\":
            out.append(text[at : at + 2])
            at += 2
            continue
        inside = c == "[" or inside and c != "]"
        out.append(r"\z" if c == "$" and not inside else c)
        at += 1
    return "".join(out)


def evaluate(e, rel: Rel, made: dict[Call, X] | None = None) -> X:
    """An expression over a solution; made: the aggregates that there are columns of."""
    if isinstance(e, Term):
        return constant(e)
    if isinstance(e, Var):
        if e.name not in rel.bound:
            raise SparqlError(f"the pattern does not have ?{e.name}")
        return of_variable(e.name, e.name in rel.certain)
    if e in (made or {}):
        return made[e]
    if e.name in AGGREGATES:
        raise SparqlError(f"{e.name} stands outside of an aggregation")
    args = [evaluate(a, rel, made) for a in e.args]
    a, b = (*args, None, None)[:2]
    match e.name:
        case "&&" | "||":
            p, q = truth(a), truth(b)
            return boolean(p & q if e.name == "&&" else p | q)
        case "!":
            return boolean(~truth(a))
        case "=" | "<" | ">" | "<=" | ">=":
            return boolean(compared(e.name, a, b))
        case "!=":
            return boolean(~compared("=", a, b))
        case "IN":
            return boolean(_among(a, args[1:]))
        case "STR":
            return literal(F.when(a.kind != BNODE, a.text), _STRING)
        case "LANG":
            return literal(F.when(a.kind == LITERAL, a.lang), _STRING)
        case "DATATYPE":
            dt = F.when(a.kind == LITERAL, a.dt)
            return X(F.concat(F.lit("<"), dt, F.lit(">")), F.when(dt.isNotNull(), IRI), dt, F.when(dt.isNotNull(), ""), F.when(dt.isNotNull(), ""))
        case "ISIRI" | "ISURI" | "ISLITERAL" | "ISBLANK":
            return boolean(a.kind == {"ISLITERAL": LITERAL, "ISBLANK": BNODE}.get(e.name, IRI))
        case "BOUND":
            return boolean(a.nt.isNotNull())
        case "SAMETERM":
            return boolean(a.nt == b.nt)
        case "REGEX":
            return boolean(_words(a).rlike(_pattern(b)))
        case "STRSTARTS" | "STRENDS" | "CONTAINS":
            return boolean(getattr(_words(a), {"STRSTARTS": "startswith", "STRENDS": "endswith", "CONTAINS": "contains"}[e.name])(_words(b)))
        case "STRLEN":
            return literal(F.length(_words(a)).cast("string"), XSD + "integer")
        case "LCASE" | "UCASE":
            return literal((F.lower if e.name == "LCASE" else F.upper)(_words(a)), _STRING)
        case "CONCAT":
            return literal(F.concat(*[_words(x) for x in args]), _STRING)
        case "COALESCE":
            # a term's columns are null together
            return X(*[F.coalesce(*[getattr(x, p) for x in args]) for p in PARTS], sure=any(x.sure for x in args))
        case "IF":
            test = truth(a)
            return X(*[F.when(test, getattr(args[1], p)).when(~test, getattr(args[2], p)) for p in PARTS])
    raise SparqlError(f"{e.name} is not supported")


def _among(a: X, among: list[X]) -> Column:
    if all(_static(x) == "iri" for x in among):
        return a.nt.isin([f"<{x.constant.text}>" for x in among]) if among else F.lit(False)
    return reduce(lambda p, q: p | q, [compared("=", a, x) for x in among])


# patterns


class Graph:
    """Triples with the columns of TRIPLE_FIELDS (scope for module), and patterns as plans over them."""

    def __init__(self, t: DataFrame):
        self.t = t

    def scopes(self) -> DataFrame:
        return self.t.select("scope").distinct()

    def scan(self, pattern: Triple, allowed: dict[str, list[Term]]) -> Rel:
        """One statement pattern. allowed: the terms that VALUES leave for a variable, for the scan's own filter."""
        own = {"s": X(F.col("s_nt"), F.col("s_kind"), F.col("s"), F.lit(""), F.lit("")), "p": X(F.concat(F.lit("<"), F.col("p"), F.lit(">")), F.lit(IRI), F.col("p"), F.lit(""), F.lit("")), "o": X(F.col("o_nt"), F.col("o_kind"), F.col("o"), F.col("o_dt"), F.col("o_lang"))}
        df, first = self.t, {}
        for place, x in own.items():
            node = getattr(pattern, place)
            if isinstance(node, Term):
                df = df.where(F.col("p") == node.text) if place == "p" and node.kind == IRI else df.where(x.nt == spelled(node))
                continue
            if node.name in allowed:
                terms = allowed[node.name]
                df = df.where(F.col("p").isin([v.text for v in terms if v.kind == IRI])) if place == "p" else df.where(reduce(lambda a, b: a | b, [x.nt == spelled(v) for v in terms], F.lit(False)))
            if node.name in first:
                df = df.where(first[node.name].nt == x.nt)
            else:
                first[node.name] = x
        if not first:
            return Rel(df.select("scope").distinct())
        return Rel(df.select("scope", *[c for v, x in first.items() for c in x.columns(v)]), frozenset(first), frozenset(first))

    def path(self, pattern: Triple, seed: Rel | None) -> Rel:
        """`s p+ o`. Between ends that the solutions so far have, only their pairs are looked for."""
        s, o, edges = pattern.s, pattern.o, links(self.t, pattern.p.text)
        ends = {v.name for v in (s, o) if isinstance(v, Var)}
        if isinstance(s, Var) and s == o:
            found = paths.cyclic_nodes(edges).withColumnRenamed("node", "a")
            return self._ends(found, {s.name: "a"})
        if seed is not None and len(ends) == 2 and ends <= seed.certain:
            pairs = seed.df.select("scope", F.col(name(s.name)).alias("a"), F.col(name(o.name)).alias("b")).distinct()
            return self._ends(paths.reached_pairs(edges, pairs), {s.name: "a", o.name: "b"})
        found = paths.closure(edges)
        for node, column in ((s, "a"), (o, "b")):
            if isinstance(node, Term):
                found = found.where(F.col(column) == spelled(node))
        if not ends:
            return Rel(found.select("scope").distinct())
        return self._ends(found, {v.name: c for v, c in ((s, "a"), (o, "b")) if isinstance(v, Var)})

    def paths_between(self, union: Union, seed: Rel | None) -> list[Rel] | None:
        """Branches that are each a path by one predicate between ends that the solutions so far have: all pairs are looked for at once. None for other unions."""
        steps = [b.parts[0] if len(b.parts) == 1 and isinstance(b.parts[0], Triple) and b.parts[0].plus else None for b in union.branches]
        if seed is None or None in steps or len({s.p for s in steps}) != 1:
            return None
        if any(not isinstance(s.s, Var) or not isinstance(s.o, Var) or s.s == s.o or not {s.s.name, s.o.name} <= seed.certain for s in steps):
            return None
        pairs = [seed.df.select("scope", F.col(name(s.s.name)).alias("a"), F.col(name(s.o.name)).alias("b")) for s in steps]
        met = paths.reached_pairs(links(self.t, steps[0].p.text), reduce(DataFrame.unionByName, pairs))
        # a pair of another branch is met by no solution, or rightly
        return [self._ends(met, {s.s.name: "a", s.o.name: "b"}) for s in steps]

    def _ends(self, found: DataFrame, named: dict[str, str]) -> Rel:
        columns = [c.alias(name(v, p)) for v, column in named.items() for p, c in zip(PARTS, of_node(F.col(column)), strict=True)]
        return Rel(found.select("scope", *columns), frozenset(named), frozenset(named))

    def join(self, a: Rel, b: Rel) -> Rel:
        shared = a.bound & b.bound
        if loose := shared - (a.certain & b.certain):
            raise SparqlError(f"?{min(loose)} may be unbound where two patterns meet")
        if not b.bound:
            return replace(a, df=a.df.join(b.df.select("scope").distinct(), "scope", "left_semi"))
        if not a.bound:
            return replace(b, df=b.df.join(a.df.select("scope").distinct(), "scope", "left_semi"))
        if not shared:
            raise SparqlError("two patterns share no variable")
        extra = [c for v in b.bound - shared for c in (name(v, p) for p in PARTS)]
        on = ["scope", *(name(v) for v in sorted(shared))]
        right = b.df.select(*on, *extra)
        return Rel(met(a.df, on, right, keep=True), a.bound | b.bound, a.certain | b.certain)

    def inline(self, rel: Rel, table: Values) -> Rel:
        """Solutions with an inline table: a filter where it has one bound variable, else its rows beside each solution, and no shuffle."""
        if len(table.names) == 1 and table.names[0] in rel.certain:
            mine = F.col(name(table.names[0]))
            return replace(rel, df=rel.df.where(reduce(lambda a, b: a | b, [mine == spelled(t) for t, in dict.fromkeys(table.rows)], F.lit(False))))
        if loose := (set(table.names) & rel.bound) - rel.certain:
            raise SparqlError(f"?{min(loose)} may be unbound where VALUES meets it")
        rows = F.array(*[F.struct(*[c for v, term in zip(table.names, row, strict=True) for c in constant(term).columns(v)]) for row in table.rows])
        df = rel.df.withColumn("__row", F.explode(rows))
        for v in table.names:
            if v in rel.bound:
                df = df.where(F.col(name(v)) == F.col(f"__row.{name(v)}"))
        new = [v for v in table.names if v not in rel.bound]
        df = df.select(*rel.df.columns, *[F.col(f"__row.{name(v, p)}").alias(name(v, p)) for v in new for p in PARTS])
        return Rel(df, rel.bound | set(new), rel.certain | set(new))

    def pattern(self, part, seed: Rel | None, allowed: dict[str, list[Term]]) -> Rel:
        match part:
            case Triple():
                return self.path(part, seed) if part.plus else self.scan(part, allowed)
            case Group():
                return self.group(part, seed)
            case Select():
                return self.select(part)
            case Union():
                parts = self.paths_between(part, seed) or [self.group(b, seed) for b in part.branches]
                bound = frozenset().union(*(r.bound for r in parts))
                df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [r.df for r in parts])
                return Rel(df, bound, frozenset.intersection(*(r.certain for r in parts)))
        raise SparqlError(f"{type(part).__name__} is not supported here")

    def group(self, group: Group, seed: Rel | None = None) -> Rel:
        """The solutions of a group. Patterns are joined in the order of the text, but each with what shares a variable with it; paths and unions wait for the ends they may start from."""
        rel: Rel | None = None
        waiting: list = []
        for part in group.parts:
            if isinstance(part, Filter):
                continue
            if isinstance(part, Bind):
                rel, waiting = self.met(rel, waiting, seed), []
                if part.var in rel.bound:
                    raise SparqlError(f"?{part.var} is bound already")
                x = evaluate(part.value, rel)
                certain = rel.certain | {part.var} if x.sure else rel.certain
                rel = Rel(rel.df.select("*", *x.columns(part.var)), rel.bound | {part.var}, certain)
            else:
                waiting.append(part)
        rel = self.met(rel, waiting, seed)
        for part in group.parts:
            if isinstance(part, Filter):
                rel = self.filter(rel, part.test)
        return replace(rel, df=rel.df.drop(*[c for c in rel.df.columns if c.startswith(KEY)]))

    def met(self, rel: Rel | None, waiting: list, seed: Rel | None) -> Rel:
        tables = [p for p in waiting if isinstance(p, Values)]
        allowed = {v: list(dict.fromkeys(r[i] for r in t.rows)) for t in tables for i, v in enumerate(t.names)}
        late = [p for p in waiting if isinstance(p, Union) or isinstance(p, Triple) and p.plus]
        others = [p for p in waiting if p not in tables and p not in late] + [p for p in late if isinstance(p, Union)] + [p for p in late if isinstance(p, Triple)]
        if rel is None and not others:
            rel = Rel(self.scopes())
        while others:
            known = rel.bound if rel is not None else frozenset()
            here = [p for p in others if rel is None or not known or not variables(p) or variables(p) & known]
            part = next((p for p in here if p not in late), here[0] if here else others[0])
            others.remove(part)
            found = self.pattern(part, rel if rel is not None and rel.bound else seed, allowed)
            rel = found if rel is None else self.join(rel, found)
        for table in tables:
            rel = self.inline(rel, table)
        return rel

    def filter(self, rel: Rel, test) -> Rel:
        if isinstance(test, Exists):
            inner = self.group(test.group)
            shared = sorted(inner.bound & rel.bound)
            if loose := set(shared) - (inner.certain & rel.certain):
                raise SparqlError(f"?{min(loose)} may be unbound where EXISTS meets it")
            on = ["scope", *(name(v) for v in shared)]
            return replace(rel, df=rel.df.join(inner.df.select(*on).distinct(), on, "left_anti" if test.negated else "left_semi"))
        return replace(rel, df=rel.df.where(truth(evaluate(test, rel))), certain=rel.certain | _proven(test))

    def select(self, query: Select, distinct: bool = True) -> Rel:
        rel, made = self.group(query.where), {}
        calls = list(dict.fromkeys(c for e in (*[e for _, e in query.items], *query.having) for c in _aggregates(e)))
        if calls or query.group_by:
            rel, made = self.grouped(rel, query.group_by, calls)
        values = {v: evaluate(e, rel, made) for v, e in query.items}
        df = rel.df
        for test in query.having:
            df = df.where(truth(evaluate(test, rel, made)))
        df = df.select("scope", *[c for v, x in values.items() for c in x.columns(v)])
        return Rel(df.distinct() if query.distinct and distinct else df, frozenset(values), frozenset(v for v, x in values.items() if x.sure))

    def grouped(self, rel: Rel, by: tuple[str, ...], calls: list[Call]) -> tuple[Rel, dict[Call, X]]:
        """Solutions by their groups. MIN and MAX are of values that can be compared; counts are of bound ones."""
        if missing := set(by) - rel.certain:
            raise SparqlError(f"?{min(missing)} may be unbound in GROUP BY")
        keys = ["scope", *(name(v, p) for v in by for p in PARTS)]
        aggregates = []
        for i, call in enumerate(calls):
            x = evaluate(call.args[0], rel) if call.args else None
            if call.name == "COUNT":
                if x is None and call.distinct:
                    raise SparqlError("COUNT(DISTINCT *) is not supported")
                aggregates.append((F.count("*") if x is None else F.count_distinct(x.nt) if call.distinct else F.count(x.nt)).alias(f"__{i}"))
            else:
                k = key(x)
                k = [k.number, k.day, k.time, utf16(k.text), k.truth]
                whole = F.when(reduce(lambda p, q: p | q, [c.isNotNull() for c in k]), F.struct(*[c.alias(f"k{n}") for n, c in enumerate(k)], *x.columns("v")))
                aggregates.append((F.min if call.name == "MIN" else F.max)(whole).alias(f"__{i}"))
        df = rel.df.groupBy(*keys).agg(*aggregates) if aggregates else rel.df.select(*keys).distinct()
        made = {}
        for i, call in enumerate(calls):
            made[call] = literal(F.col(f"__{i}").cast("string"), XSD + "integer", True) if call.name == "COUNT" else X(*[F.col(f"__{i}.{name('v', p)}") for p in PARTS])
        return Rel(df, frozenset(by), frozenset(by)), made


def _proven(test) -> frozenset[str]:
    """Variables that are bound wherever the test holds, as far as it says so by BOUND."""
    if isinstance(test, Call) and test.name == "&&":
        return _proven(test.args[0]) | _proven(test.args[1])
    return frozenset({test.args[0].name}) if isinstance(test, Call) and test.name == "BOUND" and isinstance(test.args[0], Var) else frozenset()


def _aggregates(e) -> list[Call]:
    if not isinstance(e, Call):
        return []
    return [e] if e.name in AGGREGATES else [c for a in e.args for c in _aggregates(a)]


def substituted(part, var: str, term: Term):
    """A tree with a variable's every use replaced by a term, subselects included; what binds it anew is an error."""

    def go(x):
        match x:
            case Var():
                return term if x.name == var else x
            case Triple():
                return Triple(go(x.s), go(x.p), go(x.o), x.plus)
            case Call():
                return Call(x.name, tuple(go(a) for a in x.args), x.distinct)
            case Exists():
                return Exists(go(x.group), x.negated)
            case Filter():
                return Filter(go(x.test))
            case Bind() if x.var != var:
                return Bind(go(x.value), x.var)
            case Values() if var not in x.names:
                return x
            case Union():
                return Union(tuple(go(b) for b in x.branches))
            case Group():
                return Group(tuple(go(b) for b in x.parts))
            case Select():
                return Select(tuple((v, go(e)) for v, e in x.items), go(x.where), x.distinct, tuple(v for v in x.group_by if v != var), tuple(go(e) for e in x.having))
            case Term():
                return x
        raise SparqlError(f"${var} is given, and cannot be bound anew")

    return go(part)


# rules and updates


def rule_rows(t: DataFrame, query: Select, targets: DataFrame | None = None, node: str | None = None) -> DataFrame:
    """The rows (scope, focus, path, value, message, occurrence) of a rule's query: one for each solution.

    $this is node, an IRI, or else a node of targets (scope, focus). What is selected beside $this, ?path,
    ?value and ?message tells findings apart that are otherwise equal.
    """
    selected = {v for v, _ in query.items}
    if node is not None:
        query = substituted(query, "this", Term(IRI, node))
        rel = Graph(t).select(query, distinct=False)
        focus = F.lit(f"<{node}>")
    else:
        if "this" not in selected or "this" not in variables(query.where):
            raise SparqlError("a query over several focus nodes has $this in its pattern, and selects it")
        rel = Graph(t).select(query, distinct=False)
        focus = F.col(name("this"))
        if targets is not None:
            rel = replace(rel, df=rel.df.join(targets.select("scope", F.col("focus").alias(name("this"))).distinct(), ["scope", name("this")], "left_semi"))

    def shown(v: str) -> Column:
        return F.coalesce(F.col(name(v)), F.lit("")) if v in rel.bound else F.lit("")

    more = [F.coalesce(F.col(name(v)), F.lit("")) for v in sorted(rel.bound - {"this", "path", "value", "message"})]
    message = F.col(name("message", "text")) if "message" in rel.bound else F.lit(None).cast("string")
    out = rel.df.select("scope", focus.alias("focus"), shown("path").alias("path"), shown("value").alias("value"), message.alias("message"), F.concat_ws(" ", *more).alias("occurrence"))
    return out.distinct() if query.distinct else out


def updated(t: DataFrame, operations: tuple[Operation, ...]) -> DataFrame:
    """Triples (scope) after operations in order: each one's templates are filled from the solutions over what the one before left.

    Only statements that have the constants of a deletion template meet its rows; all others stay where they are.
    """
    for op in operations:
        rel = Graph(t).group(op.where) if op.where.parts else Rel(t.select("scope").distinct())
        keys = ["scope", "s_nt", "p", "o_nt"]
        after = t
        if op.delete:
            may = reduce(lambda a, b: a | b, [_could_be(x) for x in op.delete])
            after = t.where(~may)
            if not _takes_all(op):
                gone = reduce(DataFrame.unionByName, [_instances(rel, x).select(*keys) for x in op.delete]).distinct()
                after = after.unionByName(t.where(may).join(gone, keys, "left_anti").select(*t.columns))
        if op.insert:
            new = reduce(DataFrame.unionByName, [_instances(rel, x) for x in op.insert])
            after = after.unionByName(new.select(*t.columns)).distinct()
        t = after
    return t


def _takes_all(op: Operation) -> bool:
    """Whether the deletion is of just what the pattern finds, all of it: one statement pattern without a repeated variable."""
    own = [v.name for v in (op.delete[0].s, op.delete[0].p, op.delete[0].o) if isinstance(v, Var)]
    return op.where.parts == op.delete and len(op.delete) == 1 and len(own) == len(set(own))


def _could_be(x: Triple) -> Column:
    tests = [F.lit(True)]
    if isinstance(x.s, Term):
        tests.append(F.col("s_nt") == spelled(x.s))
    if isinstance(x.p, Term):
        tests.append(F.col("p") == x.p.text)
    if isinstance(x.o, Term):
        tests.append(F.col("o_nt") == spelled(x.o))
    return reduce(lambda a, b: a & b, tests)


def _instances(rel: Rel, x: Triple) -> DataFrame:
    """The statements that a template makes of solutions; where a part is unbound or cannot stand there, none."""
    s, p, o = (evaluate(v, rel) for v in (x.s, x.p, x.o))
    out = rel.df.where(s.nt.isNotNull() & o.nt.isNotNull() & (s.kind != LITERAL) & (p.kind == IRI))
    return out.select("scope", s.text.alias("s"), s.kind.alias("s_kind"), p.text.alias("p"), o.text.alias("o"), o.kind.alias("o_kind"), o.dt.alias("o_dt"), o.lang.alias("o_lang"), s.nt.alias("s_nt"), o.nt.alias("o_nt"))
