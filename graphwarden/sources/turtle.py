"""Turtle, N-Triples and RDF/XML: strict readers that run on executors; N-Triples and large Turtle files in as many tasks as they have splits."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphwarden.functions.terms import BNODE, IRI, LITERAL, RDF, TRIPLE_FIELDS, XSD, once, spelling, strict_fault
from graphwarden.operators.closure import checkpointed
from graphwarden.sources.files import syntax


def _lexer(long: str) -> re.Pattern:
    return re.compile(
        r"""(?P<skip>\s+|\#[^\n\r]*)
  | (?P<iri><(?:[^\x00-\x20<>"{}|^`\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)
  | """ + long + r"""
  | (?P<string>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
  | (?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  | (?P<bnode>_:[\w](?:[\w.\-\u00b7]*[\w\-\u00b7])?)
  | (?P<number>[+-]?(?:[0-9]+\.[0-9]*[eE][+-]?[0-9]+|\.?[0-9]+[eE][+-]?[0-9]+|[0-9]*\.[0-9]+|[0-9]+))
  | (?P<name>(?:[^\W\d_](?:[\w.\-\u00b7]*[\w\-\u00b7])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w:.\-\u00b7]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w:\-\u00b7]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
  | (?P<word>[A-Za-z]+)
  | (?P<mark>\^\^|[.;,\[\]()])""",
        re.VERBOSE | re.DOTALL,
    )


_TOKEN = _lexer(r"""(?P<long>\"{3}(?:"{0,2}(?:[^"\\]|\\.))*\"{3}|'{3}(?:'{0,2}(?:[^'\\]|\\.))*'{3})""")
#: As _TOKEN, but of a long string only the opening marks.
SCAN = _lexer(r"""(?P<open>\"{3}|'{3})""")
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.DOTALL)
_PLAIN = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


class TurtleError(ValueError):
    pass


def unescape(text: str) -> str:
    def one(m):
        if m[1] or m[2]:
            return chr(int(m[1] or m[2], 16))
        if m[3] not in _PLAIN:
            raise TurtleError(f"bad escape \\{m[3]}")
        return _PLAIN[m[3]]

    return _ESCAPE.sub(one, text) if "\\" in text else text


def resolved(base: str, iri: str) -> str:
    """iri, which may be relative, against a base."""
    return iri if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", iri) else urljoin(base, iri) if iri else base


class Parser:
    """Statements of one text, or of a piece of one: then with the prefixes in force, a start for the names of its own nodes, and its first line. Blank nodes get the module's name, so they meet those of no other file."""

    def __init__(self, text: str, base: str, module: str, prefixes: dict[str, str] | None = None, own: str = "genid.", line: int = 1):
        self.base, self.module, self.own, self.line = base, module, own, line
        self.prefixes: dict[str, str] = dict(prefixes or {})
        self.made = 0
        self.out: list[tuple] = []
        self.tokens = self._scan(text)
        self._next()

    def _scan(self, text: str) -> Iterator[tuple[str, str]]:
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                line = text.count("\n", 0, at) + self.line
                raise TurtleError(f"{self.module}, line {line}: cannot read {text[at : at + 20]!r}")
            at = m.end()
            if m.lastgroup != "skip":
                yield m.lastgroup, m.group()
        yield "end", ""

    def _next(self) -> None:
        self.kind, self.text = next(self.tokens)

    def _take(self, mark: str) -> None:
        if self.text != mark or self.kind not in ("mark",):
            raise TurtleError(f"{self.module}: expected {mark!r}, found {self.text!r}")
        self._next()

    def statements(self) -> list[tuple]:
        """(s, s_kind, p, o, o_kind, o_dt, o_lang) of the whole text."""
        while self.kind != "end":
            if self.kind == "at" and self.text in ("@prefix", "@base"):
                what = self.text
                self._next()
                self._directive(what[1:])
                self._take(".")
            elif self.kind == "word" and self.text.upper() in ("PREFIX", "BASE"):
                what = self.text.lower()
                self._next()
                self._directive(what)
            else:
                self._triples()
                self._take(".")
        return self.out

    def _directive(self, what: str) -> None:
        if what == "prefix":
            name = self.text
            if self.kind != "name" or not name.endswith(":"):
                raise TurtleError(f"{self.module}: bad prefix {name!r}")
            self._next()
        if self.kind != "iri":
            raise TurtleError(f"{self.module}: expected an IRI in <>, found {self.text!r}")
        if what == "prefix":
            self.prefixes[name[:-1]] = self._iri()
        else:
            self.base = self._iri()

    def _iri(self) -> str:
        if self.kind == "iri":
            iri = resolved(self.base, unescape(self.text[1:-1]))
            self._next()
            return iri
        if self.kind == "name":
            prefix, _, local = self.text.partition(":")
            if prefix not in self.prefixes:
                raise TurtleError(f"{self.module}: unknown prefix {prefix!r}")
            self._next()
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        raise TurtleError(f"{self.module}: expected an IRI, found {self.text!r}")

    def _bnode(self, label: str | None = None) -> tuple[str, str]:
        if label is None:
            self.made += 1
            label = f"{self.own}{self.made}"
        return f"{self.module}#{label}", BNODE

    def _triples(self) -> None:
        if self.kind == "mark" and self.text == "[":
            subject = self._nested()
            if self.text == "." and self.kind == "mark":
                return
        elif self.kind == "mark" and self.text == "(":
            subject = self._collection()
        elif self.kind == "bnode":
            subject = self._bnode(self.text[2:])
            self._next()
        else:
            subject = (self._iri(), IRI)
        self._properties(subject)

    def _properties(self, subject: tuple[str, str]) -> None:
        while True:
            if self.kind == "word" and self.text == "a":
                self._next()
                predicate = RDF + "type"
            else:
                predicate = self._iri()
            while True:
                self.out.append((*subject, predicate, *self._object()))
                if not (self.kind == "mark" and self.text == ","):
                    break
                self._next()
            if not (self.kind == "mark" and self.text == ";"):
                return
            while self.kind == "mark" and self.text == ";":
                self._next()
            if self.kind == "mark" and self.text in (".", "]"):
                return

    def _nested(self) -> tuple[str, str]:
        self._take("[")
        node = self._bnode()
        if not (self.kind == "mark" and self.text == "]"):
            self._properties(node)
        self._take("]")
        return node

    def _collection(self) -> tuple[str, str]:
        self._take("(")
        items = []
        while not (self.kind == "mark" and self.text == ")"):
            items.append(self._object())
        self._take(")")
        head: tuple = (RDF + "nil", IRI, "", "")
        for item in reversed(items):
            node = self._bnode()
            self.out.append((*node, RDF + "first", *item))
            self.out.append((*node, RDF + "rest", *head))
            head = (*node, "", "")
        return head[:2]

    def _object(self) -> tuple[str, str, str, str]:
        kind, text = self.kind, self.text
        if kind == "mark" and text == "[":
            return (*self._nested(), "", "")
        if kind == "mark" and text == "(":
            return (*self._collection(), "", "")
        if kind == "bnode":
            self._next()
            return (*self._bnode(text[2:]), "", "")
        if kind in ("string", "long"):
            n = 3 if kind == "long" else 1
            value = unescape(text[n:-n])
            self._next()
            if self.kind == "at":
                lang = self.text[1:].lower()
                self._next()
                return value, LITERAL, RDF + "langString", lang
            if self.kind == "mark" and self.text == "^^":
                self._next()
                return value, LITERAL, self._iri(), ""
            return value, LITERAL, XSD + "string", ""
        if kind == "number":
            self._next()
            return text, LITERAL, XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer"), ""
        if kind == "word" and text in ("true", "false"):
            self._next()
            return text, LITERAL, XSD + "boolean", ""
        return self._iri(), IRI, "", ""


def parse(text: str, base: str, module: str) -> list[tuple]:
    return Parser(text, base, module).statements()


RAW = T.StructType([T.StructField(n, T.StringType()) for n in ("module", "s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang", "fault")])


def with_spelling(raw: DataFrame) -> DataFrame:
    """Triples with the N-Triples spelling of their terms."""
    return raw.withColumns({"s_nt": spelling("s"), "o_nt": spelling("o")}).select(*TRIPLE_FIELDS)


#: Statements after which a frame of parsed files is given on, and characters of their objects.
ROWS, CHARS = 50_000, 1 << 22


def _paths(spark: SparkSession, files: list[tuple[str, str]]) -> DataFrame:
    """(path, module), with paths as Spark names them."""
    named = spark.createDataFrame([(p if "://" in p or p.startswith("file:") else "file:" + p, m) for p, m in files], "path string, module string")
    return named.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/"))


def read(spark: SparkSession, files: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """(triples, faults) of (path, module) files; a file with any fault gives no triples.

    Files are read on executors: N-Triples (suffix .nt) line by line in as many tasks as they have splits,
    Turtle files above spark.sql.files.maxPartitionBytes likewise (turtle_splits.py), smaller ones and RDF/XML whole. Strictness covers lexical forms, ranges and the calendar.
    faults: (module, fault), one row for each bad file.
    """
    readers = {"turtle": _turtle, "ntriples": _ntriples, "rdfxml": _rdfxml}
    kinds = [(syntax(p) or "turtle", (p, m)) for p, m in files]
    parts = [reader(spark, found) for kind, reader in readers.items() if (found := [f for k, f in kinds if k == kind])]
    parsed = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], RAW)
    bad = (F.col("o_kind") == LITERAL) & strict_fault(F.col("o_dt"), F.col("o"))
    # parsed and checked once: the table is read for faults and for triples
    parsed = checkpointed(parsed.withColumn("fault", F.coalesce("fault", F.when(bad, F.concat(F.lit("ill-typed literal: "), F.col("o"))))))
    faults = parsed.where("fault IS NOT NULL").groupBy("module").agg(F.min("fault").alias("fault"))
    triples = with_spelling(parsed.where("fault IS NULL")).dropDuplicates()
    return triples.join(F.broadcast(faults.select("module")), "module", "left_anti"), faults  # a row for each bad file


def _turtle(spark: SparkSession, files: list[tuple[str, str]]) -> DataFrame:
    from graphwarden.sources.turtle_splits import read_splits

    content, named = spark.read.format("binaryFile").load([p for p, _ in files]), _paths(spark, files)
    size, unit = re.fullmatch(r"([0-9]+)([kmgt]?)b?", spark.conf.get("spark.sql.files.maxPartitionBytes").strip().lower()).groups()
    most = int(size) << 10 * " kmgt".index(unit or " ")
    large = [r.path for r in content.where(F.col("length") > most).select("path").collect()]  # of the files named, without their content
    whole = whole_files(_named(content.where(~F.col("path").isin(large)), named))
    return whole.unionByName(read_splits(spark, large, named.where(F.col("path").isin([re.sub("^file:/+", "file:/", p) for p in large])))) if large else whole


def _named(content: DataFrame, named: DataFrame) -> DataFrame:
    return content.select(F.regexp_replace("path", "^file:/+", "file:/").alias("path"), "content").join(named, "path")


def _rdfxml(spark: SparkSession, files: list[tuple[str, str]]) -> DataFrame:
    return whole_files(_named(spark.read.format("binaryFile").load([p for p, _ in files]), _paths(spark, files)), True)


def whole_files(rows: DataFrame, xml: bool = False) -> DataFrame:
    """Rows of RAW of files (path, content, module), each a task's. Statements of small files share a frame."""

    def run(batches):
        import pandas as pd

        from graphwarden.sources import rdfxml

        def frames():
            """Lists of rows, none of them long."""
            for pdf in batches:
                for path, content_, module in zip(pdf["path"], pdf["content"], pdf["module"], strict=True):
                    try:
                        for found in rdfxml.parse(bytes(content_), path, module) if xml else [parse(bytes(content_).decode("utf-8-sig"), path, module)]:
                            for i in range(0, len(found), ROWS):
                                yield [(module, *t, None) for t in found[i : i + ROWS]]
                    except (TurtleError, UnicodeDecodeError) as e:
                        yield [(module, *[None] * 7, str(e))]

        kept, chars = [], 0
        for some in frames():
            kept += some
            chars += sum(len(r[4] or "") for r in some)
            if len(kept) >= ROWS or chars >= CHARS:
                yield pd.DataFrame(kept, columns=RAW.names)
                kept, chars = [], 0
        if kept:
            yield pd.DataFrame(kept, columns=RAW.names)

    return rows.select("path", "content", "module").mapInPandas(run, RAW)


# possessive, so that a long text costs no stack
_IRI = r"<(?:[^\x00-\x20<>\"{}|^`\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*+>"
_BLANK = r"_:[\p{L}\p{N}_](?:[\p{L}\p{N}_.\-\u00b7]*[\p{L}\p{N}_\-\u00b7])?"
# runs of plain characters by one class, so that only an escape costs a group
_TEXT = r"\"[^\"\\\n\r]*+(?:\\(?:[tbnrf\"'\\]|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8})[^\"\\\n\r]*+)*+\""
_SUBJECT = rf"^[ \t]*({_IRI}|{_BLANK})"
_PREDICATE = rf"^[ \t]*(?:{_IRI}|{_BLANK})[ \t]*({_IRI})"
_LINE = rf"^[ \t]*({_IRI}|{_BLANK})[ \t]*({_IRI})[ \t]*({_IRI}|{_BLANK}|{_TEXT}(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^{_IRI})?)[ \t]*\.[ \t]*(?:#.*)?$"


def unescaped(text: Column) -> Column:
    """N-Triples escapes undone. Between two escaped backslashes, and after a `\\u`, a piece has no other one's start in it."""

    def points(piece: Column, mark: str, size: int, charset: str) -> Column:
        def joined(pieces: Column) -> Column:
            rest = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda x: F.concat(F.decode(F.unhex(F.substring(x, 1, size)), charset), F.substr(x, F.lit(size + 1))))
            return F.concat(F.get(pieces, F.lit(0)), F.array_join(rest, ""))

        return F.transform(F.array(F.split(piece, mark)), joined)[0]  # the pieces are made once

    def plain(piece: Column) -> Column:
        for code, char in (("t", "\t"), ("b", "\b"), ("n", "\n"), ("r", "\r"), ("f", "\f"), ('"', '"'), ("'", "'")):
            piece = F.replace(piece, F.lit("\\" + code), F.lit(char))
        # characters beyond the first plane are written as one \U
        return points(points(piece, r"\\u", 4, "UTF-16BE"), r"\\U", 8, "UTF-32")

    return F.when(~text.contains("\\"), text).otherwise(F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\"))


def _ntriples(spark: SparkSession, files: list[tuple[str, str]]) -> DataFrame:
    """Rows of RAW, by Spark's own text reader: a file of any size is split, and nothing runs in Python."""
    read_ = spark.read.option("lineSep", "\n").text([p for p, _ in files]).select(F.regexp_replace("value", "\r$", "").alias("value"), F.regexp_replace(F.input_file_name(), "^file:/+", "file:/").alias("path"))
    return statements(read_.join(F.broadcast(_paths(spark, files)), "path"))  # a row for each file


def statements(text: DataFrame) -> DataFrame:
    """Rows of RAW from N-Triples lines (module, value). A line that is no statement is a fault of its module.

    A line is matched once, as a whole; its ends are short and are read from there. The last quotation mark of an object ends its text, as what follows has none.
    """
    lines = once(text.select("module", F.col("value").alias("line")), F.col("line").alias("value")).where(~F.col("value").rlike(r"^[ \t]*(#.*)?$"))
    parts = once(lines, F.regexp_extract("value", _LINE, 3).alias("o"))
    good, literal = F.col("o") != "", F.col("o").startswith('"')
    parts = once(parts, *[F.when(good, F.regexp_extract("value", head, 1)).otherwise("").alias(n) for n, head in (("s", _SUBJECT), ("p", _PREDICATE))], F.when(literal, F.substring_index("o", '"', -1)).otherwise("").alias("tail"))
    lang = F.when(F.col("tail").startswith("@"), F.substr("tail", F.lit(2))).otherwise("")
    dt = F.when(F.col("tail").startswith("^"), F.substr("tail", F.lit(3))).otherwise("")

    def iri(c: Column) -> Column:
        return unescaped(F.substr(c, F.lit(2), F.length(c) - 2))

    def node(c: Column) -> Column:
        return F.when(c.startswith("_:"), F.concat("module", F.lit("#"), F.substr(c, F.lit(3)))).otherwise(iri(c))

    def kind(c: Column) -> Column:
        return F.when(c.startswith("_:"), BNODE).otherwise(IRI)

    relative = F.array_contains(F.transform(F.array("s", "p", F.when(~literal, F.col("o")).otherwise(dt)), lambda x: x.startswith("<") & ~x.rlike(r"^<[A-Za-z][A-Za-z0-9+.\-]*:")), True)
    fault = F.when(~good, F.concat(F.lit("no statement: "), "value")).when(relative, F.concat(F.lit("relative IRI: "), "value"))
    told = (
        F.when(good, node(F.col("s"))).alias("s"),
        kind(F.col("s")).alias("s_kind"),
        F.when(good, iri(F.col("p"))).alias("p"),
        F.when(literal, unescaped(F.substr(F.col("o"), F.lit(2), F.length("o") - F.length("tail") - 2))).when(good, node(F.col("o"))).alias("o"),
        F.when(literal, LITERAL).otherwise(kind(F.col("o"))).alias("o_kind"),
        F.when(~literal, "").when(lang != "", RDF + "langString").when(dt != "", iri(dt)).otherwise(XSD + "string").alias("o_dt"),
        F.when(literal, F.lower(lang)).otherwise("").alias("o_lang"),
        fault.alias("fault"),
    )
    return parts.select("module", F.inline(F.array(F.struct(*told))))
