"""RDF/XML (RDF 1.1): a strict reader that follows a document's events and keeps only the open elements.

The whole grammar is read: nodes with types, rdf:about, rdf:ID and rdf:nodeID, property attributes, rdf:li,
the parse types Resource, Collection and Literal (in exclusive canonical form), xml:base, xml:lang, and
statements named by rdf:ID. What the grammar does not allow is an error, as are relative IRIs without a
base, a repeated rdf:ID and attributes without a namespace. External entities are not fetched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urldefrag
from xml.parsers import expat

from graphwarden.functions.terms import BNODE, IRI, LITERAL, RDF, XSD
from graphwarden.sources.turtle import TurtleError, resolved

XML = "http://www.w3.org/XML/1998/namespace"
#: Names of the syntax, which name neither nodes nor properties, and names of its older forms.
SYNTAX = {"RDF", "ID", "about", "parseType", "resource", "nodeID", "datatype"}
OLD = {"aboutEach", "aboutEachPrefix", "bagID"}
CHUNK = 1 << 16
_NAME = re.compile(r"[^\W\d][\w.\-·]*\Z")
_BAD_IRI = re.compile(r'[\x00-\x20<>"{}|^`\\]')
_BLANK = re.compile(r"[ \t\r\n]*\Z")


@dataclass
class Frame:
    """An open element: a node with its counter of rdf:li, or a property with what it has met."""

    kind: str  # document, rdf, node, property, resource, collection, literal
    base: str
    lang: str
    subject: tuple[str, str] = ("", "")
    predicate: str = ""
    lis: int = 0
    reify: str = ""
    datatype: str = ""
    object: tuple | None = None  # given by attributes or a child node
    plain: bool = True  # text may stand here
    text: list[str] = field(default_factory=list)
    items: list[tuple[str, str]] = field(default_factory=list)
    drawn: list[dict[str, str]] = field(default_factory=list)  # of a literal: namespaces written so far, by depth


class Reader:
    """Events to statements (s, s_kind, p, o, o_kind, o_dt, o_lang), taken from `out` between chunks."""

    def __init__(self, base: str, module: str):
        self.module, self.made, self.ids, self.out = module, 0, set(), []
        self.stack = [Frame("document", base, "")]
        self.parser = p = expat.ParserCreate(namespace_separator=" ")
        p.namespace_prefixes = p.buffer_text = p.ordered_attributes = True
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = self.start, self.end, self.text
        p.ExternalEntityRefHandler = lambda *_: 0
        p.ProcessingInstructionHandler = lambda target, data: self.raw(f"<?{target}{' ' + data if data else ''}?>")

    def fail(self, why: str):
        raise TurtleError(f"{self.module}, line {self.parser.CurrentLineNumber}: {why}")

    def statements(self, content: bytes) -> Iterator[list[tuple]]:
        """Statements of each chunk of the document."""
        for at in range(0, len(content) + 1, CHUNK):
            try:
                self.parser.Parse(content[at : at + CHUNK], at + CHUNK > len(content))
            except expat.ExpatError as e:
                raise TurtleError(f"{self.module}: {e}") from e
            found, self.out = self.out, []
            yield found

    def iri(self, text: str, base: str) -> str:
        found = resolved(urldefrag(base)[0], text)
        if _BAD_IRI.search(found) or not re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", found):
            self.fail(f"bad IRI {found!r}")
        return found

    def name(self, text: str, what: str) -> str:
        if not _NAME.match(text):
            self.fail(f"{what} is no name: {text!r}")
        return text

    def id(self, text: str, base: str) -> str:
        found = self.iri("#" + self.name(text, "rdf:ID"), base)
        if found in self.ids:
            self.fail(f"rdf:ID {text!r} is there twice")
        self.ids.add(found)
        return found

    def bnode(self, label: str | None = None) -> tuple[str, str]:
        if label is None:
            self.made += 1
            return f"{self.module}#genid.{self.made}", BNODE
        return f"{self.module}#{self.name(label, 'rdf:nodeID')}", BNODE

    def tell(self, s: tuple[str, str], p: str, o: tuple, reify: str = "") -> None:
        self.out.append((*s, p, *o))
        if reify:
            for name, value in (("subject", (*s, "", "")), ("predicate", (p, IRI, "", "")), ("object", o)):
                self.out.append((reify, IRI, RDF + name, *value))
            self.out.append((reify, IRI, RDF + "type", RDF + "Statement", IRI, "", ""))

    def literal(self, value: str, lang: str) -> tuple:
        return (value, LITERAL, RDF + "langString", lang) if lang else (value, LITERAL, XSD + "string", "")

    def start(self, name: str, given: list[str]) -> None:
        top = self.stack[-1]
        if top.kind == "literal":
            self.draw(top, name, given)
            return
        space, _, rest = name.partition(" ")
        if not rest:
            self.fail(f"element {name!r} has no namespace")
        tag, base, lang, rdf, others = space + rest.split(" ")[0], top.base, top.lang, {}, []
        for key, value in zip(given[::2], given[1::2]):
            space, _, rest = key.partition(" ")
            local = rest.split(" ")[0]
            if not rest:
                if key.lower().startswith("xml"):
                    continue
                self.fail(f"attribute {key!r} has no namespace")
            if space == XML:
                base = self.iri(value, base) if local == "base" else base
                lang = value.lower() if local == "lang" else lang
            elif space == RDF and local in SYNTAX:
                rdf[local] = value
            elif space == RDF and local in OLD | {"li", "Description"}:
                self.fail(f"attribute rdf:{local} is not allowed")
            else:
                others.append((space + local, value))
        if top.kind == "document" and tag == RDF + "RDF":
            if rdf or others:
                self.fail("rdf:RDF has attributes")
            self.stack.append(Frame("rdf", base, lang))
        elif top.kind in ("node", "resource"):
            self.property(top, tag, base, lang, rdf, others)
        else:
            self.node(top, tag, base, lang, rdf, others)

    def node(self, top: Frame, tag: str, base: str, lang: str, rdf: dict, others: list) -> None:
        if tag in {RDF + x for x in SYNTAX | OLD | {"li"}}:
            self.fail(f"{tag} is no node")
        if top.kind == "property" and (top.object is not None or not top.plain or not _BLANK.match("".join(top.text)) or top.datatype):
            self.fail("a property has more than one node, or a node beside other things")
        if len(rdf) > 1 or not set(rdf) <= {"about", "ID", "nodeID"}:
            self.fail(f"a node has {sorted(rdf)}")
        if "about" in rdf:
            subject = (self.iri(rdf["about"], base), IRI)
        elif "ID" in rdf:
            subject = (self.id(rdf["ID"], base), IRI)
        else:
            subject = self.bnode(rdf.get("nodeID"))
        if tag != RDF + "Description":
            self.tell(subject, RDF + "type", (self.iri(tag, base), IRI, "", ""))
        self.attributes(subject, others, base, lang)
        if top.kind == "property":
            top.object, top.text = (*subject, "", ""), []
        elif top.kind == "collection":
            top.items.append(subject)
        self.stack.append(Frame("node", base, lang, subject))

    def attributes(self, subject: tuple[str, str], others: list, base: str, lang: str) -> None:
        for p, value in others:
            self.tell(subject, self.iri(p, base), (self.iri(value, base), IRI, "", "") if p == RDF + "type" else self.literal(value, lang))

    def property(self, top: Frame, tag: str, base: str, lang: str, rdf: dict, others: list) -> None:
        if tag == RDF + "li":
            top.lis += 1
            tag = f"{RDF}_{top.lis}"
        if tag in {RDF + x for x in SYNTAX | OLD | {"Description"}}:
            self.fail(f"{tag} is no property")
        kind, new = rdf.get("parseType"), Frame("property", base, lang, top.subject, self.iri(tag, base))
        if "about" in rdf or (kind is not None and (others or not set(rdf) <= {"ID", "parseType"})) or len({"resource", "nodeID", "datatype"} & set(rdf)) > 1 or ("datatype" in rdf and others):
            self.fail(f"a property has {sorted(rdf)}" + (" and other attributes" if others else ""))
        new.reify = self.id(rdf["ID"], base) if "ID" in rdf else ""
        if kind == "Resource":
            new.kind, node = "resource", self.bnode()
            self.tell(top.subject, new.predicate, (*node, "", ""), new.reify)
            new.subject = node
        elif kind == "Collection":
            new.kind = "collection"
        elif kind is not None:  # any other parse type is read as Literal
            new.kind = "literal"
        elif "datatype" in rdf:
            new.datatype = self.iri(rdf["datatype"], base)
        elif {"resource", "nodeID"} & set(rdf) or others:
            node = (self.iri(rdf["resource"], base), IRI) if "resource" in rdf else self.bnode(rdf.get("nodeID"))
            self.attributes(node, others, base, lang)
            new.object, new.plain = (*node, "", ""), False
        self.stack.append(new)

    def text(self, data: str) -> None:
        top = self.stack[-1]
        if top.kind == "literal":
            self.raw(data.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\r", "&#xD;"))
        elif top.kind == "property" and top.object is None:
            top.text.append(data)
        elif not _BLANK.match(data) or (top.kind == "property" and not top.plain):
            self.fail(f"text where none may stand: {data[:20]!r}")

    def end(self, name: str) -> None:
        top = self.stack[-1]
        if top.kind == "literal" and top.drawn:
            top.drawn.pop()
            _, local, *prefix = name.split(" ") if " " in name else ("", name)
            self.raw(f"</{prefix[0] + ':' if prefix else ''}{local}>")
            return
        self.stack.pop()
        if top.kind == "property":
            text = "".join(top.text)
            self.tell(top.subject, top.predicate, top.object or ((text, LITERAL, top.datatype, "") if top.datatype else self.literal(text, top.lang)), top.reify)
        elif top.kind == "literal":
            self.tell(top.subject, top.predicate, ("".join(top.text), LITERAL, RDF + "XMLLiteral", ""), top.reify)
        elif top.kind == "collection":
            nodes = [self.bnode() for _ in top.items]
            rests = [*nodes[1:], (RDF + "nil", IRI)]
            self.tell(top.subject, top.predicate, (*(nodes[0] if nodes else rests[0]), "", ""), top.reify)
            for node, item, rest in zip(nodes, top.items, rests):
                self.tell(node, RDF + "first", (*item, "", ""))
                self.tell(node, RDF + "rest", (*rest, "", ""))

    def raw(self, text: str) -> None:
        if self.stack[-1].kind == "literal":
            self.stack[-1].text.append(text)

    def draw(self, top: Frame, name: str, given: list[str]) -> None:
        """A start tag inside an XML literal, in exclusive canonical form: a namespace is declared where it is first used."""

        def parts(x: str) -> tuple[str, str, str]:
            space, local, prefix = [*x.split(" "), ""][:3] if " " in x else ("", x, "")
            return space, local, prefix

        space, local, prefix = parts(name)
        attributes = [(*parts(k), v) for k, v in zip(given[::2], given[1::2])]
        known = dict(top.drawn[-1]) if top.drawn else {"": ""}
        used = {prefix: space} | {p: s for s, _, p, _ in attributes if p and s != XML}
        fresh = {p: s for p, s in used.items() if known.get(p) != s and s != XML}

        def quoted(v: str) -> str:
            for a, b in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;"), ("\t", "&#x9;"), ("\n", "&#xA;"), ("\r", "&#xD;")):
                v = v.replace(a, b)
            return f'"{v}"'

        spaces = "".join(f" xmlns{':' + p if p else ''}={quoted(s)}" for p, s in sorted(fresh.items()))
        own = "".join(f" {('xml' if s == XML else p) + ':' if s else ''}{n}={quoted(v)}" for s, n, p, v in sorted(attributes))
        self.raw(f"<{prefix + ':' if prefix else ''}{local}{spaces}{own}>")
        top.drawn.append(known | fresh)


def parse(content: bytes, base: str, module: str) -> Iterator[list[tuple]]:
    """Statements of a document, by chunks."""
    return Reader(base, module).statements(content)
