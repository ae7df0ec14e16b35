"""Syntaxes of triples: Turtle in splits against the same text in one piece, RDF/XML against Turtle."""

import itertools

import pytest

from graphwarden import sinks
from graphwarden.sources import files, rdfxml, turtle
from graphwarden.sources import turtle_splits as ts

TEXT = '''@prefix p: <http://p/> . # "a comment" with \'\'\' and """
@base <http://b/> .
<x> p:s "a.b", \'c # d\', """long " . "" \\""" @prefix p: <no> .
e:no \'\'\' . """ ; p:n [ p:q 1.5 , 2 ; p:r ( p:z\\,k "é" ) ] .
PREFIX p:
  <http://q/> BASE <sub/> p:a.b p:c \'\'\'x " """ .
\'\' y\'\'\'@en , "prefix"@prefix .
<y> a
p:C
. _:n p:o _:m . @prefix r: <rel#>
. r:a r:b "base", -3e2 , true .
[ p:q "" ; p:r """""" ] . # end'''


def shape(rows):
    """Triples with their blank nodes named by order: no two statements of TEXT differ by these alone."""
    names, out = {}, []
    for row in rows:
        out.append(tuple(names.setdefault(v, len(names)) if "#" in v and v.startswith("m#") else v for v in row))
    return out


def by_splits(text: bytes, cuts, size=1):
    """The stages of read_splits in one process; a split has the lines that begin in it."""
    starts = list(itertools.accumulate((len(x) + 1 for x in text.split(b"\n")), initial=0))
    lines = dict(zip(starts, text.split(b"\n")))
    edges = [0, *cuts, len(text) + 1]
    blocks = [(a, [lines[s] + b"\n" for s in sorted(lines) if a <= s < b]) for a, b in zip(edges, edges[1:])]
    blocks = [(a, [x.decode() for x in found]) for a, found in blocks if found]
    known = list(ts.composed((a, *ts.states(found)) for a, found in blocks))
    pieces, torn = {}, {}
    for (a, state, home, line, first), (_, found) in zip(known, blocks):
        for home_, n, line_, whole, piece in ts.cut(found, a, state, home, line, first, size):
            if whole:
                pieces[a, n] = line_, piece
            else:
                torn.setdefault(home_, []).append((a, n, line_, piece))
    for home, parts in torn.items():
        pieces[home, 1 << 40] = min(parts)[2], "".join(p[3] for p in sorted(parts))
    force = list(ts.folded("urn:x", ((*k, d) for k, (_, x) in sorted(pieces.items()) if (d := ts.directives(x)))))
    out = []
    for k, (line, piece) in sorted(pieces.items()):
        base, prefixes = [f[2:] for f in force if f[:2] < k][-1]
        out += turtle.Parser(piece, base, "m", prefixes, f"genid.{k[0]}.{k[1]}.", line).statements()
    return out


@pytest.mark.parametrize("text", [TEXT, TEXT.replace("\n", "\r\n")])
def test_turtle_cut_at_every_byte(text):
    whole = shape(turtle.parse(text, "urn:x", "m"))
    raw = text.encode()
    assert len(whole) > 15
    for at in range(1, len(raw)):
        assert shape(by_splits(raw, [at])) == whole
    for step in (1, 7, 20, 45):
        for size in (1, 100):
            assert shape(by_splits(raw, range(step, len(raw), step), size)) == whole


def test_faults_of_splits():
    for bad in ("<a> <b> 'x", '<a> <b> """x', "<a> ~ <c> .", "q:x <b> <c> .", "@prefix p: q:r . <a> <b> <c> .", "<a> <b> <c>"):
        text = ("<urn:a> <urn:b> 'x' .\n" * 3 + bad + "\n" + "<urn:a> <urn:b> 'y' .\n").encode()
        with pytest.raises(turtle.TurtleError):
            turtle.parse(text.decode(), "urn:x", "m")
        for at in range(1, len(text)):
            with pytest.raises(turtle.TurtleError):
                by_splits(text, [at])
    with pytest.raises(turtle.TurtleError, match="line 4"):
        by_splits(b"<urn:a> <urn:b> 'x' .\n" * 3 + b"<a> ~ <c> .\n", [30])


def test_large_turtle_is_read_in_splits(spark, tmp_path):
    body = "".join(f'<x{i}> p:s """v {i}\n. {"z" * (i % 90)}""" ; p:t [ p:u {i} ] .\n' for i in range(400))
    text = "\ufeff" + TEXT + "\n@prefix p: <http://late/> .\n" + body
    for name, content in (("large.ttl", text), ("small.ttl", TEXT), ("bad.ttl", text + "<a> <b> 'x"), ("bytes.ttl", None)):
        (tmp_path / name).write_bytes(content.encode() if content is not None else text.encode() + b"<a> <b> '\xff' .")
    names = [(str(tmp_path / n), n) for n in ("large.ttl", "small.ttl", "bad.ttl", "bytes.ttl")]
    columns = ["module", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang"]

    def read():
        triples, faults = turtle.read(spark, names)
        rows = triples.where("o_kind <> 'bnode'").select(*columns).collect()
        return sorted(rows), triples.where("o_kind = 'bnode'").groupBy("module", "p").count().orderBy("module", "p").collect(), sorted(r.module for r in faults.collect())

    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    whole = read()
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")
        split = read()
        named = turtle._paths(spark, names[:1])
        shuffled = ts.read_splits(spark, [names[0][0]], named, splits=0)
        assert shuffled.where("fault IS NULL").count() == ts.read_splits(spark, [names[0][0]], named).where("fault IS NULL").count() >= 1200
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert split == whole and whole[2] == ["bad.ttl", "bytes.ttl"] and len(whole[0]) > 800


XML_HEAD = """<?xml version="1.0"?>
<!DOCTYPE rdf:RDF [<!ENTITY q "http://q/">]>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:p="http://p/" xml:base="http://b/dir/file">
"""
TTL_HEAD = "@prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> . @prefix p: <http://p/> . @base <http://b/dir/file> . @prefix x: <http://www.w3.org/2001/XMLSchema#> .\n"
#: The same graphs in RDF/XML and in Turtle.
GRAPHS = [
    ('<p:C rdf:about="a" p:s="v" xml:lang="EN"><p:t>x &amp; y</p:t><p:t xml:lang="">z</p:t><p:u rdf:resource="&q;o"/></p:C>', '<a> a p:C ; p:s "v"@en ; p:t "x & y"@en , "z" ; p:u <http://q/o> .'),
    ('<rdf:Description rdf:ID="i"><p:n rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">7</p:n><p:e/><p:d rdf:datatype="http://p/dt"></p:d></rdf:Description>', '<#i> p:n 7 ; p:e "" ; p:d ""^^p:dt .'),
    ('<rdf:Description rdf:about=""><p:k><p:D rdf:nodeID="n1"><p:in rdf:nodeID="n2"/></p:D></p:k><p:m rdf:nodeID="n2" p:s="w"/></rdf:Description>', '<> p:k _:n1 ; p:m _:n2 . _:n1 a p:D ; p:in _:n2 . _:n2 p:s "w" .'),
    ('<rdf:Seq rdf:about="s"><rdf:li>1</rdf:li><rdf:_9>9</rdf:_9><rdf:li rdf:resource="r"/></rdf:Seq>', '<s> a rdf:Seq ; rdf:_1 "1" ; rdf:_9 "9" ; rdf:_2 <r> .'),
    ('<rdf:Description rdf:about="l"><p:list rdf:parseType="Collection"><rdf:Description rdf:about="1"/><p:C rdf:about="2"/></p:list><p:none rdf:parseType="Collection"/></rdf:Description>', '<l> p:list ( <1> <2> ) ; p:none () . <2> a p:C .'),
    ('<rdf:Description rdf:about="r"><p:v rdf:parseType="Resource"><p:w>1</p:w><p:z xml:base="http://z/" rdf:resource="y"/></p:v></rdf:Description>', '<r> p:v [ p:w "1" ; p:z <http://z/y> ] .'),
    ('<rdf:Description rdf:about="f"><p:g rdf:ID="st">o</p:g></rdf:Description>', '<f> p:g "o" . <#st> a rdf:Statement ; rdf:subject <f> ; rdf:predicate p:g ; rdf:object "o" .'),
    ('<rdf:Description rdf:about="h" rdf:type="t"><p:x rdf:parseType="Literal">a<p:b z="1" p:y="&lt;"/> <c xmlns="http://c/"><d/></c>&amp;</p:x></rdf:Description>', "<h> a <t> ; p:x 'a<p:b xmlns:p=\"http://p/\" z=\"1\" p:y=\"&lt;\"></p:b> <c xmlns=\"http://c/\"><d></d></c>&amp;'^^rdf:XMLLiteral ."),
]
BAD_XML = [
    '<rdf:Description about="a"/>', '<rdf:li/>', '<rdf:Description rdf:about="a" rdf:ID="b"/>', '<rdf:Description rdf:ID="1"/>', '<rdf:Description rdf:ID="a"/><rdf:Description rdf:ID="a"/>',
    '<rdf:Description><p:a><p:B/><p:B/></p:a></rdf:Description>', '<rdf:Description><p:a>x<p:B/></p:a></rdf:Description>', '<rdf:Description><p:a rdf:resource="b">x</p:a></rdf:Description>',
    '<rdf:Description><p:a rdf:resource="b" rdf:nodeID="c"/></rdf:Description>', '<rdf:Description><rdf:Description/></rdf:Description>', '<rdf:Description rdf:bagID="b"/>', "text", "<p:A>", '<rdf:Description rdf:about="a b"/>',
    '<rdf:Description><p:a><p:B/>x</p:a></rdf:Description>', '<rdf:Description><p:a rdf:parseType="Resource" p:b="c"/></rdf:Description>', '<A/>',
]


def same(a, b):
    """Whether two small graphs are equal but for the names of their blank nodes."""
    names = [sorted({t[i] for t in g for i in (0, 3) if t[i + 1] == "bnode"}) for g in (a, b)]
    if len(names[0]) != len(names[1]) or len(set(a)) != len(set(b)):
        return False
    for order in itertools.permutations(names[1]):
        to = dict(zip(names[0], order))
        if {(to.get(t[0], t[0]), *t[1:3], to.get(t[3], t[3]), *t[4:]) for t in a} == set(b):
            return True
    return False


def test_rdfxml_agrees_with_turtle():
    for xml, ttl in GRAPHS:
        found = [t for chunk in rdfxml.parse((XML_HEAD + xml + "</rdf:RDF>").encode(), "urn:x", "m") for t in chunk]
        assert same(found, turtle.parse(TTL_HEAD + ttl, "urn:x", "m")), (xml, found)
    alone = [t for chunk in rdfxml.parse(b'<p:C xmlns:p="http://p/"/>', "urn:x", "m") for t in chunk]
    assert [t[3] for t in alone] == ["http://p/C"]


def test_rdfxml_is_strict():
    for bad in BAD_XML:
        with pytest.raises(turtle.TurtleError):
            list(rdfxml.parse((XML_HEAD + bad + "</rdf:RDF>").encode(), "urn:x", "m"))
    for bad in (b"", b"<a/>", b'<!DOCTYPE x [<!ENTITY e SYSTEM "file:///etc/hostname">]><p:C xmlns:p="http://p/"><p:a>&e;</p:a></p:C>'):
        with pytest.raises(turtle.TurtleError):
            list(rdfxml.parse(bad, "urn:x", "m"))


def test_rdfxml_is_read_in_chunks():
    body = "".join(f'<rdf:Description rdf:about="{i}"><p:s>é {i}</p:s></rdf:Description>' for i in range(4000))
    chunks = list(rdfxml.parse((XML_HEAD + body + "</rdf:RDF>").encode(), "urn:x", "m"))
    found = [t for c in chunks for t in c]
    assert len(chunks) > 3 and max(map(len, chunks)) < 2000
    assert [(t[0], t[3]) for t in found] == [(f"http://b/dir/{i}", f"é {i}") for i in range(4000)]


def test_rdfxml_modules(spark, tmp_path):
    (tmp_path / "g.rdf").write_text(XML_HEAD + "".join(xml for xml, _ in GRAPHS[:4]) + '<p:C rdf:about="n"><p:t xml:lang="de">a\tb\n&quot;&lt;&amp;&#13;</p:t></p:C></rdf:RDF>')
    (tmp_path / "bad.owl").write_text(XML_HEAD)
    (tmp_path / "ill.xml").write_text(XML_HEAD + '<rdf:Description><p:n rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">x</p:n></rdf:Description></rdf:RDF>')
    (tmp_path / "same.rdf").write_text((tmp_path / "g.rdf").read_text())
    found = files.discover([str(tmp_path)])
    assert [f.rsplit("/", 1)[1] for f in found] == ["bad.owl", "g.rdf", "ill.xml", "same.rdf"]
    triples, faults = turtle.read(spark, [(f, f.rsplit("/", 1)[1]) for f in found])
    assert sorted(r.module for r in faults.collect()) == ["bad.owl", "ill.xml"]
    before = triples.where("module IN ('g.rdf', 'same.rdf')").persist()
    after = before.where("NOT (module = 'g.rdf' AND p LIKE '%/u')")
    changed = sinks.publish_copies(before, after, {n: str(tmp_path / n) for n in ("g.rdf", "same.rdf")}, str(tmp_path / "out"))
    assert changed == ["g.rdf"] and (tmp_path / "out" / "same.rdf").read_bytes() == (tmp_path / "same.rdf").read_bytes()
    again, faults = turtle.read(spark, [(str(tmp_path / "out" / "g.rdf"), "g.rdf")])
    columns = ["s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang"]
    rows = [[tuple(r) for r in t.where("module = 'g.rdf'").select(*columns).collect()] for t in (after, again)]
    assert faults.isEmpty() and same(*rows) and len(rows[0]) > 15 and before.where("module = 'g.rdf'").count() == len(rows[0]) + 1
