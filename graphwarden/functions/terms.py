"""RDF terms as flat string columns, and the functions of the rules over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
DCT = "http://purl.org/dc/terms/"
XSD = "http://www.w3.org/2001/XMLSchema#"
SH = "http://www.w3.org/ns/shacl#"
CRM = "http://www.cidoc-crm.org/cidoc-crm/"
TYPE = RDF + "type"
STANDARD_NAMESPACES = (RDF, RDFS, OWL, SKOS, DCT)

IRI, BNODE, LITERAL = "iri", "bnode", "literal"
#: One row for each statement of each module; '' where a datatype or language does not apply.
TRIPLE_FIELDS = ("module", "s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang", "s_nt", "o_nt")
TRIPLES = T.StructType([T.StructField(c, T.StringType(), False) for c in TRIPLE_FIELDS])

#: Lexical forms of the checked datatypes (no calendar check).
LEXICAL = {
    "date": r"-?[0-9]{4,}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])(Z|[+-][0-9]{2}:[0-9]{2})?",
    "dateTime": r"-?[0-9]{4,}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]([.][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?",
    "integer": r"[+-]?[0-9]+",
    "decimal": r"[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)",
    "double": r"([+-]?(([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?|INF)|NaN)",
    "boolean": r"(true|false|0|1)",
}


def ill_typed(datatype: Column, lexical: Column) -> Column:
    """Whether a literal's lexical form is outside its datatype's. \\z: `$` would pass a trailing line feed."""
    cases = [(datatype == XSD + name) & ~lexical.rlike(rf"^(?:{form})\z") for name, form in LEXICAL.items()]
    return reduce(lambda a, b: a | b, cases)


_ZONE = r"(Z|[+-](0[0-9]|1[0-3]):[0-5][0-9]|[+-]14:00)?"
_TIME = r"(([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]([.][0-9]+)?|24:00:00([.]0+)?)"
_MONTH, _DAY = r"(0[1-9]|1[0-2])", r"(0[1-9]|[12][0-9]|3[01])"
_TIMES = r"(T(?=[0-9])([0-9]+H)?([0-9]+M)?([0-9]+([.][0-9]+)?S)?)"
#: Forms of the other XSD datatypes, which only a strict parser looks at.
STRICT = {
    "float": LEXICAL["double"],
    "time": _TIME + _ZONE,
    "dateTimeStamp": rf"-?[0-9]{{4,}}-{_MONTH}-{_DAY}T{_TIME}(Z|[+-][0-9]{{2}}:[0-9]{{2}})",
    "gYear": r"-?([1-9][0-9]{3,}|0[0-9]{3})" + _ZONE,
    "gYearMonth": rf"-?([1-9][0-9]{{3,}}|0[0-9]{{3}})-{_MONTH}{_ZONE}",
    "gMonth": rf"--{_MONTH}{_ZONE}",
    "gMonthDay": rf"--({_MONTH}-(0[1-9]|1[0-9]|2[0-9])|(0[13-9]|1[0-2])-30|(0[13578]|1[02])-31){_ZONE}",
    "gDay": rf"---{_DAY}{_ZONE}",
    "duration": rf"-?P(?=[0-9T])([0-9]+Y)?([0-9]+M)?([0-9]+D)?{_TIMES}?",
    "dayTimeDuration": rf"-?P(?=[0-9T])([0-9]+D)?{_TIMES}?",
    "yearMonthDuration": r"-?P(?=[0-9])([0-9]+Y)?([0-9]+M)?",
    "hexBinary": r"([0-9A-Fa-f]{2})*",
    "base64Binary": r"(([A-Za-z0-9+/] ?){4})*(([A-Za-z0-9+/] ?){2}[AEIMQUYcgkosw048] ?=|([A-Za-z0-9+/] ?)[AQgw] ?= ?=)?",
    "language": r"[A-Za-z]{1,8}(-[A-Za-z0-9]{1,8})*",
    "normalizedString": r"[^\t\n\r]*",
    "token": r"([^\t\n\r ]+( [^\t\n\r ]+)*)?",
    "NMTOKEN": r"[\p{L}\p{N}.\-_:\u00b7]+",
    "Name": r"[\p{L}_:][\p{L}\p{N}.\-_:\u00b7]*",
    "NCName": r"[\p{L}_][\p{L}\p{N}.\-_\u00b7]*",
}
#: Least and greatest value of the whole-number datatypes; None where there is none.
RANGES = {
    "byte": (-128, 127),
    "short": (-(2**15), 2**15 - 1),
    "int": (-(2**31), 2**31 - 1),
    "long": (-(2**63), 2**63 - 1),
    "unsignedByte": (0, 255),
    "unsignedShort": (0, 2**16 - 1),
    "unsignedInt": (0, 2**32 - 1),
    "unsignedLong": (0, 2**64 - 1),
    "nonNegativeInteger": (0, None),
    "positiveInteger": (1, None),
    "nonPositiveInteger": (None, 0),
    "negativeInteger": (None, -1),
}


def _out_of_range(name: str, lexical: Column) -> Column:
    """Whether text is no whole number within the datatype's range. Signs and lengths tell, where the range has one end, so any length is exact."""
    least, most = RANGES[name]
    whole = lexical.rlike(r"^[+-]?[0-9]+\z")
    zero, minus = lexical.rlike(r"^[+-]?0+\z"), lexical.startswith("-")
    if least is not None and most is not None:
        value = F.regexp_replace(lexical, r"^([+-]?)0+(?=[0-9])", "$1").try_cast("decimal(38,0)")
        return ~whole | F.coalesce(~value.between(F.lit(str(least)).cast("decimal(38,0)"), F.lit(str(most)).cast("decimal(38,0)")), F.lit(True))
    if least is not None:
        return ~whole | (~zero & minus) | (zero if least == 1 else F.lit(False))
    return ~whole | (~zero & ~minus) | (zero if most == -1 else F.lit(False))


def strict_date(lexical: Column) -> Column:
    """The date of an xsd:date or xsd:dateTime literal, null where it has none (by form or by calendar). Most are spelled as a date is, and then no pattern is tried."""
    plain = lexical.try_cast("date")
    day = F.when(lexical.rlike(rf"^(?:{LEXICAL['date']}|{LEXICAL['dateTime']})\z"), F.regexp_extract(lexical, r"^(-?[0-9]{4,}-[0-9]{2}-[0-9]{2})", 1))
    return F.when((plain.cast("string") == lexical) & ~lexical.startswith("+"), plain).otherwise(day.try_cast("date"))


def strict_fault(datatype: Column, lexical: Column) -> Column:
    """Whether a strict parser refuses the literal: by form, by range, or by calendar."""
    dated = datatype.isin(XSD + "date", XSD + "dateTime", XSD + "dateTimeStamp")
    forms = [(datatype == XSD + name) & ~lexical.rlike(rf"^(?:{form})\z") for name, form in STRICT.items()]
    ranges = [(datatype == XSD + name) & _out_of_range(name, lexical) for name in RANGES]
    return reduce(lambda a, b: a | b, [ill_typed(datatype, lexical), *forms, *ranges]) | (dated & strict_date(lexical).isNull())


def iri_nt(iri: Column) -> Column:
    return F.concat(F.lit("<"), iri, F.lit(">"))


def literal_nt(lexical: Column, datatype: Column, lang: Column) -> Column:
    """N-Triples spelling of a literal."""
    text = lexical
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    quoted = F.concat(F.lit('"'), text, F.lit('"'))
    plain = (datatype == "") | (datatype == XSD + "string") | (datatype == RDF + "langString")
    return F.when(lang != "", F.concat(quoted, F.lit("@"), lang)).when(plain, quoted).otherwise(F.concat(quoted, F.lit("^^<"), datatype, F.lit(">")))


def spelling(side: str) -> Column:
    """N-Triples spelling of a statement's subject (s) or object (o)."""
    text, kind = F.col(side), F.col(f"{side}_kind")
    node = F.when(kind == BNODE, F.concat(F.lit("_:"), text))
    if side == "s":
        return node.otherwise(iri_nt(text))
    return node.when(kind == IRI, iri_nt(text)).otherwise(literal_nt(text, F.col("o_dt"), F.col("o_lang")))


def node_text(side: str) -> Column:
    """The text of a subject or object that is no literal, from its spelling."""
    nt = F.col(f"{side}_nt")
    return F.when(F.col(f"{side}_kind") == BNODE, F.substr(nt, F.lit(3))).otherwise(F.substr(nt, F.lit(2), F.length(nt) - 2))


def once(df: DataFrame, *columns: Column) -> DataFrame:
    """df with columns that are made once a row: a filter over them is not pushed below, where it would make them again."""
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def sha256(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts joined by U+001F; absent parts count as empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def tsv(text: Column) -> Column:
    """A field of a tab-separated file."""
    for raw, escaped in (("\\", "\\\\"), ("\t", "\\t"), ("\r", "\\r"), ("\n", "\\n")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def starts_with_any(text: Column, prefixes) -> Column:
    return reduce(lambda a, b: a | b, [text.startswith(p) for p in prefixes])
