"""Personal data by candidate gradient boosting, in DataFrame functions alone.

Base kinds (email, ip, card, phone) follow fixed patterns and checks; their spans always stand.
High-recall generators propose further spans (addresses spelled out in brackets or in words, national phone
numbers in two ways of writing, social security numbers, account numbers, IPv6 in full and shortened). A name of an
address has at most 64 characters and a label 63, as mail and host names have; longer ones are none. Boosted trees score each proposal on its
format and on the words before it; a threshold for each kind selects.

The trees learn from generated texts (fixed seed) in which personal data and look-alikes are planted
among other words: the same generators and the same feature expressions run over them, half of the
texts train the trees, a quarter sets the thresholds, and a quarter measures (held_back()). The trees
are compiled into one SQL expression, so executors run built-in functions only.

Positions count code points, the end is exclusive. A proposal that overlaps a base span is dropped;
of the others those stand that overlap no other one and have the greatest sum of scores together.

Rows: null and empty texts have no spans (the digest is that of the empty string). Repeated doc_ids
and null doc_ids pass through row by row, texts of any length are looked at whole, an empty table
gives no rows, and other columns are not read.
"""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwarden.llm.quality_model import BoostedTrees
from graphwarden.llm.quality_rules import let
from graphwarden.llm.textbatch import id_text

#: The base patterns, written so that no start is tried twice: a match can only begin where the last
#: one ended or where no character of its first run stands before. The matches are those of the plain forms.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a pattern to be tried.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}

#: Generators of further spans, likewise linear.
MORE = {
    "email_spelled": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+[ ]?[\[({](?:at|AT)[\])}][ ]?[A-Za-z0-9-]{1,63}+(?:[ ]?(?:[\[({](?:dot|DOT)[\])}]|\.)[ ]?[A-Za-z0-9-]{1,63}+){1,8}+",
    "email_words": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ (?:at|AT) [A-Za-z0-9-]{1,63}+(?: (?:dot|DOT) [A-Za-z0-9-]{1,63}+){1,8}+",
    "phone_national": r"(?<![0-9+().-])(?<![0-9+()][ -])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![ -]?[0-9])",
    "phone_zero": r"(?<![0-9+().,/-])(?<![0-9] )\(?0[0-9]{1,4}\)?(?:[ .-]| ?/ ?)[0-9]{2,8}(?:[ .-][0-9]{2,4}){0,4}+(?![0-9]|[.,:/-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}+(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip6": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "ip6_short": r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}+::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}+(?![0-9A-Za-z:])",
}
MORE_NEEDS = {"email_spelled": r"[\[({](?:at|AT)[\])}]", "email_words": " (?:dot|DOT) ", "phone_zero": r"0[0-9]{1,4}\)?[ ./-]", "ip6_short": "[0-9A-Fa-f]::[0-9A-Fa-f]", "phone_national": r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "iban": r"[A-Z]{2}[0-9]{2}", "ip6": r"[0-9A-Fa-f]:[0-9A-Fa-f]"}

#: Words that speak for personal data when they stand shortly before a span.
CUES = r"(?i)(mail|phone|tel|call|mobile|cell|fax|contact|ssn|social|security|iban|account|konto|bank|address|addr|ip|host)[^A-Za-z0-9]{0,4}(?:[A-Za-z]{0,8}[^A-Za-z0-9]{1,3})?$"
#: Words that speak against it.
ANTI = r"(?i)(isbn|order|invoice|version|part|ref|ticket|page|item|serial|build|sku)[^A-Za-z0-9]{0,6}(?:[A-Za-z]{0,8}[^A-Za-z0-9]{1,3})?$"
#: Code points before a span that are looked at.
CONTEXT = 32
#: Matches placed together; it keeps the placing linear in a text's matches.
CHUNK = 64
#: The most proposals that can end within one: MORE's longest match has some 700 code points, its shortest four to fifteen, and those of one kind do not overlap.
NEAR = 768
#: Generated texts of each kind, with personal data and with look-alikes.
EXAMPLES = 300


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def placed(pattern: str, needs: str) -> Column:
    """Leftmost non-overlapping matches of `pattern` in the column text, as structs (s, e, m, before).

    The gaps (split) and the matches (extract all) alternate, so a match starts where all gaps and
    matches before it end. Those sums are taken in chunks, then within each chunk.
    """
    kind = "array<struct<s:bigint,e:bigint,m:string,before:string>>"
    no_sums = "cast(array() as array<bigint>)"
    chunk_sums = f"transform(sequence(0, cast(ceil(size(ln) / {CHUNK}) as int) - 1), c -> aggregate(slice(ln, c * {CHUNK} + 1, {CHUNK}), 0L, (a, x) -> a + x.g + x.m))"
    chunk_starts = f"aggregate({chunk_sums}, named_struct('p', 0L, 'o', {no_sums}), (a, x) -> named_struct('p', a.p + x, 'o', concat(a.o, array(a.p))), a -> a.o)"
    in_chunk = f"aggregate(slice(ln, c * {CHUNK} + 1, {CHUNK}), named_struct('p', p, 'o', {no_sums}), (a, x) -> named_struct('p', a.p + x.g + x.m, 'o', concat(a.o, array(a.p + x.g))), a -> a.o)"
    starts = f"flatten(transform({chunk_starts}, (p, c) -> {in_chunk}))"
    lengths = "transform(found, (m, k) -> named_struct('g', cast(length(get(gaps, k)) as bigint), 'm', cast(length(m) as bigint)))"
    spans = f"transform(found, (m, k) -> named_struct('s', get(st, k), 'e', get(st, k) + length(m), 'm', m, 'before', right(get(gaps, k), {CONTEXT})))"
    with_starts = f"transform(array(transform(array({lengths}), ln -> {starts})[0]), st -> {spans})[0]"
    both = f"transform(array(split(text, r'{pattern}', -1)), gaps -> transform(array(regexp_extract_all(text, r'{pattern}', 0)), found -> {with_starts})[0])[0]"
    return F.expr(f"cast(CASE WHEN text rlike r'{needs}' THEN CASE WHEN text rlike r'{pattern}' THEN {both} END END as {kind})")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has the Luhn sum."""

    def step(a, i):
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        return a + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, "\\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])\\z"))
    if kind == "card":
        return let(F.translate(m, " -", ""), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


#: Features of a proposal, in the order of _features().
FEATURES = ("kind", "length", "digits", "letters", "separators", "cue", "anti", "distinct", "after_colon", "lead", "zeros", "check")


def _check97(m: str) -> str:
    """The remainder by 97 of an account number with its first four characters moved to the end, letters as 10 to 35."""
    packed = f"regexp_replace({m}, '[^A-Z0-9]', '')"
    moved = f"concat(substr({packed}, 5), left({packed}, 4))"
    return f"aggregate(split({moved}, ''), 0, (a, c) -> CASE WHEN c = '' THEN a WHEN c BETWEEN '0' AND '9' THEN (a * 10 + cast(c as int)) % 97 ELSE (a * 100 + ascii(c) - 55) % 97 END)"


def _features(kind: int) -> str:
    """FEATURES of a proposal x (m, before), as an SQL array."""
    digits = "regexp_replace(x.m, '[^0-9]', '')"
    values = (
        str(kind),
        "length(x.m)",
        f"length({digits})",
        "length(regexp_replace(x.m, '[^A-Za-z]', ''))",
        "length(regexp_replace(x.m, '[A-Za-z0-9]', ''))",
        f"x.before rlike r'{CUES}'",
        f"x.before rlike r'{ANTI}'",
        f"size(array_distinct(split({digits}, '')))",
        "x.before rlike '[:=] ?$'",
        f"coalesce(try_cast(left({digits}, 3) as double), -1)",
        "x.m rlike '(^|[^0-9])0+([^0-9]|$)'",
        f"{_check97('x.m')} = 1" if list(MORE)[kind] == "iban" else "0",
    )
    return "array(" + ", ".join(f"cast({v} as double)" for v in values) + ")"


def _account(rng: random.Random, valid: bool) -> str:
    country, size = rng.choice((("DE", 18), ("FR", 23), ("GB", 18), ("ES", 20), ("NL", 14)))
    body = "".join(rng.choice("0123456789") for _ in range(size))
    number = int("".join(str(int(c, 36)) for c in body + country + "00"))
    check = (98 - number % 97) if valid else (98 - number % 97 + rng.randint(1, 90)) % 100
    packed = f"{country}{check:02d}{body}"
    return " ".join(packed[i : i + 4] for i in range(0, len(packed), 4)) if rng.random() < 0.5 else packed


def _planted(rng: random.Random, kind: str, good: bool) -> tuple[str, list[str]]:
    """A string that the kind's generator should propose, and words that may stand before it."""

    def number(low: int, high: int, width: int) -> str:
        return str(rng.randint(low, high)).zfill(width)

    def hexes(low: int, high: int) -> str:
        return ":".join(f"{rng.randint(low, high):x}" for _ in range(8))

    words = ("the", "noon", "look", "big", "red", "end", "point", "home", "three", "line", "last", "this", "half", "once", "place")
    neutral = ["", "here", "this is", "see", "it was", "we have"]
    against = ["order", "invoice no.", "part", "ticket", "version", "item", "serial", "ref:", "build", "SKU"]
    if kind == "email_spelled":
        at, dot = rng.choice((("[at]", "[dot]"), ("(at)", "(dot)"), ("{at}", "."), ("[AT]", "[DOT]")))
        name = rng.choice(("jane", "j.doe", "info", "max_muster", "anna.k", "team-42"))
        if good:
            return f"{name} {at} {rng.choice(('example', 'mail-host', 'uni-town', 'acme'))} {dot} {rng.choice(('com', 'org', 'de', 'co.uk'))}", [*neutral, "mail", "contact:", "e-mail:", "write to"]
        return rng.choice((f"sold {at} {rng.randint(1, 99)}.{rng.randint(10, 99)}", f"meet {at} {rng.randint(1, 12)}.{rng.randint(10, 59)}", f"look {at} it.{rng.choice(('Then', 'And', 'So'))}")), neutral
    if kind == "email_words":
        if good:
            return f"{rng.choice(('jane', 'j.doe', 'info', 'max_muster', 'anna.k', 'team-42', 'kim88'))} at {rng.choice(('example', 'mail-host', 'uni-town', 'acme', 'firm7'))} dot {rng.choice(('com', 'org', 'de', 'net', 'co dot uk'))}", [*neutral, "mail", "contact:", "e-mail:", "write to"]
        return rng.choice((f"{rng.choice(words)} at {rng.choice(words)} dot {rng.choice(words)}", f"look at the dot {rng.choice(words)}", f"sold at {rng.randint(1, 99)} dot {rng.randint(1, 99)}")), neutral
    if kind == "phone_zero":
        if good:
            return rng.choice((f"0{number(20, 999, 2)} {number(100000, 9999999, 6)}", f"0{number(20, 89, 2)} / {number(10, 999, 3)} {number(10, 99, 2)} {number(10, 99, 2)}", "0" + rng.choice("1234567") + "".join(f" {number(0, 99, 2)}" for _ in range(4)), f"(0{number(20, 161, 2)}) {number(100, 9999, 3)} {number(1000, 9999, 4)}", f"0{number(150, 179, 3)}-{number(1000000, 99999999, 7)}")), [*neutral, "call", "phone:", "tel", "mobile", "fax:", "reach us on"]
        return rng.choice((f"0{number(1, 9, 1)}.{number(10, 99, 2)}", f"0{number(1, 9, 1)}-{number(10, 28, 2)}", f"00{number(1, 99, 2)} {number(10, 99, 2)}", f"0{number(1, 9, 1)}/{number(10, 12, 2)}", f"0{number(1, 9, 1)}.{number(10, 12, 2)} {number(1900, 2030, 4)}", f"0{number(100, 999, 3)}-{number(10, 99, 2)}")), [*against, *neutral]
    if kind == "ip6_short":
        if good:
            return f"{rng.choice(('2001:db8', 'fe80', '2a02:26f0:1c', 'fd00:17:a', '2001:470:1f0b'))}::{':'.join(f'{rng.randint(1, 0xFFFF):x}' for _ in range(rng.randint(1, 4)))}", [*neutral, "host", "address", "ip:", "from"]
        return f"{rng.choice(('a', 'de', 'abc', 'face', 'dead', 'b', '1', '12'))}::{rng.choice(('b', 'add', 'cafe', 'be', '2', 'fade'))}", [*against, *neutral]
    if kind == "phone_national":
        sep = rng.choice("-. ")
        if good:
            return f"{rng.choice(('{}', '({})')).format(number(201, 989, 3))}{sep}{number(200, 999, 3)}{sep}{number(0, 9999, 4)}", [*neutral, "call", "phone:", "tel", "mobile", "fax:", "reach us on"]
        return f"{number(0, 199, 3)}{sep}{number(0, 999, 3)}{sep}{rng.choice((number(0, 9999, 4), '0000'))}", [*against, *neutral]
    if kind == "ssn":
        if good:
            return f"{number(1, 665, 3)}-{number(1, 99, 2)}-{number(1, 9999, 4)}", [*neutral, "ssn", "SSN:", "social security number"]
        return rng.choice((f"000-{number(1, 99, 2)}-{number(1, 9999, 4)}", f"{number(900, 999, 3)}-{number(1, 99, 2)}-{number(1, 9999, 4)}", f"{number(1, 665, 3)}-00-{number(1, 9999, 4)}", f"{number(1, 665, 3)}-{number(1, 99, 2)}-0000")), [*against, *neutral]
    if kind == "iban":
        return _account(rng, good), [*neutral, "iban", "IBAN:", "account", "pay to"] if good else [*against, *neutral]
    if good:
        return hexes(0x100, 0xFFFF), [*neutral, "host", "address", "ip:", "from"]
    return hexes(0, 0x59 if rng.random() < 0.5 else 9), [*against, *neutral]


def examples(rng: random.Random) -> list[tuple[str, str, int, int, bool]]:
    """Generated texts, each with one planted string: (text, kind, start, end, whether it is personal data)."""
    words = "the of a report came in late and was sent on to all who had asked for it last week".split()
    out = []
    for kind in MORE:
        for good in (True, False):
            for _ in range(EXAMPLES):
                what, cues = _planted(rng, kind, good)
                before = " ".join([*(rng.choice(words) for _ in range(rng.randint(0, 8))), rng.choice(cues)]).strip()
                before = before + " " if before else ""
                after = rng.choice(("", ".", " ", ", ")) + " ".join(rng.choice(words) for _ in range(rng.randint(0, 5)))
                if after[:1].isalpha():
                    after = " " + after
                out.append((before + what + after, kind, len(before), len(before) + len(what), good))
    rng.shuffle(out)
    return out


class Judge:
    """The trees, the least score of each kind, and what they are worth on texts that neither has seen: kind -> (precision, recall)."""

    def __init__(self, spark: SparkSession):
        made = examples(random.Random(17))
        texts = F.from_json(F.lit(json.dumps([{"n": i, "text": t} for i, (t, *_) in enumerate(made)])), "array<struct<n:int,text:string>>")
        rows = spark.range(1).select(F.explode(texts).alias("t")).select("t.n", "t.text")
        found = [F.expr(f"transform({kind}, x -> named_struct('kind', {k}, 's', x.s, 'e', x.e, 'f', {_features(k)}))") for k, kind in enumerate(MORE)]
        rows = rows.select("n", *[F.coalesce(placed(pattern, MORE_NEEDS[kind]), _empty("struct<s:bigint,e:bigint,m:string,before:string>")).alias(kind) for kind, pattern in MORE.items()])
        got = rows.select("n", F.explode(F.concat(*found)).alias("x")).select("n", "x.kind", "x.s", "x.e", "x.f").collect()  # a few for each generated text
        got = sorted(got, key=lambda r: (r.n, r.kind, r.s))
        kinds = list(MORE)
        right = np.array([(lambda m: m[4] and m[1] == kinds[r.kind] and r.s < m[3] and m[2] < r.e)(made[r.n]) for r in got])
        x, n, kind = np.array([r.f for r in got], np.float32), np.array([r.n for r in got]), np.array([r.kind for r in got])
        self.trees = BoostedTrees(x[n % 4 < 2], right[n % 4 < 2].astype(float), trees=48, depth=3)
        score = self.trees.score(x)
        self.least, self.measured = [], {}
        for k, name in enumerate(kinds):
            own = (kind == k) & (n % 4 == 2)
            self.least.append(max((c / 20 for c in range(4, 17)), key=lambda c: (self._worth(score[own] >= c, right[own])[2], -abs(c - 0.5))))
            held = (kind == k) & (n % 4 == 3)
            precision, recall, _ = self._worth(score[held] >= self.least[k], right[held])
            hits = {int(i) for i in n[held & right & (score >= self.least[k])]}
            planted = sum(m[1] == name and m[4] for i, m in enumerate(made) if i % 4 == 3)
            self.measured[name] = (precision, len(hits) / planted)

    @staticmethod
    def _worth(said: np.ndarray, right: np.ndarray) -> tuple[float, float, float]:
        """Precision, recall and their harmonic mean."""
        hits = float((said & right).sum())
        precision, recall = hits / max(1, said.sum()), hits / max(1, right.sum())
        return precision, recall, 2 * precision * recall / max(1e-9, precision + recall)


_judge: Judge | None = None


def judge(spark: SparkSession) -> Judge:
    """The fitted judge; it is the same in every session."""
    global _judge
    if _judge is None:
        _judge = Judge(spark)
    return _judge


def held_back(spark: SparkSession) -> dict[str, tuple[float, float]]:
    """kind -> (precision, recall) on the generated texts that were held back."""
    return judge(spark).measured


def compiled(model: BoostedTrees) -> str:
    """The model's score of the features f, as an SQL expression."""

    def node(t: int, v: int, level: int) -> str:
        if level == model.depth:
            return f"{float(model.leaf[t, v - ((1 << model.depth) - 1)])!r}D"
        if not np.isfinite(model.threshold[t, v]):
            return node(t, 2 * v + 1, level + 1)
        return f"CASE WHEN f[{model.feature[t, v]}] > {float(model.threshold[t, v])!r}D THEN {node(t, 2 * v + 2, level + 1)} ELSE {node(t, 2 * v + 1, level + 1)} END"

    raw = " + ".join([f"{model.bias!r}D", *(node(t, 0, 0) for t in range(len(model.feature)))])
    return f"1 / (1 + exp(-({raw})))"


def _base_spans(rank: int, kind: str) -> Column:
    good = F.filter(placed(BASE[kind], NEEDS[kind]), lambda x: _passes(kind, x["m"]))
    spans = F.transform(good, lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("r"), x["e"].alias("e"), F.lit(kind).alias("kind")))
    return F.coalesce(spans, _empty("struct<s:bigint,r:int,e:bigint,kind:string>"))


def _more_spans(rank: int, kind: str, score: str, least: float) -> Column:
    """The proposals in the column `kind` that their score selects."""
    scored = f"transform({kind}, x -> named_struct('s', x.s, 'r', {len(BASE) + rank}, 'e', x.e, 'kind', '{kind}', 'score', transform(array({_features(rank)}), f -> {score})[0]))"
    return F.coalesce(F.expr(f"filter({scored}, x -> x.score >= {least!r}D)"), _empty("struct<s:bigint,r:int,e:bigint,kind:string,score:double>"))


def _counted(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")


def running_max(values: str) -> str:
    """SQL: of each element of an array of bigint the greatest up to it; linear but for a short array of chunk maxima."""
    tops = f"transform(sequence(0, cast(ceil(size(v) / {CHUNK}) as int) - 1), c -> array_max(slice(v, c * {CHUNK} + 1, {CHUNK})))"
    before = f"transform(array({tops}), t -> transform(t, (x, i) -> array_max(slice(t, 1, i))))[0]"
    inside = f"transform(slice(v, c * {CHUNK} + 1, {CHUNK}), (x, j) -> greatest(m, array_max(slice(v, c * {CHUNK} + 1, j + 1))))"
    return f"transform(array({values}), v -> flatten(transform({before}, (m, c) -> {inside})))[0]"


def free_of_base(base: str, more: str) -> str:
    """SQL: the structs of `more` (s, e, r, kind, score) that overlap none of `base` (s, e)."""
    every = f"array_sort(concat(transform({base}, b -> named_struct('s', b.s, 'e', b.e, 'r', -1, 'kind', '', 'score', 0D)), transform({more}, x -> named_struct('s', x.s, 'e', x.e, 'r', x.r, 'kind', x.kind, 'score', x.score))))"
    ends = running_max("transform(every, x -> CASE WHEN x.r < 0 THEN x.e ELSE -1L END)")
    starts = f"reverse({running_max('transform(reverse(every), x -> CASE WHEN x.r < 0 THEN -x.s ELSE -9223372036854775807L END)')})"
    return f"transform(array({every}), every -> transform(array({ends}), before -> transform(array({starts}), behind -> filter(every, (x, i) -> x.r >= 0 AND get(before, i) <= x.s AND -get(behind, i) >= x.e))[0])[0])[0]"


def heaviest(spans: str) -> str:
    """SQL: of structs (s, e, r, kind, score) those that overlap no other one taken, with the greatest sum of scores.

    By rising end, the best sum with a span is its score and the best sum of those that end where it
    starts or before; no more than NEAR end within it. The way back takes each span that is part of the best sum up to it.
    """
    rising = f"array_sort({spans}, (x, y) -> CASE WHEN x.e <> y.e THEN cast(sign(x.e - y.e) as int) WHEN x.s <> y.s THEN cast(sign(x.s - y.s) as int) ELSE x.r - y.r END)"
    near = f"slice(arrays_zip(a.e, a.b), greatest(1, size(a.e) - {NEAR - 1}), {NEAR})"
    gained = f"x.score + coalesce(array_max(transform(filter({near}, o -> o.e <= x.s), o -> o.b)), get(a.b, size(a.b) - {NEAR + 1}), 0D)"
    step = f"transform(array({gained}), t -> named_struct('e', concat(a.e, array(x.e)), 'b', concat(a.b, array(greatest(t, coalesce(get(a.b, size(a.b) - 1), 0D)))), 't', concat(a.t, array(t))))[0]"
    zero = "named_struct('e', cast(array() as array<bigint>), 'b', cast(array() as array<double>), 't', cast(array() as array<double>))"
    sums = f"aggregate(p, {zero}, (a, x) -> {step})"
    back = "aggregate(reverse(sequence(0, size(p) - 1)), named_struct('s', 9223372036854775807L, 'k', cast(array() as array<int>)), (a, i) -> CASE WHEN get(p, i).e <= a.s AND get(f.t, i) >= coalesce(get(f.b, i - 1), 0D) THEN named_struct('s', get(p, i).s, 'k', concat(a.k, array(i))) ELSE a END, a -> a.k)"
    return f"CASE WHEN size({spans}) < 2 THEN {spans} ELSE transform(array({rising}), p -> transform(array({sums}), f -> transform(reverse({back}), i -> get(p, i)))[0])[0] END"


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base, more: arrays of (s, rank, e, kind) for each whole text."""
    rows = id_text(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    fitted = judge(docs.sparkSession)
    base = [_base_spans(rank, kind) for rank, kind in enumerate(BASE)]
    proposed = [placed(pattern, MORE_NEEDS[kind]).alias(kind) for kind, pattern in MORE.items()]
    more = [_more_spans(rank, kind, compiled(fitted.trees), fitted.least[rank]) for rank, kind in enumerate(MORE)]
    rows = rows.select("doc_id", F.array_sort(F.concat(*base)).alias("base"), *proposed)
    rows = rows.select("doc_id", "base", F.concat(*more).alias("more"))
    free = F.expr(f"CASE WHEN size(more) = 0 THEN NULL ELSE {free_of_base('base', 'more')} END")
    rows = rows.select("doc_id", "base", free.alias("free"))
    chosen = F.expr(f"CASE WHEN free IS NULL OR size(free) = 0 THEN NULL ELSE array_sort(transform({heaviest('free')}, x -> named_struct('s', x.s, 'r', x.r, 'e', x.e, 'kind', x.kind))) END")
    return rows.select("doc_id", "base", F.coalesce(chosen, _empty("struct<s:bigint,r:int,e:bigint,kind:string>")).alias("more"))


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans."""
    return find(docs).select("doc_id", *[_counted(k) for k in BASE], F.sha2(_text(F.col("base")), 256).alias("base_sha256"), _text(F.array_sort(F.concat("base", "more"))).alias("spans"))
