"""Turtle files larger than a split, read by as many tasks as they have splits.

Splits begin at line starts. There only a long string can be open, so a split's lexer is a map of three
states: `states` finds, for each state that a split may begin in, the one that it ends in and whether a
statement ends in it. `composed` chains these maps along a file; from then each split knows how it begins,
its first line, and which earlier split holds the start of the statement that runs into it. `cut` then
makes pieces of whole statements; what runs over a split's end is put together again by that earlier
split. Prefixes and bases are folded in the order of the pieces that set them, and each piece is parsed
on its own with those in force where it begins.

Between tasks go a row a split, one for each change of prefixes, and the text once, as pieces. A
statement is one task's, as is a line, and both are to be below 2 GB.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwarden.operators.closure import checkpointed
from graphwarden.sources.turtle import RAW, ROWS, SCAN, Parser, TurtleError, resolved, unescape

#: States at a line's start: in no string, in a long one of either mark; DEAD where nothing could be read.
OPEN, DOUBLE, SINGLE, DEAD = range(4)
#: Characters of whole statements that make a piece.
PIECE = 1 << 16
#: Up to so many splits, a row of some 60 bytes each, are broadcast to the lines; above, lines meet them by a shuffle.
SPLITS = 100_000
#: Shares in which a file's pieces meet its prefixes.
SHARES = 64
_CLOSE = {DOUBLE: re.compile(r'\\.|"""', re.DOTALL), SINGLE: re.compile(r"\\.|'''", re.DOTALL)}


def scan(text: str, state: int) -> tuple[int, list[int], int]:
    """(state at the end, where statements end, where reading failed or -1) of whole lines."""
    at, ends = 0, []
    if state == DEAD:
        return state, ends, -1
    while at < len(text):
        if state != OPEN:
            closing = next((m for m in _CLOSE[state].finditer(text, at) if m[0][0] != "\\"), None)
            if closing is None:
                return state, ends, -1
            at, state = closing.end(), OPEN
            continue
        m = SCAN.match(text, at)
        if not m:
            return DEAD, ends, at
        at = m.end()
        if m.lastgroup == "open":
            state = DOUBLE if m[0][0] == '"' else SINGLE
        elif m.lastgroup == "mark" and m[0] == ".":
            ends.append(at)
    return state, ends, -1


def states(texts: Iterable[str]) -> tuple[int, list[int], list[bool]]:
    """(lines, state at the end, whether a statement ends) of a split, the last two by the state it begins in. Beginnings that meet in a state go on as one."""
    lines, to, cuts = 0, [OPEN, DOUBLE, SINGLE], [False] * 3
    for text in texts:
        lines += text.count("\n")
        found = {s: scan(text, s) for s in set(to)}
        for i, s in enumerate(to):
            to[i] = found[s][0]
            cuts[i] |= bool(found[s][1])
    return lines, to, cuts


def composed(splits: Iterable[tuple[int, int, list[int], list[bool]]]) -> Iterator[tuple[int, int, int, int, bool]]:
    """(block, state, home, line, first) of a file's splits (block, *states) in order; home is the split where the statement that runs into this one starts."""
    state, home, line, first = OPEN, None, 1, True
    for block, lines, to, cuts in splits:
        yield block, state, block if home is None else home, line, first
        if first or cuts[state]:
            home = block
        line, state, first = line + lines, to[state] if to[state] != DEAD else OPEN, False


def cut(texts: Iterable[str], block: int, state: int, home: int, line: int, first: bool, size: int = PIECE) -> Iterator[tuple[int, int, int, bool, str]]:
    """(home, n, line, whole, text) of a split: pieces of whole statements, and those that are none (whole false), which go to the split where they start."""
    n, parts, held, done, inside = 0, [], 0, 0, first
    for text in texts:
        state, ends, failed = scan(text, state)
        if failed >= 0:
            at = line + sum(x.count("\n") for x in parts) + text.count("\n", 0, failed)
            raise TurtleError(f"line {at}: cannot read {text[failed : failed + 20]!r}")
        gone = 0
        if not inside:
            gone = ends[0] if ends else len(text)
            yield home, n, line, False, text[:gone]
            n, line, inside = n + 1, line + text.count("\n", 0, gone), bool(ends)
            if not inside:
                continue
        if ends:
            done = held + ends[-1] - gone
        parts.append(text[gone:])
        held += len(text) - gone
        if done >= size:
            joined = "".join(parts)
            yield block, n, line, True, joined[:done]
            n, line, parts, held, done = n + 1, line + joined.count("\n", 0, done), [joined[done:]], held - done, 0
    joined = "".join(parts)
    if done:
        yield block, n, line, True, joined[:done]
    if joined[done:].strip():
        yield block, n + 1, line + joined.count("\n", 0, done), False, joined[done:]


def directives(text: str) -> list[tuple[str, str, str]]:
    """(what, name, IRI as written) of the prefixes and bases that a piece of whole statements sets."""
    found, last, at = [], ["", "", ""], 0
    open_, wanted = "", 0
    state = OPEN
    while at < len(text):
        if state != OPEN:
            closing = next((m for m in _CLOSE[state].finditer(text, at) if m[0][0] != "\\"), None)
            if closing is None:
                break
            at, state, last = closing.end(), OPEN, ["string", "", ""]
            continue
        m = SCAN.match(text, at)
        if not m:
            break
        at = m.end()
        kind, token = m.lastgroup, m[0]
        if kind == "skip":
            continue
        if kind == "open":
            state = DOUBLE if token[0] == '"' else SINGLE
        elif wanted == 2:
            last, wanted = [kind, token, ""], 1
            name = token
            continue
        elif wanted == 1:
            if kind == "iri":
                found.append((open_, name[:-1] if open_ == "prefix" else "", token))
            wanted = 0
        elif (kind == "at" and last[0] != "string" and token in ("@prefix", "@base")) or (kind == "word" and token.upper() in ("PREFIX", "BASE")):
            open_ = token.lstrip("@").lower()
            name, wanted = "", 2 if open_ == "prefix" else 1
        last = [kind, token, ""]
    return found


def folded(base: str, pieces: Iterable[tuple[int, int, list]]) -> Iterator[tuple[int, int, str, dict[str, str]]]:
    """(block, n, base, prefixes) in force after a piece, from (block, n, directives) in order; only where they change. The first one holds from the file's start."""
    prefixes: dict[str, str] = {}
    yield -1, -1, base, {}
    for block, n, changes in pieces:
        before = base, dict(prefixes)
        for what, name, iri in changes:
            try:
                iri = resolved(base, unescape(iri[1:-1]))
            except TurtleError:  # the piece itself is a fault when it is parsed
                continue
            if what == "base":
                base = iri
            else:
                prefixes[name] = iri
        if before != (base, prefixes):
            yield block, n, base, dict(prefixes)


def _texts(batches, *columns: str) -> Iterator[tuple]:
    """(path, block, *columns, lines as bytes) of consecutive lines of a split."""
    for pdf in batches:
        keys = ["path", "block", *columns]
        for key, rows in groupby(zip(*[pdf[k] for k in keys], pdf["value"], strict=True), lambda r: r[: len(keys)]):
            yield (*key, b"".join(bytes(r[-1]) + b"\n" for r in rows))


def _decoded(chunks: Iterable[bytes], block: int, errors: str) -> Iterator[str]:
    for i, chunk in enumerate(chunks):
        text = chunk.decode("utf-8", errors)
        yield text.removeprefix("\ufeff") if block == 0 and i == 0 else text


def _states(batches):
    import pandas as pd

    for (path, block), chunks in groupby(_texts(batches), lambda r: r[:2]):
        yield pd.DataFrame([(path, block, *states(_decoded((c[-1] for c in chunks), block, "replace")))], columns=["path", "block", "lines", "ends", "cuts"])


def _composed(pdf):
    import pandas as pd

    pdf = pdf.sort_values("block")
    path = pdf["path"].iloc[0]
    rows = composed(zip(pdf["block"], pdf["lines"], pdf["ends"], pdf["cuts"], strict=True))
    return pd.DataFrame([(path, *r) for r in rows], columns=["path", "block", "state", "home", "line", "first"])


def _cut(batches):
    import pandas as pd

    names = ["path", "home", "block", "n", "line", "whole", "text", "fault"]
    for (path, block, state, home, line, first), chunks in groupby(_texts(batches, "state", "home", "line", "first"), lambda r: r[:6]):
        try:
            for home_, n, line_, whole, text in cut(_decoded((c[-1] for c in chunks), block, "strict"), block, state, home, line, first):
                yield pd.DataFrame([(path, home_, block, n, line_, whole, text, None)], columns=names)
        except (TurtleError, UnicodeDecodeError) as e:
            yield pd.DataFrame([(path, block, block, 0, line, True, None, str(e))], columns=names)


def _directives(batches):
    import pandas as pd

    for pdf in batches:
        found = [json.dumps(directives(t)) for t in pdf["text"]]
        yield pd.DataFrame({"path": pdf["path"], "block": pdf["block"], "n": pdf["n"], "changes": found})


def _folded(pdf):
    import pandas as pd

    pdf = pdf.sort_values(["block", "n"])
    path = pdf["path"].iloc[0]
    found = [*folded(path, ((b, n, json.loads(c)) for b, n, c in zip(pdf["block"], pdf["n"], pdf["changes"], strict=True))), (1 << 62, 0, "", {})]
    rows = [(path, b, n, b2, n2, base, json.dumps(prefixes)) for (b, n, base, prefixes), (b2, n2, _, _) in zip(found, found[1:])]
    return pd.DataFrame(rows, columns=["path", "block0", "n0", "block1", "n1", "base", "prefixes"])


def _parsed(batches):
    import pandas as pd

    for pdf in batches:
        for module, block, n, line, base, prefixes, text, fault in zip(*[pdf[c] for c in ("module", "block", "n", "line", "base", "prefixes", "text", "fault")], strict=True):
            try:
                if fault is not None:
                    raise TurtleError(f"{module}, {fault}")
                found = Parser(text, base, module, json.loads(prefixes), f"genid.{block}.{n}.", line).statements()
                for i in range(0, len(found), ROWS):
                    yield pd.DataFrame([(module, *t, None) for t in found[i : i + ROWS]], columns=RAW.names)
            except TurtleError as e:
                yield pd.DataFrame([(module, *[None] * 7, str(e))], columns=RAW.names)


def read_splits(spark: SparkSession, paths: list[str], named: DataFrame, splits: int = SPLITS) -> DataFrame:
    """Rows of RAW of Turtle files; named is (path, module), a row a file."""
    plain = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")
    lines = spark.read.option("lineSep", "\n").text(paths).select(plain.alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    begins = lines.mapInPandas(_states, "path string, block long, lines long, ends array<int>, cuts array<boolean>")
    begins = checkpointed(begins.groupBy("path").applyInPandas(_composed, "path string, block long, state int, home long, line long, first boolean"))
    if begins.count() <= splits:
        rows = lines.join(F.broadcast(begins), ["path", "block"])  # lines stay in the order of the file
    else:
        rows = lines.withColumn("at", F.monotonically_increasing_id()).join(begins, ["path", "block"]).repartition("path", "block").sortWithinPartitions("path", "block", "at")
    made = checkpointed(rows.mapInPandas(_cut, "path string, home long, block long, n long, line long, whole boolean, text string, fault string"))
    torn = made.where("NOT whole").groupBy("path", "home").agg(F.array_sort(F.collect_list(F.struct("block", "n", "line", "text"))).alias("x"))
    joined = torn.select("path", F.col("home").alias("block"), F.lit(1 << 40).alias("n"), F.col("x")[0]["line"].alias("line"), F.array_join(F.col("x.text"), "").alias("text"), F.lit(None).cast("string").alias("fault"))
    pieces = checkpointed(made.where("whole").select(*joined.columns).unionByName(joined))
    # a piece without these letters sets nothing
    setting = pieces.where(F.col("text").rlike("(?i)prefix|base")).select("path", "block", "n", "text").mapInPandas(_directives, "path string, block long, n long, changes string").where("changes <> '[]'")
    start = named.select("path", F.lit(-1).cast("long").alias("block"), F.lit(-1).cast("long").alias("n"), F.lit("[]").alias("changes"))
    force = setting.unionByName(start).groupBy("path").applyInPandas(_folded, "path string, block0 long, n0 long, block1 long, n1 long, base string, prefixes string")
    force = checkpointed(force).join(named, "path").withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    at = F.struct("block", "n")
    within = (F.struct("block0", "n0") < at) & (at <= F.struct("block1", "n1"))
    dealt = pieces.withColumn("share", F.pmod(F.xxhash64("block", "n"), F.lit(SHARES)).cast("int"))
    return dealt.join(force, ["path", "share"]).where(within).select("module", "block", "n", "line", "base", "prefixes", "text", "fault").mapInPandas(_parsed, RAW)
