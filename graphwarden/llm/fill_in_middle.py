"""Fill-in-the-middle examples: each text cut at two ranks of its units, and rearranged.

A text's units are runs of ASCII letters and single other characters. Two lazy passes of one matcher do
the cutting: the first counts the units, the second is advanced to both ranks and stops there, so no
list of units, or of their places, is ever held; beside the text and its output a row takes no memory.

Null texts count as empty, and empty texts stay plain. Rows are judged one by one, so repeated rows
give equal rows; a null doc_id draws as the empty string does. Columns other than doc_id and text are
left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphwarden.llm.textbatch import id_text

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")
#: Marks of prefix, suffix and middle; a text that has one stays plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are rearranged, and of 100 of these so many with the suffix first.
RATE, SUFFIX_FIRST = 90, 20
#: Characters of output after which a batch goes out.
BATCH_CHARS = 1 << 22
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType(), False), T.StructField("form", T.StringType(), False), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType(), False)])


def unit_count(text: str) -> int:
    """The number of units, by one pass that keeps none."""
    n = count()
    deque(zip(UNIT.finditer(text), n), maxlen=0)
    return next(n)


def unit_ends(text: str, first: int, second: int) -> tuple[int, int]:
    """Where the first `first` and the first `second` units end (first <= second), by one pass that stops at the latter."""
    units, ends = UNIT.finditer(text), [0, 0]
    for k, ahead in enumerate((first, second - first)):
        last = next(islice(units, ahead - 1, None), None) if ahead else None
        ends[k] = last.end() if last is not None else ends[0]
    return ends[0], ends[1]


def rearrange(doc_id: int | None, text: str, seed: int = 1) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of the prefix, of the middle, output) of one text."""
    n = unit_count(text)
    drawn = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(drawn[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= RATE:
        return n, "plain", None, None, text
    a, b = unit_ends(text, *sorted((h1 % (n + 1), h2 % (n + 1))))
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", a, b - a, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    return n, "psm", a, b - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"


def transform(docs: DataFrame, seed: int = 1) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every whole text; one row each, no shuffle."""

    def run(batches):
        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                rows.append((doc_id.as_py(), *rearrange(doc_id.as_py(), text.as_py() or "", seed)))
                size += len(rows[-1][-1])
                if size >= BATCH_CHARS:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    return id_text(docs).mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=SCHEMA.names)


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of. A mark is found where it first stands, as no part of a rearranged text has one."""
    first, second = F.when(form == "psm", SUFFIX).otherwise(PREFIX), F.lit(MIDDLE)
    body = F.substr(output, F.lit(4))
    one = F.substring_index(body, SUFFIX, 1)
    one = F.when(form == "psm", one).otherwise(F.substring_index(body, PREFIX, 1))
    rest = F.substr(body, F.length(one) + F.length(first) + 1)
    two = F.substring_index(rest, MIDDLE, 1)
    three = F.substr(rest, F.length(two) + F.length(second) + 1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, three, two)).otherwise(F.concat(two, three, one))


def digest(docs: DataFrame) -> DataFrame:
    """What transform() gives, with SHA-256 of the output and of the text rebuilt from it in place of the output."""
    out = transform(docs)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))


#: The same in SQL, from the list of a text's units.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]', 0, 's') AS u, [('0x' || substr(h, 8 * i + 1, 8))::BIGINT FOR i IN range(4)] AS r FROM d
), k AS (SELECT *, len(u) AS n, least(r[1] % (len(u) + 1), r[2] % (len(u) + 1)) AS a, greatest(r[1] % (len(u) + 1), r[2] % (len(u) + 1)) AS b FROM u
), p AS (SELECT doc_id, t, n::BIGINT AS n, array_to_string(u[1:a], '') AS x, array_to_string(u[a + 1:b], '') AS y, array_to_string(u[b + 1:], '') AS z,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 90 THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(t) AS restored_sha256
FROM p"""
