"""Secret scans by a linear-chain conditional random field.

Tokens are tagged as the begin (B) or inside (I) of a secret, or outside (O). Emissions depend on the
token's shape class, on the classes of its neighbours, on words that speak for or against a secret
among the NEAR tokens before it, and on features of the file; transitions on the tags. The weights
are fitted on the driver by gradient steps on the log-likelihood of generated lines (fixed seed),
measured on others (held_out()), and Viterbi decodes. A line is a sequence and is never cut. A secret is one
token of a class that a key can have (KEYS), or a fence: the field has no other tags for the other classes, so a
line without such a token is not decoded. There is no least length; how long a token is enters by its class.

Base kinds (assign, access, hex) follow fixed patterns and checks, and their spans always stand. The
method's spans have kind crf; one that overlaps a base span is dropped.

Positions count code points, the end is exclusive. Rows: a null text counts as empty (no spans, the
digest of the empty string); repeated doc_ids are scanned row by row, a null doc_id passes through,
texts of any length are scanned whole, an empty table gives no rows, and other columns are not read.
"""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graphwarden.llm.textbatch import id_text

#: The base patterns in the order of their kinds, the least lengths, and what may be a secret's kind.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

TAGS = ("O", "B", "I")
#: Shape classes.
WORD, NUMBER, MARK, CUE, NAME, EQUALS, QUOTE, TINY, MIXED, STRONG, LONG, DENSE, PREFIXED, UUID, PATH, FENCE, EDGE = range(17)
CLASSES = 17
#: Classes of what may be a secret.
KEYS = (TINY, MIXED, STRONG, LONG, DENSE, PREFIXED, FENCE)
#: A token: key characters, with marks between them as passwords have, or one mark. Quotes and the like are marks, and so is the @ before a host.
_KEY = r"[A-Za-z0-9_+/=.\-]"
_INNER = r"(?:[!#$%^&*~?]|@(?![A-Za-z0-9-]+\.[A-Za-z]))"
TOKEN = re.compile(rf"-----[A-Z ]{{4,40}}-----|{_KEY}+(?:{_INNER}+{_KEY}+)*|[^\sA-Za-z0-9_+/=.\-]")
#: Where a token of KEYS may stand: every one has a fence, a digit beside other key characters, 16 of these in a row, or an inner mark.
SUSPECT = re.compile(rf"-----|[0-9][A-Za-z_+/=.\-]|[A-Za-z_+/=.\-][0-9]|{_KEY}{{16}}|{_KEY}{_INNER}+{_KEY}")
_PREFIX = re.compile(r"(?:sk|pk|rk)[_-](?:live|test|ant|proj)?[_-]?[A-Za-z0-9_-]{12,}|gh[pousr]_[A-Za-z0-9]{16,}|github_pat_[A-Za-z0-9_]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|glpat-[A-Za-z0-9_-]{16,}|AIza[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]+)+|SG\.[A-Za-z0-9_-]{12,}\.?[A-Za-z0-9_-]*")
_CUE = re.compile(
    r"(?i).*(?:password|passwd|passphrase|passcode|passwort|kennwort|secret|token|(?:api|auth|private|access|secret|signing|encryption|licen[cs]e|account)[_-]?key|credentials?)s?"
    r"|(?:.*[_.-])?(?:pass|pwd|pw|key|auth|authorization|bearer|login|pin|psk|clave|contraseña)s?"
)
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
FILE_FEATURES = 3
#: Generated lines that the field learns from.
LINES = 1200
#: Tokens before a token in which words for or against a secret count, and the words against.
NEAR = 4
_AGAINST = re.compile(r"(?i)(?:commit|sha\d*|md5|hash|checksum|digest|uuid|guid|build|revision|rev|version|id|serial|order|isbn|doi|etag|trace)")
NEAR_FEATURES = 2


def shape(token: str) -> int:
    """The shape class of a token."""
    if token.startswith("-----") and token.endswith("-----") and len(token) > 10:
        return FENCE if "PRIVATE" in token else MARK
    c = token[0]
    if len(token) == 1 and not (c.isalnum() or c in "_+/=.-"):
        return QUOTE if c in "\"'`" else EQUALS if c == ":" else MARK
    if token.strip("=") == "":
        return EQUALS
    if _CUE.fullmatch(token.rstrip("=:.")):
        return CUE
    body = token.strip(".=-")
    if not body.isascii() or _MARKED.search(body):
        return _marked(body)
    if body.isalpha():
        # a random key without digits changes case all the time; a word does not
        turns = sum(a.isupper() != b.isupper() for a, b in zip(body, body[1:], strict=False))
        return DENSE if len(body) >= 20 and turns >= len(body) // 4 else WORD
    if body.replace(".", "").replace("-", "").isdigit():
        return NUMBER
    if _UUID.fullmatch(body):
        return UUID
    if _PREFIX.fullmatch(token.rstrip(".")):
        return PREFIXED
    digits = sum(ch.isdigit() for ch in body)
    upper = sum(ch.isupper() for ch in body)
    lower = sum(ch.islower() for ch in body)
    if len(body) >= 20 and digits >= 3 and upper >= 2 and lower >= 2 and body.count("/") <= len(body) // 12:
        return DENSE
    if "/" in body or body.count(".") >= 2:
        return PATH
    if len(body) >= 16 and digits >= 3 and upper + lower >= 3:
        return LONG
    if digits and upper + lower:
        return MIXED if len(body) >= MIXED_LEAST else TINY
    return NAME


#: Characters from which on a token of letters and digits is MIXED; a shorter one is TINY.
MIXED_LEAST = 6
_MARKED = re.compile(r"[!#$%^&*~?@]")


def _marked(body: str) -> int:
    """The class of a token with inner marks: STRONG as passwords are made, PATH as queries of addresses are, else NAME."""
    if "&" in body and "=" in body or "/" in body:
        return PATH
    kinds = sum(any(test(ch) for ch in body) for test in (str.isdigit, str.isupper, str.islower)) + 1
    return STRONG if len(body) >= MIXED_LEAST and kinds >= 3 and any(ch.isalpha() for ch in body) else NAME


def file_features(text: str) -> np.ndarray:
    """Whether the file looks like settings, like code, like prose."""
    head = text.count("=") + text.count(":")
    lines = text.count("\n") + 1
    return np.array([float(head >= lines), float(text.count(";") + text.count("{") >= lines / 2), float(head * 10 < lines)])


def near_words(classes: list[int], tokens: list[str]) -> np.ndarray:
    """For each token, whether a word for a secret (or the start of an address) and a word against one stand among the NEAR tokens before it."""
    out = np.zeros((len(classes), NEAR_FEATURES))
    for i, (c, t) in enumerate(zip(classes, tokens, strict=True)):
        if c == CUE or t.startswith("//"):  # behind // an address may have a login
            out[i + 1 : i + 1 + NEAR, 0] = 1
        if _AGAINST.fullmatch(t.rstrip("=:.")):
            out[i + 1 : i + 1 + NEAR, 1] = 1
    return out


#: What is added to the tags' scores by class: B is for KEYS alone, I for fences alone.
BARRED = np.array([[0.0, 0.0 if c in KEYS else -1e6, 0.0 if c == FENCE else -1e6] for c in range(CLASSES)])


class Field:
    """Weights of the field."""

    def __init__(self, rng_seed: int = 11, steps: int = 100, rate: float = 0.5):
        lines = _examples(random.Random(rng_seed), LINES)
        self.own = np.zeros((CLASSES, 3))
        self.before = np.zeros((CLASSES, 3))
        self.after = np.zeros((CLASSES, 3))
        self.near = np.zeros((NEAR_FEATURES, 3))
        self.file = np.zeros((FILE_FEATURES, 3))
        self.move = np.zeros((3, 3))
        self.first = np.zeros(3)
        self._fit(lines, steps, rate)
        self.taggable = np.isin(np.arange(CLASSES), KEYS)

    def emissions(self, classes: np.ndarray, near: np.ndarray, file: np.ndarray) -> np.ndarray:
        padded = np.concatenate([[EDGE], classes, [EDGE]])
        return self.own[classes] + BARRED[classes] + self.before[padded[:-2]] + self.after[padded[2:]] + near @ self.near + file @ self.file

    def _fit(self, lines: list["Line"], steps: int, rate: float) -> None:
        n, width = len(lines), max(len(x.classes) for x in lines)
        cls = np.full((n, width + 2), EDGE)
        tag = np.zeros((n, width), np.int64)
        real = np.zeros((n, width), bool)
        near = np.zeros((n, width, NEAR_FEATURES))
        for r, x in enumerate(lines):
            m = len(x.classes)
            cls[r, 1 : m + 1], tag[r, :m], real[r, :m], near[r, :m] = x.classes, x.tags, True, x.near
        file = np.array([x.file for x in lines])
        eye = np.eye(3)
        gold = eye[tag] * real[..., None]
        gold_move = np.einsum("ntp,ntq->pq", gold[:, :-1], gold[:, 1:])
        velocity = None
        for _ in range(steps):
            e = self.own[cls[:, 1:-1]] + BARRED[cls[:, 1:-1]] + self.before[cls[:, :-2]] + self.after[cls[:, 2:]] + near @ self.near + (file @ self.file)[:, None, :]
            forward = np.zeros((n, width, 3))
            backward = np.zeros((n, width, 3))
            forward[:, 0] = self.first + e[:, 0]
            for t in range(1, width):
                x = forward[:, t - 1, :, None] + self.move
                step = np.logaddexp.reduce(x, axis=1) + e[:, t]
                forward[:, t] = np.where(real[:, t, None], step, forward[:, t - 1])
            for t in range(width - 2, -1, -1):
                x = self.move + (e[:, t + 1] + backward[:, t + 1])[:, None, :]
                backward[:, t] = np.where(real[:, t + 1, None], np.logaddexp.reduce(x, axis=2), 0)
            total = np.logaddexp.reduce(forward[:, -1], axis=1)
            prob = np.exp(forward + backward - total[:, None, None]) * real[..., None]
            pair = np.exp(forward[:, :-1, :, None] + self.move + (e[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]) * real[:, 1:, None, None]
            diff = gold - prob
            flat = diff.reshape(-1, 3)
            grads = []
            for c in (cls[:, 1:-1], cls[:, :-2], cls[:, 2:]):
                g = np.zeros((CLASSES, 3))
                np.add.at(g, c.ravel(), flat)
                grads.append(g)
            grads += [np.einsum("ntf,ntp->fp", near, diff), file.T @ diff.sum(1), gold_move - pair.sum((0, 1)), diff[:, 0].sum(0)]
            weights = [self.own, self.before, self.after, self.near, self.file, self.move, self.first]
            if velocity is None:
                velocity = [np.zeros_like(w) for w in weights]
            for w, g, v in zip(weights, grads, velocity, strict=True):
                v *= 0.9
                v += rate * (g / n - 0.0005 * w)
                w += v

    def decode(self, classes: np.ndarray, near: np.ndarray, file: np.ndarray) -> np.ndarray:
        """The best tags (Viterbi)."""
        e = self.emissions(classes, near, file).tolist()
        m = self.move.tolist()
        best = [self.first[k] + e[0][k] for k in range(3)]
        back = []
        for row in e[1:]:
            new, came = [], []
            for k in range(3):
                a, b, c = best[0] + m[0][k], best[1] + m[1][k], best[2] + m[2][k]
                j = 0 if a >= b and a >= c else 1 if b >= c else 2
                came.append(j)
                new.append((a, b, c)[j] + row[k])
            best = new
            back.append(came)
        k = int(np.argmax(best))
        tags = [k]
        for came in reversed(back):
            k = came[k]
            tags.append(k)
        return np.array(tags[::-1])


@dataclass
class Line:
    """A generated line: its tokens' classes, tags and near words, and the features of its file."""

    classes: list[int]
    tags: list[int]
    near: np.ndarray
    file: np.ndarray


def _examples(rng: random.Random, count: int) -> list[Line]:
    """Generated lines with tags: settings, code, logs and prose, with and without secrets."""
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def key(n: int, chars: str = alnum) -> str:
        return "".join(rng.choice(chars) for _ in range(n))

    def word() -> str:
        return "".join(rng.choice(("an", "er", "ti", "on", "re", "le", "sch", "ue", "ment", "ing", "o", "a")) for _ in range(rng.randint(1, 5)))

    def secret() -> str:
        return rng.choice((lambda: "ghp_" + key(36), lambda: "sk_live_" + key(24), lambda: "xoxb-" + key(11, "0123456789") + "-" + key(24), lambda: "AIza" + key(35), lambda: key(40, alnum + "+/"), lambda: key(32), lambda: "eyJ" + key(20) + "." + key(40) + "." + key(30), lambda: "glpat-" + key(20), lambda: "sk-proj-" + key(40)))()

    def harmless() -> str:
        return rng.choice((lambda: word() + str(rng.randint(1, 999)), lambda: f"v{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}", lambda: "/".join(word() for _ in range(4)), lambda: str(rng.randint(10**9, 10**16)), lambda: "-".join(key(n, "0123456789abcdef") for n in (8, 4, 4, 4, 12)), lambda: f"{word()}_{word()}", lambda: f"mail{rng.randint(1, 9)}.example.com", lambda: "".join(word() for _ in range(5)), lambda: word().upper() + "-" + str(rng.randint(1, 99999)) + "-" + word() + word(), lambda: f"{word().upper()}#{rng.randint(1, 9999)}", lambda: f"{word()}&{word()}", lambda: f"{rng.randint(1, 31)}th", lambda: f"{word()}@{word()}", lambda: f"{word()}={rng.randint(1, 99)}&{word()}={word()}", lambda: f"{rng.choice('ABMP')}{rng.randint(1, 99)}", lambda: f"2024-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}T1{rng.randint(0, 9)}"))()

    def short() -> str:
        """Passwords and short keys, as people and programs make them."""
        marks = "!#$%&*?@^~"
        made = rng.choice((lambda: key(rng.randint(3, 9)) + key(2, "0123456789") + key(rng.randint(2, 9)), lambda: word().capitalize() + key(rng.randint(2, 4), "0123456789") + rng.choice(marks) + key(rng.randint(1, 3)), lambda: key(rng.randint(3, 6)) + rng.choice(marks) + key(rng.randint(3, 6)) + key(1, "0123456789"), lambda: key(1, "ABCDEFGHIJ") + rng.choice(marks) + word() + key(2, "0123456789"), lambda: word() + key(rng.randint(3, 5), "0123456789") + key(2)))()
        return made if any(c.isdigit() for c in made) else made + key(1, "0123456789") + "x"

    def digest() -> str:
        return rng.choice((lambda: key(40, alnum + "+/"), lambda: key(32), lambda: key(20), lambda: key(rng.randint(6, 10), "0123456789abcdef")))()

    names = ("API_KEY", "client_secret", "auth", "bearer", "password", "access_key", "credential", "token", "DB_PASS", "passphrase", "pwd", "key", "login")
    lines = []
    against = ("commit", "sha256", "checksum:", "uuid", "build", "trace", "id:", "revision", "etag")
    for _ in range(count):
        kind = rng.random()
        prose = [word() for _ in range(rng.randint(0, 8))]
        if rng.random() < 0.3:  # tables and marked prose
            prose = [x for w in prose for x in (w, *rng.choice((("|",), ("*", "*", "*"), ("#",) * 3, ("!", "!"), ("&",) * 3, (",",))))]
        if kind < 0.25:
            mark = rng.choice((['='], [':'], [':', '"'], ['=', "'"]))
            parts = [(rng.choice(names), 0), *((m, 0) for m in mark), (short() if rng.random() < 0.3 else secret(), 1), *((m, 0) for m in mark[1:])]
            file = np.array([1.0, float(rng.random() < 0.5), 0.0])
        elif kind < 0.4:
            told = [rng.choice(names), *rng.choice((["is"], ["was", "set", "to"], [":"], [], [":", '"'], ["=", "'"], [word(), ":"]))] if rng.random() < 0.6 else []
            if told and rng.random() < 0.15:  # an address with a login in it
                told = [word(), ":", "//" + word(), ":"]
                parts = [*((w, 0) for w in (*prose, *told)), (short(), int(True)), ("@", 0), (word() + ".example.com", 0)]
            else:
                parts = [*((w, 0) for w in (*prose, *told)), (short() if told and rng.random() < 0.6 else secret(), 1), *((word(), 0) for _ in range(rng.randint(0, 5)))]
            file = np.array([0.0, 0.0, 1.0])
        elif kind < 0.47:  # mail addresses, which a token and a host are too
            told = rng.choice(([], ["mail"], ["contact", ":"], ["write", "to"], ["<"], [":"]))
            parts = [*((w, 0) for w in (*prose, *told)), (rng.choice((f"{word()}.{rng.randint(0, 99):02d}", f"{word()}{rng.randint(1, 999)}", f"{word()}.{word()}", f"{word()}_{rng.randint(1, 9)}")), 0), ("@", 0), (rng.choice((f"mail{rng.randint(0, 9)}.example.com", f"{word()}.{word()}", f"{word()}{rng.randint(1, 99)}.org")), 0), *((word(), 0) for _ in range(rng.randint(0, 5)))]
            file = np.array([0.0, 0.0, float(rng.random() < 0.7)])
        elif kind < 0.5:  # a private key's fence
            parts = [(f"-----BEGIN {rng.choice(('', 'RSA ', 'EC ', 'OPENSSH '))}PRIVATE KEY-----", 1)]
            file = np.array([float(rng.random() < 0.5), 0.0, float(rng.random() < 0.5)])
        elif kind < 0.7:
            told = [rng.choice(against), *rng.choice((["is"], []))] if rng.random() < 0.3 else []
            parts = [*((w, 0) for w in (*prose, *told)), (digest() if told and rng.random() < 0.5 else harmless(), 0), *((word(), 0) for _ in range(rng.randint(0, 5)))]
            file = np.array([0.0, 0.0, 1.0])
        elif kind < 0.85:
            told = rng.random() < 0.5  # a plain word is no secret, whatever stands before it
            parts = [(rng.choice(names) if told else word(), 0), (rng.choice("=:"), 0), *([("'", 0)] if told and rng.random() < 0.5 else []), ("".join(word() for _ in range(rng.randint(1, 4))) if told else harmless(), 0)]
            file = np.array([1.0, float(rng.random() < 0.5), 0.0])
        else:
            # far from the word that names a secret, and small things right behind it, there is none
            far = [(word(), 0) for _ in range(NEAR)] + [(harmless(), 0)] if rng.random() < 0.4 else [(rng.choice((f"{rng.randint(1, 31)}th", f"{rng.choice('ABMP')}{rng.randint(1, 9)}", str(rng.randint(1, 99)))), 0)] if rng.random() < 0.3 else []
            parts = [*((w, 0) for w in prose), (rng.choice(names).lower(), 0), *far, *((word(), 0) for _ in range(rng.randint(1, 5)))]
            file = np.array([0.0, 0.0, float(rng.random() < 0.7)])
        classes = [shape(t) for t, _ in parts]
        lines.append(Line(classes, [g for _, g in parts], near_words(classes, [t for t, _ in parts]), file))
    return lines


def held_out(model: Field, seed: int = 12, count: int = 2000) -> tuple[float, float]:
    """Precision and recall of the field's secrets on generated lines that it has not seen."""
    said = right = true = 0
    for x in _examples(random.Random(seed), count):
        tags = model.decode(np.array(x.classes), x.near, x.file)
        said += int((tags == 1).sum())
        true += x.tags.count(1)
        right += sum(a == b == 1 for a, b in zip(tags.tolist(), x.tags, strict=True))
    return right / max(1, said), right / max(1, true)


_field: Field | None = None


def field() -> Field:
    """The fitted field (the fit is the same in every process, so workers get it by broadcast and tests by this)."""
    global _field
    if _field is None:
        _field = Field()
    return _field


def _runs(of: bytes) -> bytes:
    """A byte table with x for the bytes `of`."""
    return bytes(120 if b in of else 32 for b in range(256))


_HEX_RUNS = _runs(b"0123456789abcdef")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, sorted."""
    out = []
    raw = text.encode()
    for m in ASSIGN.finditer(text) if "=" in text or ":" in text else ():
        if m.end(2) - m.start(2) >= ASSIGN_LEAST:
            out.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if raw.translate(_HEX_RUNS).find(b"x" * HEX_LEAST) >= 0:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def crf_spans(model: Field, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans of the method beside the base ones."""
    found: list[tuple[int, int]] = []
    file = None
    line_end = -1
    for m in SUSPECT.finditer(text):
        if m.start() < line_end:
            continue
        lo = text.rfind("\n", 0, m.start()) + 1
        hi = text.find("\n", m.start())
        line_end = hi = len(text) if hi < 0 else hi
        tokens = [(t.start() + lo, t.end() + lo, shape(t.group())) for t in TOKEN.finditer(text[lo:hi])]
        classes = [c for _, _, c in tokens]
        if not any(model.taggable[c] for c in classes):
            continue
        file = file_features(text) if file is None else file
        tags = model.decode(np.array(classes), near_words(classes, [text[s:e] for s, e, _ in tokens]), file).tolist()
        open_ = False
        for (s, e, _), tag in zip(tokens, tags, strict=True):
            if tag == 1 or (tag == 2 and not open_):
                found.append((s, e))
            elif tag == 2:
                found[-1] = (found[-1][0], e)
            open_ = tag != 0
    if not found or not base:
        return found
    out, i, reach = [], 0, 0
    for s, e in found:  # both lists are sorted by start
        while i < len(base) and base[i][0] < e:
            reach = max(reach, base[i][2])
            i += 1
        if reach <= s:
            out.append((s, e))
    return out


def spans(model: Field, text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    text = text or ""
    base = base_spans(text)
    return base, crf_spans(model, text, base)


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(f"n_{k}", T.LongType(), False) for k in KINDS), T.StructField("base_sha256", T.StringType(), False), T.StructField("spans", T.StringType(), False)])


def scan(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(field())

    def run(batches):
        model = shared.value
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                base, more = spans(model, text.as_py())
                told = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
                every = sorted([(s, k, e) for s, k, e in base] + [(s, len(KINDS), e) for s, e in more])
                kinds = [k for _, k, _ in base]
                rows.append((doc_id, kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(told.encode()).hexdigest(), ",".join(f"{(*KINDS, 'crf')[k]}:{s}:{e}" for s, k, e in every)))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(cols, (pa.int64(),) * 4 + (pa.string(),) * 2, strict=True)], names=SCHEMA.names)

    return id_text(docs).mapInArrow(run, SCHEMA)


#: What stands in a text in place of a secret.
REDACTED = "[secret]"


def redact(docs: DataFrame) -> DataFrame:
    """docs with all its columns; each span in text, base or the method's, becomes REDACTED, and n_chars follows where there is one of whole numbers (of any other type it stays as it is)."""
    shared = docs.sparkSession.sparkContext.broadcast(field())
    schema = docs.schema
    whole = [i for i, f in enumerate(schema.fields) if f.name == "n_chars" and isinstance(f.dataType, (T.IntegerType, T.LongType))]
    at, count = schema.names.index("text"), whole[0] if whole else None

    def run(batches):
        model = shared.value
        for batch in batches:
            texts, changed = [], []
            for t in batch.column(at):
                text = t.as_py()
                base, more = spans(model, text)
                every = sorted([(s, e) for s, _, e in base] + more)
                if every:
                    out, last = [], 0
                    for s, e in every:
                        if s >= last:
                            out += [text[last:s], REDACTED]
                        last = max(last, e)
                    text = "".join([*out, text[last:]])
                texts.append(text)
                changed.append(bool(every))
            cols = list(batch.columns)
            cols[at] = pa.array(texts, pa.string())
            if count is not None:
                cols[count] = pa.array([len(t) if c else n for t, c, n in zip(texts, changed, cols[count].to_pylist(), strict=True)], cols[count].type)
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.mapInArrow(run, schema)
