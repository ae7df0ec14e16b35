"""Licence scan, conversation trie and fill-in-the-middle against plain versions, with odd rows."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from graphwarden.llm import fill_in_middle, license_scan, prefix_trie, queries

DATA = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "é😀 one"), (5, "one two three " * 40), (5, "one two three " * 40), (5, "again"), (None, "no id"), (6, "a" * 30_000), (-7, "has a <M> mark"), (8, "<S" + "S> < P> é\n" * 3), (9, "x\x00y 1\r\n2" * 9)]


def odd(spark):
    return spark.createDataFrame([(*r, "en", 1, "x", "y") for r in ODD], "doc_id long, text string, lang string, n long, form string, labels string")


# Fill in the middle


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, len(units), "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}"
    return doc_id, len(units), "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_fim_equals_the_list_of_units(spark, docs):
    wanted = sorted((plain_fim(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=str)
    found = sorted((tuple(r) for r in fill_in_middle.transform(docs).collect()), key=str)
    assert found == wanted
    assert {f for _, _, f, *_ in found} == {"plain", "psm", "spm"}


def test_fim_of_odd_rows_and_round_trip(spark):
    frame = odd(spark)
    out = fill_in_middle.transform(frame)
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted((plain_fim(*r) for r in ODD), key=str)
    back = out.select("doc_id", fill_in_middle.restored(F.col("form"), F.col("output")).alias("text"))
    assert sorted((tuple(r) for r in back.collect()), key=str) == sorted(((i, t or "") for i, t in ODD), key=str)
    assert fill_in_middle.digest(frame.where("false")).count() == 0


def test_fim_restores_texts_that_end_in_parts_of_marks(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(["<", "P", "S", "M", ">", "<S", " ", "é"]) for _ in range(rng.randint(0, 12)))) for i in range(600)]
    out = fill_in_middle.transform(spark.createDataFrame(rows, "doc_id long, text string"))
    back = {r.doc_id: r.text for r in out.select("doc_id", fill_in_middle.restored(F.col("form"), F.col("output")).alias("text")).collect()}
    assert back == dict(rows)
    assert fill_in_middle.unit_ends("ab1 c", 0, 0) == (0, 0) and fill_in_middle.unit_ends("ab1 c", 1, 4) == (2, 5) and fill_in_middle.unit_ends("ab1 c", 2, 2) == (3, 3)


# Licence scan


def words_of(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())


def plain_phrases(text):
    w = words_of(text)
    told = sorted((i, label) for p, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.encode().split())
    return len(w), len(told), min((i for i, _ in told), default=None), max((i for i, _ in told), default=None), ",".join(sorted({x for _, x in told}))


def test_base_phrases_equal_a_search_of_every_place(spark, docs):
    rng = random.Random(2)
    vocabulary = ["cc", "by", "CC-BY", "general", "public", "license", "all", "rights", "reserved", "nc", "GNU", "été", "x"]
    made = [(10**6 + i, " ".join(rng.choice(vocabulary) + rng.choice(["", ".", "\n"]) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + made + ODD
    found = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r)[:6] for r in found.collect()), key=str) == sorted(((i, *plain_phrases(t)) for i, t in rows), key=str)


def test_matching_statistics_equal_brute_force():
    rng = random.Random(7)
    for _ in range(60):
        alphabet = [bytes([97 + i]) for i in range(rng.randint(1, 4))]
        texts = [b" ".join(rng.choice(alphabet) for _ in range(rng.randint(1, 14))).decode() for _ in range(rng.randint(1, 4))]
        automaton = license_scan.Automaton({}, {"t": texts})
        parts = [t.encode().split() for t in texts]
        stream = [rng.choice([*alphabet, b"zz"]) for _ in range(40)]
        runs = []

        class Seen:
            def __init__(self, _):
                pass

            def add(self, end, size, places):
                runs.append((end, size, places))

            def finish(self):
                return []

        held, license_scan.Chains = license_scan.Chains, Seen
        try:
            automaton.stream(re.compile(rb"\S+").finditer(b" ".join(stream)))
        finally:
            license_scan.Chains = held

        def has(run):
            return [(t, k + len(run)) for t, p in enumerate(parts) for k in range(len(p) - len(run) + 1) if p[k : k + len(run)] == run]

        longest = [max(n for n in range(i + 2) if n == 0 or has(stream[i + 1 - n : i + 1])) for i in range(len(stream))]
        wanted = [(i + 1, n, tuple(sorted(has(stream[i + 1 - n : i + 1])))) for i, n in enumerate(longest) if n >= license_scan.LONG and (i + 1 == len(stream) or longest[i + 1] != n + 1)]
        assert runs == wanted


def test_licences_are_found_wrapped_commented_and_edited(spark):
    rng = random.Random(11)
    prose = "the of and that in this is for with be are from harbour lantern quiet morning software any".split()
    rows, wanted = [], {}
    for label, texts in license_scan.TEMPLATES.items():
        for text in texts:
            words = text.split()
            for kind in range(4):
                told = list(words)
                if kind == 2 and len(told) > 30:  # a few words changed
                    for k in range(12, len(told), 25):
                        told[k] = "changed"
                if kind == 3 and len(told) > 60:  # words put in
                    told[30:30] = ["acme", "corporation", "inc"]
                body = " ".join(told) if kind == 0 else "\n * ".join(" ".join(told[k : k + 9]) for k in range(0, len(told), 9))
                head, tail = (" ".join(rng.choice(prose) for _ in range(rng.randint(0, 80))) for _ in range(2))
                rows.append((len(rows), f"{head}\n/* {body.upper() if kind == 1 else body}. */\n{tail}"))
                wanted[len(rows) - 1] = (label, len(words_of(head)), len(told))
    clean = [(10**6 + i, " ".join(rng.choice(prose) for _ in range(400))) for i in range(300)]
    found = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows + clean, "doc_id long, text string")).collect()}
    missed = [i for i, (label, start, size) in wanted.items() if not any(x.split(":")[0] == label and int(x.split(":")[1]) <= start + 3 and int(x.split(":")[2]) >= start + size - 3 for x in found[i].spans.split(","))]
    assert not missed
    assert all(label in found[i].labels.split(",") and 0.5 <= found[i].score <= 1 for i, (label, *_) in wanted.items())
    assert all(not found[i].labels and found[i].score == 0 for i, _ in clean)


def test_licence_scan_of_odd_rows(spark):
    frame = odd(spark)
    found = license_scan.scan(frame).collect()
    assert len(found) == len(ODD) and license_scan.scan(frame.where("false")).count() == 0
    assert all(r.score == 0 and r.labels == "" and r.spans == "" for r in found)


# Conversation trie


def plain_trie(rows):
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            turns[conv].append((turn is not None, turn or 0, tie, role, text))
    own = {c: [(r, x) for *_, r, x in sorted(t)] for c, t in turns.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        remainder = abs(c) % 5 * (1 if c >= 0 else -1)
        built[c] = own.get(c - remainder, [])[:h] + own[c][h:]
    members = collections.defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids = collections.defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own_saved = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own_saved + sum(saved[k] for k in kids[node])
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
    out = []
    for node, cs in members.items():
        told = ",".join(str(c) for c in sorted(cs) if len(built[c]) == len(node))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(kids[node]), leaves[node], saved[node], hashlib.sha256(told.encode()).hexdigest()))
    return sorted(out, key=str)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
CONV = "conv_id long, turn long, role string, text string, depth int, n_convs string"


def told_trie(frame, **how):
    return sorted((tuple(r) for r in prefix_trie.trie(frame, **how).select(*TRIE).collect()), key=str)


@pytest.mark.parametrize("least_nodes", [1, 6, 64])
def test_trie_equals_brute_force(spark, least_nodes):
    rng = random.Random(least_nodes)
    rows = []
    for c in [*range(-12, 160), *rng.sample(range(10**9), 20)]:
        texts = ["é", "a", "", "long text " * 3, None]
        first = 0 if rng.random() < 0.6 else rng.randint(1, 3)  # most begin alike
        for k in range(rng.choice([0, 1, 1, 2, 3, 5, 12])):
            turn = rng.choice([k, k, k, None, 2])
            rows.append((c, turn, rng.choice(["user", None]) if k else "user", texts[first] if k < 2 else rng.choice(texts), 1, "x"))
    rows += [(None, 0, "user", "of none", 1, "x"), (400, 0, "user", "é", 1, "x"), (400, 0, "user", "é", 1, "x")]
    rng.shuffle(rows)
    assert told_trie(spark.createDataFrame(rows, CONV), least_nodes=least_nodes) == plain_trie([r[:4] for r in rows])


def test_trie_of_one_hot_conversation_a_deep_chain_and_nothing(spark):
    alike = [(c, 0, "user", "the same", 1, "x") for c in range(0, 30_000, 5)]
    deep = [(c, k, "user", f"turn {k}", 1, "x") for c in (10**7, 10**7 + 5) for k in range(300 + c % 7)]
    split = [(c, k, "user", f"turn {k}" if k < 40 else f"{c} {k}", 1, "x") for c in range(2 * 10**7, 2 * 10**7 + 300, 5) for k in range(42)]
    rows = alike + deep + split
    assert told_trie(spark.createDataFrame(rows, CONV), least_nodes=20) == plain_trie([r[:4] for r in rows])
    assert prefix_trie.trie(spark.createDataFrame([], CONV)).count() == 0
    assert told_trie(spark.createDataFrame([(7, None, None, None, 1, "x")], CONV)) == plain_trie([(7, None, None, None)])


def test_louds_parents_come_from_the_bits():
    import numpy as np

    rng = random.Random(3)
    for _ in range(50):
        n = rng.randint(1, 60)
        parent = [-1 if i == 0 or rng.random() < 0.1 else rng.randrange(i) for i in range(n)]
        level = [0] * n
        for i in range(n):
            level[i] = 0 if parent[i] < 0 else level[parent[i]] + 1
        key = list(range(n))
        order, bits, _ = prefix_trie.louds(np.array(level), np.array(key), np.array([n if p < 0 else p for p in parent]))
        up = prefix_trie.parents(bits)
        place = {int(row): i + 1 for i, row in enumerate(order)}
        assert bits.sum() == n and len(bits) == 2 * n + 1
        assert all(up[place[i] - 1] == (0 if parent[i] < 0 else place[parent[i]]) for i in range(n))


def test_registered_queries_read_whole_tables(spark):
    assert queries.op12_prefix_trie(spark, DATA).agg(F.max("n_convs")).first()[0] == spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id").distinct().count()
