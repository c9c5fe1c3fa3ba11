"""Suffix dedup, prefix trie and structure repair against brute force, on rows with every odd case."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import SF
from patchwell.llm import queries, repair, suffixes, tries
from pyspark.sql import functions as F

EMPTY = hashlib.sha256(b"").hexdigest()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def plain_dedup(docs, length=400):
    raws = [(t or "").encode() for _, t in docs]
    starts = Counter(r[i:i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (key, _), r in zip(docs, raws, strict=True):
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if starts[r[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((key, len(r), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def texts(seed):
    """Copies, edited copies, shared passages just below and above the length, cuts, periods, two- and three-byte characters."""
    rng = random.Random(seed)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    base, short, long, period = [some(900) for _ in range(4)], some(395), some(430), some(37)
    out = []
    for i in range(40):
        b = rng.choice(base)
        at = rng.randrange(450)
        out.append((i, [some(rng.randrange(900)), b, b[:at] + "#" + b[at + 1:], some(rng.randrange(300)) + short + some(rng.randrange(300)),
                        some(rng.randrange(300)) + long + some(rng.randrange(300)), some(rng.randrange(50)) + b[at:at + rng.randrange(390, 450)] + some(20),
                        period * rng.randrange(1, 30) + some(rng.randrange(50)), "ü" * rng.randrange(150, 260) + some(10) + "日本" * 80][i % 8]))
    return [*out, (None, None), (50, ""), (1, out[1][1]), (None, base[0])]


@pytest.mark.parametrize(("seed", "crowd"), [(1, 4096), (2, 2)])
def test_suffix_dedup_is_brute_force(spark, seed, crowd):
    docs = texts(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as pos", "'x' as k1", "2 as bucket", "'y' as kept")
    assert rows_of(suffixes.digest(suffixes.deduplicated(df, crowd=crowd))) == plain_dedup(docs)


def test_rows_of_one_gram_are_not_one_task(spark, monkeypatch):
    rng = random.Random(6)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    period = some(40)
    docs = [(i, some(300) + period * 60 + some(300)) for i in range(80)]
    share, write = {}, suffixes.materialize

    def watched(df, label):
        out = write(df, label)
        if label == "buckets":
            counts = [r[1] for r in df.groupBy(F.spark_partition_id()).count().collect()]
            share[label] = max(counts) / sum(counts)
        return out

    monkeypatch.setattr(suffixes, "materialize", watched)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # tables too large for Spark's own broadcasts
    try:
        assert rows_of(suffixes.digest(suffixes.deduplicated(df))) == plain_dedup(docs)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert share["buckets"] < 0.5


@pytest.mark.parametrize("how", ["inner", "left_semi"])
def test_met_is_the_plain_join(spark, how):
    rows = spark.sql("select if(id % 3 = 0, 7, id) as a, id as b from range(4000) union all select null, 1")
    counted = rows.groupBy("a").agg(F.count("*").alias("n")).where("n > 1 or a % 2 = 0")
    assert rows_of(suffixes.met(rows, counted, ["a"], "n", how)) == rows_of(rows.join(counted, "a", how))


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 512)
    rng = random.Random(3)
    text = "".join(rng.choice("abc") for _ in range(6000))
    whole = [x.tolist() for x in suffixes.anchors(text.encode())]
    monkeypatch.undo()
    assert whole == [x.tolist() for x in suffixes.anchors(text.encode())]


def test_every_string_has_its_anchor():
    rng = np.random.default_rng(4)
    for alphabet in (1, 2, 200):
        text = rng.integers(0, alphabet, 3000).astype(np.uint8).tobytes()
        at = suffixes.anchors(text)[0]
        gaps = np.diff(np.r_[-1, at, len(text) - suffixes.GRAM + 1])
        assert gaps.max() <= suffixes.DEPTHS


def test_suffix_query_on_given_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(queries.op11_suffix_dedup(spark, SF)) == plain_dedup(docs)


def plain_trie(rows):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            conv[c].append(((t is not None, t or 0), r or "", x or ""))
    conv = {c: [v[1:] for v in sorted(turns)] for c, turns in conv.items()}
    members, ends, kids, leaves, saved = defaultdict(set), defaultdict(list), defaultdict(set), {}, {}
    for c, own in conv.items():
        h = zlib.crc32(str(c).encode()) % 9
        seq = tuple(conv.get(c - c % 5, [])[:h] + own[h:])
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].add(c)
            if d:
                kids[seq[:d - 1]].add(seq[:d])
    for s in sorted(members, key=len, reverse=True):
        leaves[s] = sum(leaves[k] for k in kids[s]) if kids[s] else 1
        saved[s] = (len(members[s]) - 1) * (len(s[-1][1].encode()) if s else 0) + sum(saved[k] for k in kids[s])
    return sorted(((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(kids[s]), leaves[s], saved[s],
                    hashlib.sha256(",".join(map(str, sorted(ends[s]))).encode()).hexdigest()) for s, m in members.items()), key=str)


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("seed", "segment"), [(1, 32), (2, 3)])
def test_trie_is_brute_force(spark, monkeypatch, seed, segment):
    monkeypatch.setattr(tries, "SEGMENT", segment)
    rng, rows = random.Random(seed), []
    for c in range(60):
        for t in range(rng.choice([0, 1, 2, 5, 9, 12, 30])):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["hé", "a", "", "b" * rng.randrange(3), None])))
    rows += [(500, t, "user", "same") for t in range(300)] + [(501, t, "user", "same") for t in range(290)] + [*rows[:3], (None, 1, "user", "x")]
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 as id", "'x' as n1", "2 as rank", "'y' as key")
    assert rows_of(tries.prefix_trie(df)) == plain_trie(rows)


def test_trie_query_on_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries.op12_prefix_trie(spark, SF)) == plain_trie(rows)


def test_radix_nodes_grow_and_combine():
    rng, tree, plain = random.Random(5), tries.RadixTree(), defaultdict(lambda: [0, 10 ** 9])
    for i in range(3000):
        ids = [bytes([rng.randrange(256 if i % 2 else 30)]) + b"\0" * (tries.WIDTH - 1) for _ in range(rng.randrange(1, 4))]
        tree.insert(b"".join(ids), (1, i))
        for d in range(1, len(ids) + 1):
            have = plain[b"".join(ids[:d])]
            plain[b"".join(ids[:d])] = [have[0] + 1, min(have[1], i)]
    assert {k: list(v) for k, v in tree.turns()} == dict(plain)


def cheapest(rows):
    """Uniform-cost search by (cost, audit)."""
    after = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    turn, full = {"0": "u", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}
    heap, seen = [(0, "", 0, "0", ())], set()
    while heap:
        cost, audit, i, s, out = heapq.heappop(heap)
        if (i, s) in seen:
            continue
        seen.add((i, s))
        if i == len(rows) and s in "0a":
            return cost, audit, "\n".join(out)
        heapq.heappush(heap, (cost + 5, audit + "I", i, turn[s], (*out, full[turn[s]] + ":")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, s, out))
            if fault in (0, 3):
                extra, kept = 5 * (fault == 3), after.get((s, role[:1])) if role else s
                if kept:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, kept, (*out, f"{role}:{text}")))
                heapq.heappush(heap, (cost + extra + 1, audit + "R", i + 1, turn[s], (*out, f"{full[turn[s]]}:{text}")))


def plain_repair(rows):
    conv, out = defaultdict(list), []
    for c, t, r, x in rows:
        held = conv[c]
        role, text, draw = (" " if r is None else r), (" " if x is None else x), zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if draw:
            text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
            held += [(t is not None, t or 0, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    for c, held in conv.items():
        seen, marked = set(), []
        for _, _, role, text in sorted(held):
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            marked.append((role, text, 1 if not solid else 2 if (role, text) in seen else 3 if solid[-1] not in ".!?" else 0))
            seen.add((role, text))
        turns = [t for known, t, _, _ in held if known]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
        cost, audit, text = cheapest(marked) if marked else (0, "", "")
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[sum(f == k for _, _, f in marked) for k in (1, 2, 3)], illegal, cost, audit,
                    hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "segment"), [(1, 128), (2, 4)])
def test_repair_is_uniform_cost_search(spark, monkeypatch, seed, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rng, rows = random.Random(seed), []
    for c in range(150):
        for t in range(rng.choice([1, 2, 3, 6, 9, 14, 40])):
            rows.append((c, rng.choice([t, t, t, t + 1, None, t * 2]), rng.choice(["user", "assistant", "user", "assistant", "system", "", None, "tool", "ünder"]),
                         rng.choice(["Hi.", "ok", "  ", "Wow!\n", "no? ", f"x{rng.random()}.", "", None, f"y{rng.random()}"])))
    rows += [*rows[:5], (None, 1, "user", "x."), (None, 2, "assistant", "x.")]
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 as rank", "'x' as fault", "2 as segment", "'y' as draw")
    assert rows_of(repair.repairs(df)) == plain_repair(rows)


def test_repair_query_on_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries.op13_structure_repair(spark, SF)) == plain_repair(rows)


def test_empty_tables(spark, none):
    turns = spark.createDataFrame([], TURNS)
    assert suffixes.digest(suffixes.deduplicated(none)).collect() == tries.prefix_trie(turns).collect() == repair.repairs(turns).collect() == []


def test_odd_documents_keep_their_bytes(odd):
    got = suffixes.digest(suffixes.deduplicated(odd)).collect()
    assert len(got) == odd.count() and all(r["n_bytes"] >= r["n_removed"] for r in got)
    assert {r["kept_sha256"] for r in got if r["n_bytes"] == 0} == {EMPTY}
