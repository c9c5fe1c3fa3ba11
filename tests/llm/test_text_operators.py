"""Packing, BPE, sharding and fingerprints against the plain computation, on odd rows and on the given documents."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
from conftest_llm import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from patchwell.llm import bpe, fingerprints, packing, sharding
from pyspark.sql import functions as F
from tokenizers import Tokenizer

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", "it's 'LL  don't 123 45ab ??!..", "ΑΣ ΣΟΣ Σ İ ǅ ﬁ", "a<|endoftext|>B<|startoftext|> c", "aaaaaaaaaaaaaaa aaa aa", "x²₃½Ⅷ é é Ä̈", "\x00\x01\t\r\n end ", "हिन्दी ไทย 🙂🙂"]


CODEC, LIBRARY = bpe.WordBpe(WORDS), Tokenizer.from_file(WORDS)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


def library_ids(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), max_size=7), st.integers(0, 60))
def test_fullest_is_the_best_subset(available, room):
    pool = [k for k, n in available.items() for _ in range(min(n, 3))]
    chosen = packing.fullest({k: min(n, 3) for k, n in available.items()}, room)
    best = max(s for r in range(len(pool) + 1) for c in (itertools.combinations(pool, r) if len(pool) < 9 else [()]) if (s := sum(c)) <= room)
    assert sum(chosen) <= room and not Counter(chosen) - Counter(pool) and (len(pool) >= 9 or sum(chosen) == best)


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=30))
def test_every_piece_has_one_place(histogram):
    plan = packing.plan_bins(histogram, 64)
    placed = Counter()
    for _, times, pattern in plan:
        assert sum(pattern) <= 64
        placed.update({k: times * n for k, n in Counter(pattern).items()})
    assert placed == Counter(histogram) and len(plan) <= 8 * max(1, len(histogram))


def check_packing(rows, texts):
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_bin.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_bin.values():
        ends = list(itertools.accumulate(n for _, n in sorted(places)))
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 1024
    tokenizer = Tokenizer.from_file(BYTES)
    for key, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = {(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[key]}
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids), 1024), len(ids)]
        assert own == {(n, a, b - a, zlib.crc32(ids[a:b].tobytes())) for n, (a, b) in enumerate(itertools.pairwise(cuts))}
    return len(by_bin)


def test_packing_of_documents_and_odd_rows(spark, odd, none):
    docs = documents(spark)
    rows = packing.pack_documents(docs, BYTES).collect()
    bins = check_packing(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert bins <= 1.02 * sum(r["length"] for r in rows) / 1024 + 2
    check_packing(packing.pack_documents(odd, BYTES).collect(), {(r["doc_id"], r["text"]) for r in odd.collect()})
    assert packing.pack_documents(none, BYTES).count() == 0
    kept = packing.pack_documents(odd.where("doc_id = 4"), BYTES, keep_ids=True).first()
    assert list(np.frombuffer(kept["ids"], "<u4")) == [*library_ids(BYTES, "One short line."), 2]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_and_decoding_as_the_library(text):
    t = Tokenizer.from_file(WORDS)
    ids = t.encode(text, add_special_tokens=False).ids
    codec = bpe.WordBpe(WORDS)
    n, joined, decoded = codec.encode([text])[0]
    assert joined == " ".join(map(str, ids)) and n == len(ids) and decoded == t.decode(ids, skip_special_tokens=False) == codec.decode(ids)
    assert list(np.frombuffer(packing.ByteBpeEncoder(BYTES).encode(text), "<u4")) == library_ids(BYTES, text)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_any_text_encodes_as_the_library(texts):
    codec, library = CODEC, LIBRARY
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert [g[1] for g in codec.encode(texts)] == [" ".join(map(str, library.encode(t, add_special_tokens=False).ids)) for t in texts]


def test_codec_over_tables(spark, odd, none):
    t = Tokenizer.from_file(WORDS)
    for docs in (documents(spark), odd):
        texts = Counter((r["doc_id"], r["text"]) for r in docs.collect())
        want = Counter()
        for (key, text), n in texts.items():
            ids = t.encode(text or "", add_special_tokens=False).ids
            digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
            want[key, len(ids), digest(" ".join(map(str, ids))), digest(t.decode(ids, skip_special_tokens=False))] += n
        assert Counter(map(tuple, bpe.digest_documents(docs, WORDS).collect())) == want
    assert bpe.digest_documents(none, WORDS).count() == 0


def check_shards(rows, shards, tolerance):
    sizes, slots = Counter(), {}
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["size"] == 8 + len((r["text"] or "").encode())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, largest = sum(sizes.values()) / shards, max((r["size"] for r in rows), default=0)
    assert all(abs(sizes[s] - mean) <= tolerance * mean + largest for s in range(shards))


def test_shards_have_near_equal_bytes(spark, odd, none):
    docs = documents(spark)
    rows = sharding.histogram_shards(docs, 6).collect()
    assert len(rows) == docs.count() and {r["shard"] for r in rows} == set(range(6))
    check_shards(rows, 6, 0.01)
    check_shards(sharding.histogram_shards(docs, 3, part_bytes=20_000).collect(), 3, 0.01)
    assert len(sharding.histogram_shards(odd, 4).collect()) == odd.count()
    assert sharding.histogram_shards(none, 4).count() == 0


def test_a_third_of_all_rows_with_one_text_is_cut_by_id(spark):
    docs = spark.range(900).selectExpr("id as doc_id", "case when id % 3 = 0 then 'the hot text' else concat('text ', id) end as text")
    rows = sharding.histogram_shards(docs, 9).collect()
    check_shards(rows, 9, 0.02)
    assert Counter(r["doc_id"] for r in rows) == Counter(range(900))


@pytest.mark.parametrize("key", [None, 7])
def test_a_third_of_all_rows_with_one_text_and_id_is_cut(spark, key):
    rows = [(key, "the hot text")] * 300 + [(i, f"text {i}") for i in range(100, 700)]
    got = sharding.histogram_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 9).collect()
    check_shards(got, 9, 0.02)
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)


def test_places_are_those_of_sorted_keys():
    rng = np.random.default_rng(1)
    keys = sorted({tuple(int(x) for x in k) for k in rng.integers(0, 4, (30, 3))} | {(2, sharding.LOW, sharding.LOW), (1, 2, sharding.LOW)})
    rows = rng.integers(0, 5, (500, 3))
    got = sharding.place([np.ascontiguousarray(rows[:, i]) for i in range(3)], np.array(keys, np.int64))
    assert got.tolist() == [sum(k <= tuple(r) for k in keys) for r in rows.tolist()]


@pytest.mark.parametrize("text", ["x" * 5000, "ab" * 999 + "äöü" * 400, "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(30_000)), "qu" + "aaab" * 2000 + " then " + "thequickbrownfox" * 300])
def test_long_words_are_the_librarys(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert CODEC.encode([text, "a " + text])[0][1] == " ".join(map(str, want)) and not [w for w in CODEC.known if len(w) > bpe.LONG]


def pieces(text):
    return {s[i:i + fingerprints.PIECE] for s in re.split(r"(?<=[.\n])", text) for i in range(0, len(s), fingerprints.PIECE)}


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def peeled(spark, pairs):
    """Likeness of written fingerprints (key, a, b) from these strings alone; None where they do not peel."""
    df = spark.createDataFrame(pairs, "key long, a string, b string")
    read = {r["key"]: (r["x"], r["y"]) for r in df.select("key", fingerprints.cells_of(F.col("a")).alias("x"), fingerprints.cells_of(F.col("b")).alias("y")).collect()}
    out = {}
    cells = {k: {} for k in read}
    for k, (x, y) in read.items():
        for sign, side in ((1, x), (-1, y)):
            for c in side:
                n, d, h = cells[k].get(c["cell"], (0, 0, 0))
                cells[k][c["cell"]] = (n + sign * c["count"], d ^ c["key"], h ^ c["chk"])
    known = {}

    def learn(wanted):
        rows = spark.createDataFrame([(d,) for d in wanted - set(known)], "d long").withColumn("width", F.lit(fingerprints.WIDTH))
        for r in rows.select("d", fingerprints.check(F.col("d")).alias("h"), F.array(*[fingerprints.cell_of(F.col("d"), t, 0) for t in range(3)]).alias("at")).collect():
            known[r["d"]] = (r["h"] & 0xFFFFFFFF, r["at"])

    more, less = dict.fromkeys(read, 0), dict.fromkeys(read, 0)
    while True:
        learn({d for of in cells.values() for n, d, _ in of.values() if abs(n) == 1})
        moved = False
        for k, of in cells.items():
            for at, (n, d, h) in list(of.items()):
                if abs(of[at][0]) != 1 or of[at] != (n, d, h) or known[d][0] != h or at not in known[d][1]:
                    continue
                moved, more[k], less[k] = True, more[k] + (n > 0), less[k] + (n < 0)
                for c in known[d][1]:
                    m, e, g = of.get(c, (0, 0, 0))
                    of[c] = (m - n, e ^ d, g ^ h)
        if not moved:
            break
    for k, (x, _) in read.items():
        size = sum(c["count"] for c in x if c["cell"] < fingerprints.WIDTH)
        union = size + less[k]
        out[k] = None if any(v != (0, 0, 0) for v in cells[k].values()) else (size - more[k]) / union if union else 1.0
    return out


def test_written_fingerprints_give_the_likeness(spark):
    """Two strings are all that is needed: they subtract and peel to the likeness that is returned."""
    rows = sorted(fingerprints.fingerprints(documents(spark)).collect(), key=lambda r: -r["doc_id"])
    edited = peeled(spark, [(r["doc_id"], r["fingerprint"], r["edited_fingerprint"]) for r in rows])
    after = peeled(spark, [(r["doc_id"], r["fingerprint"], rows[(i + 1) % len(rows)]["fingerprint"]) for i, r in enumerate(rows)])
    for name, got in (("near_edited", edited), ("near_next", after)):
        whole = [r for r in rows if got[r["doc_id"]] is not None]
        print(name, len(whole), len(rows))
        assert whole and all(got[r["doc_id"]] == pytest.approx(r[name]) for r in whole)


def test_hot_and_null_ids_are_cut(spark):
    rows = [(None, f"null {i}.") for i in range(300)] + [(7, f"seven {i}.") for i in range(300)] + [(i * 10 ** 9, f"text {i}.") for i in range(-150, 150)]
    docs = spark.createDataFrame(rows, "id long, text string").fillna({"id": fingerprints.LOWEST})
    per = fingerprints.with_next(docs, 30, 1000).groupBy("bucket").count().collect()
    assert max(r["count"] for r in per) < 75 and sum(r["count"] for r in per) == 900
    hashes = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = [t for _, _, t in sorted((-(fingerprints.LOWEST if i is None else i), hashes[t], t) for i, t in rows)]
    got = {r["text"]: r["next_text"] for r in fingerprints.with_next(docs, 30, 1000).collect()}
    assert got == {t: order[(i + 1) % len(order)] for i, t in enumerate(order)}


@pytest.mark.parametrize("rounds", [9, 3])
def test_sketches_recover_all_differences(spark, rounds):
    docs = documents(spark)
    texts = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs, rows_per_bucket=30, rounds=rounds).collect()}  # few rounds: many are stuck and tried again
    assert len(got) == len(texts)
    for i, (key, text) in enumerate(texts):
        after, third, r = texts[(i + 1) % len(texts)][1], len(text) // 3, got[key]
        edited = text[:len(text) - third] + after[:third]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(alike(pieces(text), pieces(edited))) and r["near_next"] == pytest.approx(alike(pieces(text), pieces(after)))
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (pieces(text) == pieces(edited))


def test_fingerprints_of_odd_rows(odd, none):
    rows = fingerprints.fingerprints(odd).collect()
    assert len(rows) == odd.count() and fingerprints.fingerprints(none).count() == 0
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[4][0]["fingerprint"] == by[6][0]["fingerprint"] and by[12][0]["near_next"] == 1.0 and by[1][0]["n_chars"] == 0
    assert len({r["fingerprint"] for r in by[7]}) == 1 and None in by
    alone = fingerprints.fingerprints(odd.where("doc_id = 5")).first()
    assert alone["near_next"] == 1.0
