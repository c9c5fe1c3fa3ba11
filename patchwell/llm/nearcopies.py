"""Near copies by ball hashing of wide SimHash fingerprints; the Jaccard similarity of whole shingle sets decides.

A text's fingerprint has ``BANDS`` bands of 32 bits, each bit the majority of one hash bit over the text's distinct
five-word shingles. With all but one band cleared, a fingerprint emits all variants of what is left within one bit, so
two texts meet where some band differs in at most two bits: 33 variants for each band, whatever the table. Two such bands
agree in one of three parts, so a row for each part moves and the variants are made where it arrives. Texts that
meet are candidates; they are linked where their sets (64-bit hashes) are at least ``LEAST`` alike, decided on the whole
sets. Only distinct shingle sets take part, so thousands of copies are one of them, and of places with the same members
only one is worked on. In each place the member that is in most places is compared with all others; of places that these
links leave in more than one component, the members outside the smallest one's are then compared with all, in blocks of fixed size.

As the table grows, more unlike texts meet by chance. Two exact bounds drop these before any set is moved: alike sets
differ by at most a factor of 1.25 in size, and the leading bits of an ``fp`` are the class of that size; and their
parities (how many hashes fall into each of some cells, odd or even) differ in at most a ninth of the sizes together.
Whole texts move only if a bitmap of fixed size does not rule them out: to fetch sets, and to drop what goes.

A bit differs with a chance of arccos(2 J / (1 + J)) / pi, so pairs right at 0.8 meet with a chance of about 0.7, at 0.85 of
0.9, at 0.9 of 0.98; chains and groups are joined through any of their links. README has measured shares.

Defined results: null texts and those without words have the empty set and are one component; fewer words than a
shingle make one shingle of what is there; repeated rows share a component; a null id is carried; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, materialize

WORDS = 5
LEAST = 0.8
BANDS, BITS = 10, 32
PARTS = range(0, 11), range(11, 22), range(22, BITS)  # of the bits of a band
_rng = np.random.default_rng(11)
TURN = _rng.integers(0, 2 ** 64, BANDS // 2, np.uint64)
ODD = _rng.integers(0, 2 ** 64, BANDS // 2, np.uint64) | np.uint64(1)
SIZE_CLASS, CLASS_SHIFT = 1.26, 57  # a little more than 1 / LEAST; an fp has its class above this bit


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of all shingles of one text; words as in ``simhash``."""
    import xxhash

    parts = text.encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    if len(parts) < words:
        found = [b" ".join(parts)]
    else:
        found = map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(42)), np.uint64, max(1, len(parts) - words + 1)))


def bands(hashes: np.ndarray) -> np.ndarray:
    """The bands of the fingerprint of one set of shingles; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int32)
    ones, rows = np.zeros(BANDS * BITS, np.int64), 255  # so many bits add up in a byte
    for at in range(0, len(hashes), 64 * rows):
        h = (hashes[at:at + 64 * rows, None] ^ TURN) * ODD
        h = (h ^ (h >> np.uint64(32))) * ODD[::-1]
        h ^= h >> np.uint64(29)
        bits = np.zeros((-(-len(h) // rows) * rows, BANDS * BITS), np.uint8)
        bits[:len(h)] = np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little")
        ones += bits.reshape(-1, rows, BANDS * BITS).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int32)


def flips(still: range = range(0)) -> Column:
    """The masks that change no bit or one of a value, those of ``still`` excepted."""
    return F.array(*[F.lit(v) for v in (0, *(1 << i if i < 31 else -(1 << 31) for i in range(BITS) if i not in still))])


def variants(places: DataFrame) -> DataFrame:
    """``places`` (band, value, ..) once for each variant of its value within one bit."""
    return places.withColumn("value", F.explode(F.transform(flips(), lambda v: F.col("value").bitwiseXOR(v))))


def dealt(values: DataFrame, tasks: int) -> DataFrame:
    """(cell, value, fp): the variants of ``values`` (fp, band, value), those of one cell in one task.

    Two values that differ in at most two bits agree on one of ``PARTS`` whole, so only a row for each part moves, to the
    cell of (band, part, its bits); the variants, with these bits as they are, are made where the row arrives.
    """
    shifted = lambda part: F.shiftrightunsigned("value", part.start).bitwiseAND((1 << len(part)) - 1)
    cells = [F.struct((F.col("band") * len(PARTS) + k).cast("int").alias("of"), shifted(part).alias("bits")) for k, part in enumerate(PARTS)]
    rows = values.select("fp", "value", F.explode(F.array(*cells)).alias("c"))
    rows = rows.select("fp", "value", (F.shiftleft("c.of", BITS // 2) + F.col("c.bits")).alias("cell")).repartition(tasks, "cell")
    own = F.element_at(F.array(*[flips(part) for part in PARTS]), F.shiftright("cell", BITS // 2) % len(PARTS) + 1)
    return rows.select("cell", F.explode(F.transform(own, lambda v: F.col("value").bitwiseXOR(v))).alias("value"), "fp")


def meeting(values: DataFrame, tasks: int) -> DataFrame:
    """(band, value, fp): the places of ``values`` (fp, band, value) where the sizes of two or more may be alike, perhaps repeated."""
    at, cls = Window.partitionBy("value", "cell").orderBy("fp"), F.shiftright("fp", CLASS_SHIFT)
    near = dealt(values, tasks).withColumns({"after": cls - F.lag(cls).over(at), "before": F.lead(cls).over(at) - cls}).where("after <= 1 or before <= 1")
    return near.select(F.floor(F.shiftright("cell", BITS // 2) / len(PARTS)).cast("byte").alias("band"), "value", "fp")


def named(hashes: np.ndarray) -> int:
    """The fp of one shingle set: 7 bits for the class of its size (alike sets have the same or the next), 57 of its hash."""
    import xxhash

    if not len(hashes):
        return -(1 << 63)
    size = 1 + int(np.log(len(hashes)) / np.log(SIZE_CLASS))
    return ((size - 64) << CLASS_SHIFT) + (xxhash.xxh64_intdigest(hashes.tobytes(), 7) >> (64 - CLASS_SHIFT))


def parities(hashes: np.ndarray) -> bytes:
    """One bit for each cell, whether an odd number of hashes falls into it; cells are a power of two, 64 to 65,536, and as many as hashes if these allow."""
    cells = 1 << min(16, max(6, int(len(hashes) - 1).bit_length()))
    return np.packbits(np.bincount((hashes & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1, bitorder="little").tobytes()


def marks(text: Column) -> Column:
    """struct(fp, bands, size, parity): name, bands, number and parities of the whole shingle set."""
    @F.pandas_udf("fp long, bands array<int>, size long, parity binary")
    def of(texts: pd.Series) -> pd.DataFrame:
        sets = [shingles(t or "") for t in texts]
        return pd.DataFrame({"fp": pd.Series([named(s) for s in sets], dtype="int64"), "bands": pd.Series([bands(s) for s in sets], dtype=object),
                             "size": pd.Series([len(s) for s in sets], dtype="int64"), "parity": pd.Series([parities(s) for s in sets], dtype=object)})

    return of(text)


def packed(text: Column) -> Column:
    """The shingle set as bytes."""
    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t or "").tobytes() for t in texts], dtype=object)

    return of(text)


def alike(a: Column, b: Column) -> Column:
    """Whether two packed sets are at least ``LEAST`` alike."""
    @F.pandas_udf("boolean")
    def of(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= LEAST * max(len(x), len(y)) else 0
            out.append(bool(both) and both >= LEAST * (len(x) + len(y) - both) - 1e-9)
        return pd.Series(out, dtype=bool)

    return of(a, b)


def may_be_alike(sizes: np.ndarray, marked: list[bytes]) -> np.ndarray:
    """Which of these sets may be at least ``LEAST`` alike to another of them; False is certain."""
    bits, hit = [np.frombuffer(m, np.uint64) for m in marked], np.zeros(len(sizes), bool)
    width = np.array([len(b) for b in bits])
    for w in np.unique(width):  # a set's cells are at most twice as many as those of a smaller one alike to it
        near = np.flatnonzero((width == w) | (width == 2 * w))
        rows = np.stack([bits[i] if width[i] == w else bits[i][:w] ^ bits[i][w:] for i in near])
        for at in np.flatnonzero(width[near] == w):
            mine, theirs = sizes[near[at]], sizes[near]
            differ = np.bitwise_count(rows ^ rows[at]).sum(1, dtype=np.int64)
            ok = (9 * differ <= mine + theirs) & (np.minimum(mine, theirs) >= LEAST * np.maximum(mine, theirs) - 1e-9)
            ok[at] = False
            hit[near[ok]] = True
            hit[near[at]] |= ok.any()
    return hit


def folded(members: DataFrame, place: list[str]) -> DataFrame:
    """(band, value, fp, least, n): of places with the same members one, named by two hashes of these, if it has more than one."""
    at = Window.partitionBy(*place)
    return members.select("fp", F.bit_xor(F.xxhash64("fp")).over(at).alias("band"), F.bit_xor(F.xxhash64("fp", F.lit(7))).over(at).alias("value"),
                          F.min("fp").over(at).alias("least"), F.count("*").over(at).alias("n")).where("n > 1").distinct()


def possible(members: DataFrame, parity: DataFrame, block: int = 256) -> DataFrame:
    """``members`` without those that cannot be alike to any other of their place; ``parity`` has (fp, size, parity).

    A set's parities meet its places once, as an array (330 at most). Places of more than ``block`` members stay as they are.
    """
    @F.pandas_udf("array<long>")
    def of(lists: pd.Series) -> pd.Series:
        out = []
        for m in lists:
            hit = may_be_alike(np.array([r["size"] for r in m], np.int64), [r["parity"] for r in m])
            out.append([r["fp"] for r, h in zip(m, hit, strict=True) if h])
        return pd.Series(out, dtype=object)

    held = members.where(F.col("n") <= block).groupBy("fp").agg(F.collect_list(F.struct("band", "value")).alias("at")).join(parity, "fp")
    few = held.select(F.explode("at").alias("at"), F.struct("fp", "size", "parity").alias("m")).groupBy("at.band", "at.value").agg(F.collect_list("m").alias("m"))
    left = few.select("band", "value", F.explode(of("m")).alias("fp"))
    return folded(left.unionByName(members.where(F.col("n") > block).select("band", "value", "fp")), ["band", "value"])


def unit_links(members: pd.DataFrame) -> pd.DataFrame:
    """Links between the roots of ``members`` (fp, root, hashes) that are not joined yet: every pair of roots is decided."""
    fps, sets = members["fp"].to_numpy(), [np.frombuffer(h, np.uint64) for h in members["hashes"]]
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    ends, roots, out = np.cumsum(sizes), members["root"].to_numpy().copy(), []
    marked = np.zeros(len(values), bool)
    names, counts = np.unique(roots, return_counts=True)
    for i in np.flatnonzero(roots != names[counts.argmax()]):  # of two with unlike roots one is not in the largest
        if (roots == roots[i]).all():
            continue
        mine = place[ends[i] - sizes[i]:ends[i]]
        marked[mine] = True
        both = np.bincount(owner[marked[place]], minlength=len(sets))
        marked[mine] = False
        for j in np.flatnonzero((both >= LEAST * (sizes[i] + sizes - both) - 1e-9) & (roots != roots[i])):
            if roots[j] != roots[i]:
                out.append((fps[i], fps[j]))
                roots[roots == roots[j]] = roots[i]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def hubs(members: DataFrame) -> DataFrame:
    """``members`` with the one that is in most places as the ``least`` of each place: what many texts are copies of is near most of them."""
    often = members.withColumn("often", F.count("*").over(Window.partitionBy("fp")))
    most = F.max(F.struct("often", "fp")).over(Window.partitionBy("band", "value"))
    return often.withColumn("least", most["fp"]).drop("often")


def likely(pairs: DataFrame, parity: DataFrame) -> DataFrame:
    """``pairs`` (a, b) whose sizes and parities allow them to be alike."""
    @F.pandas_udf("boolean")
    def of(size: pd.Series, other_size: pd.Series, mark: pd.Series, other: pd.Series) -> pd.Series:
        rows = zip(size, other_size, mark, other, strict=True)
        return pd.Series([bool(may_be_alike(np.array([s, t], np.int64), [m, o]).any()) for s, t, m, o in rows], dtype=bool)

    held = lambda c: parity.select(F.col("fp").alias(c), F.col("size").alias(f"{c}_size"), F.col("parity").alias(f"{c}_parity"))
    sized = pairs.join(held("a"), "a").join(held("b"), "b").where(F.least("a_size", "b_size") >= LEAST * F.greatest("a_size", "b_size") - 1e-9)
    return sized.where(of("a_size", "b_size", "a_parity", "b_parity")).select("a", "b")


def links(members: DataFrame, sets: DataFrame | Callable[[DataFrame], DataFrame], block: int = 256, parity: DataFrame | None = None) -> DataFrame:
    """(a, b): links that connect all candidates whose sets are alike.

    ``members`` (band, value, fp, least, n) of all places with more than one, ``least`` any one of the place that all others
    meet first; ``sets`` (fp, hashes) of these, or what fetches them for given fps; ``parity`` as for ``possible``. ``block``
    only bounds what one task compares. A pair that meets in many places is decided once, and only places that these
    links leave in more than one component go on. Of these, members with the root of the smallest need not be
    compared with each other: those outside it meet all of these, and each other, block by block.
    """
    place = ["band", "value"]
    at = Window.partitionBy(*place)
    fetched = sets if callable(sets) else lambda fps: sets
    pairs = materialize(members.where("fp != least").select(F.col("least").alias("a"), F.col("fp").alias("b")).distinct(), "pairs")
    first = pairs if parity is None else materialize(likely(pairs, parity), "likely")
    found = fetched(first.select(F.explode(F.array("a", "b")).alias("fp")))
    held = lambda c: found.select(F.col("fp").alias(c), F.col("hashes").alias(f"{c}_hashes"))
    stars = materialize(first.join(held("a"), "a").join(held("b"), "b").where(alike(F.col("a_hashes"), F.col("b_hashes"))).select("a", "b"), "stars")
    roots = components(stars).withColumnRenamed("node", "fp")
    root = lambda c: roots.select(F.col("fp").alias(c), F.col("root").alias(f"{c}_root"))
    apart = (pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
             .where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select(F.col("a").alias("least"), F.col("b").alias("fp")))
    more = members.where("n > 2")
    left = more.join(more.join(apart, ["least", "fp"], "left_semi").select(*place).distinct(), place, "left_semi")
    if parity is not None:
        left = possible(materialize(left, "left"), parity)
    rooted = left.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    split = rooted.withColumns({"low": F.min("root").over(at), "high": F.max("root").over(at)}).where("low != high").drop("low", "high")
    inner = F.col("root") == F.min(F.struct("fp", "root")).over(at)["root"]
    sided = split.withColumn("inner", inner).withColumn("outer_n", F.count_if(~F.col("inner")).over(at))
    parts = lambda n: F.ceil(n / block).cast("int")
    sided = sided.withColumns({"blocks": parts(F.col("n") - F.col("outer_n")), "outer": parts(F.col("outer_n"))})
    own = F.pmod(F.xxhash64("fp"), F.when(F.col("inner"), F.col("blocks")).otherwise(F.col("outer"))).cast("int")
    unit = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    met = (F.when(F.col("n") <= block, F.array(unit(0, F.lit(0), F.lit(0))))
           .when(F.col("inner"), F.transform(upto("outer"), lambda c: unit(0, F.col("own"), c)))
           .otherwise(F.concat(F.transform(upto("blocks"), lambda b: unit(0, b, F.col("own"))),
                               F.transform(upto("outer"), lambda c: unit(1, F.least("own", c), F.greatest("own", c))))))
    units = (sided.withColumn("own", own).withColumn("unit", F.explode(met)).groupBy(*place, "unit")
             .agg(F.sort_array(F.collect_list(F.struct("fp", "root"))).alias("m")).select("m").distinct())
    rows = materialize(units.select(F.xxhash64("m").alias("unit"), F.explode("m").alias("m")).select("unit", "m.fp", "m.root"), "units")
    rest = rows.join(fetched(rows.select("fp")), "fp").groupBy("unit").applyInPandas(lambda g: unit_links(g), "a long, b long")
    return materialize(stars.unionByName(rest).distinct(), "links")


def may_be_among(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with ``__among``: whether the row may have its key among ``keys``; False is certain.

    Told by a bitmap of the keys' hashes, of at most 1 MB whatever the table, so rows without such a key need not move.
    """
    place = F.pmod(F.xxhash64(*on), F.lit(1 << 23)) + 1
    bits = keys.groupBy(F.bitmap_bucket_number(place).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright("__at", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = byte.bitwiseAND(F.expr("shiftleft(1, cast(__at & 7 as int))")) != 0
    at = rows.withColumns({"__bucket": F.bitmap_bucket_number(place), "__at": F.bitmap_bit_position(place)}).join(F.broadcast(bits), "__bucket", "left")
    return at.withColumn("__among", F.coalesce(found, F.lit(False))).drop("__bucket", "__at", "__bits")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, all its columns as they are: the smallest id; a null id only where all are null.

    Repeated rows of that document count as one.
    """
    who = {"__id": F.coalesce(F.col(id_col).cast("long"), F.lit(2 ** 63 - 1)), "__text": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))}
    docs, whose = docs.withColumns(who), ["__id", "__text"]
    marked = materialize(docs.select(F.struct("__id", "__text").alias("who"), marks(F.col(text_col)).alias("v")).select("who", "v.*"), "marked")
    per_fp = materialize(marked.groupBy("fp").agg(F.min("who").alias("own"), *[F.first(c).alias(c) for c in ("bands", "size", "parity")]), "distinct")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = materialize(meeting(per_fp.select("fp", F.posexplode("bands").alias("band", "value")), tasks), "near")
    at, cls = Window.partitionBy("band", "value").orderBy("fp"), F.shiftright("fp", CLASS_SHIFT)
    after = near.repartition("band", "value").distinct().withColumn("after", F.coalesce(cls - F.lag(cls).over(at) <= 1, F.lit(False)))
    runs = after.withColumn("run", F.count_if(~F.col("after")).over(at.rowsBetween(Window.unboundedPreceding, 0)))
    members = materialize(hubs(materialize(folded(runs, ["band", "value", "run"]), "met")), "members")

    def sets(fps: DataFrame) -> DataFrame:
        needed = materialize(per_fp.join(fps.distinct(), "fp", "left_semi").select("fp", "own.__id", "own.__text"), "needed")
        whole = docs.select(*whose, F.col(text_col).alias("__whole"))
        held = may_be_among(whole, needed, whose).where("__among").join(needed, whose)
        return materialize(held.select("fp", packed(F.col("__whole")).alias("hashes")).dropDuplicates(["fp"]), "sets")

    roots = components(links(members, sets, parity=per_fp.select("fp", "size", "parity"))).withColumnRenamed("node", "fp")
    grouped = per_fp.select("fp", "own").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = F.min("own").over(Window.partitionBy("root"))
    told = marked.groupBy("who", "fp").count().join(grouped.withColumn("least", least).select("fp", "least"), "fp")
    other = materialize(told.where("who != least or count > 1").select("who.*", (F.col("who") != F.col("least")).alias("goes")), "other")
    docs = may_be_among(docs, other, whose)
    one = Window.partitionBy(*whose).orderBy(F.lit(0))
    first = docs.where("__among").join(other.where("goes"), whose, "left_anti").withColumn("__n", F.row_number().over(one)).where("__n = 1").drop("__n")
    return docs.where("not __among").unionByName(first).drop(*whose, "__among")
