"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most three bits leave at most two differing bits once a band that holds one of
the three is cleared; both then emit their common midpoint when each emits all variants within one bit, half of
two. Three bands cover the 64 bits, so a fingerprint emits 3 + 128 variants, whatever the table holds. Rows meet in
one exchange on (band, variant); fingerprints alone in a place are dropped, the others are compared. Only distinct
fingerprints take part, so thousands of copies are one of them.

Defined results: a null text and one without words have fingerprint zero, linked like any other; fewer words than a
shingle make one shingle of what is there; repeated rows share a component; a null id is carried and takes part as
a document, but cannot be the smallest id unless its component has no other; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, materialize

BITS = 64
BANDS = ((0, 22), (22, 43), (43, 64))  # first and last bit of each band
RADIUS = 3


def simhash(text: str, words: int = 3) -> int:
    """The fingerprint of one text, as a signed 64-bit number."""
    import xxhash

    parts = text.encode().lower().split()  # on bytes: only A-Z change, only the six ASCII blanks cut
    if not parts:
        return 0
    if len(parts) < words:
        shingles = [b" ".join(parts)]
    else:
        shingles = map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False))
    n = max(1, len(parts) - words + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 4096):
        ones += np.unpackbits(hashes[at:at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, words: int = 3) -> Column:
    """The signed 64-bit fingerprint of each whole text."""
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t or "", words) for t in texts], dtype="int64")

    return of(text)


def variants(distinct: DataFrame) -> DataFrame:
    """(band, variant, fp): with the band cleared, the fingerprint itself and all it becomes by one changed bit."""
    def signed(v: int) -> int:
        return v - (1 << BITS) if v >> (BITS - 1) else v

    per_band = []
    for n, (a, b) in enumerate(BANDS):
        cleared = F.col("fp").bitwiseAND(F.lit(signed((1 << BITS) - 1 - ((1 << b) - (1 << a)))))
        changes = F.array(*[F.lit(x) for x in [0, *(signed(1 << i) for i in range(BITS) if not a <= i < b)]])
        per_band.append(F.struct(F.lit(n).cast("byte").alias("band"), cleared.alias("kept"), changes.alias("changes")))
    return (distinct.select("fp", F.explode(F.array(*per_band)).alias("v"))
            .select("fp", "v.band", "v.kept", F.explode("v.changes").alias("change"))
            .select("band", F.col("kept").bitwiseXOR(F.col("change")).alias("variant"), "fp"))


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between these fingerprints: as connected as all links, never all pairs."""
    fps, out = np.unique(fps), []
    left, front = np.arange(1, len(fps)), [0]
    while len(left):
        if not front:
            front, left = [left[0]], left[1:]
        at = front.pop()
        near = np.bitwise_count((fps[left] ^ fps[at]).view(np.uint64)) <= RADIUS
        for i in left[near]:
            out.append((int(fps[at]), int(fps[i])))
            front.append(i)
        left = left[~near]
    return out


def tree_of_links(members: str) -> Column:
    """The forest of each array of fingerprints."""
    @F.pandas_udf("array<struct<a: long, b: long>>")
    def of(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda m: [{"a": a, "b": b} for a, b in forest(np.asarray(m, np.int64))])

    return of(members)


def hub_links(crowded: DataFrame) -> DataFrame:
    """Links of places with too many fingerprints to compare: finer keys whose members are all within the radius.

    ``crowded`` has (band, variant, fp). Members with the same place and the same band but for one bit differ in at
    most 2 + 1 bits; every linked pair shares such a key in some band, unless all three bits lie in one band. Those
    have equal bits outside it, and meet in the key that frees one bit of the band and changes another.
    """
    ones = F.element_at(F.array(*[F.lit(((1 << b) - (1 << a)) - (1 << BITS if b == BITS else 0)) for a, b in BANDS]), F.col("band") + 1)
    first = F.element_at(F.array(*[F.lit(a) for a, _ in BANDS]), F.col("band") + 1)
    last = F.element_at(F.array(*[F.lit(b - 1) for _, b in BANDS]), F.col("band") + 1)
    inside = crowded.withColumns({"inner": F.col("fp").bitwiseAND(ones), "first": first, "last": last})
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.col(c))
    free = F.col("inner").bitwiseAND(F.bitwise_not(bit("free")))
    one = inside.withColumn("free", F.explode(F.sequence("first", "last"))).select(
        "band", "variant", "free", free.alias("inner"), F.lit(0).alias("kind"), "fp")
    core = inside.where(F.col("variant") == F.col("fp").bitwiseAND(F.bitwise_not(ones)))
    two = (core.withColumn("free", F.explode(F.sequence("first", "last"))).withColumn("turned", F.explode(F.sequence("first", "last")))
           .where(F.col("free") != F.col("turned"))
           .select("band", "variant", "free", free.bitwiseXOR(bit("turned")).alias("inner"), F.lit(1).alias("kind"), "fp"))
    keys = ["band", "variant", "free", "inner", "kind"]
    rows = one.unionByName(two)
    centre = rows.groupBy(*keys).agg(F.min("fp").alias("a"), F.max("fp").alias("last_fp")).where("a != last_fp")
    return rows.join(centre.drop("last_fp"), keys).where("a != fp").select("a", F.col("fp").alias("b")).distinct()


def links(distinct: DataFrame, crowd: int = 1024) -> DataFrame:
    """(a, b): links between distinct fingerprints at most three bits apart, enough of them to connect all that are linked.

    ``crowd`` only chooses how a place is worked on (compared inside one row up to it, by finer keys beyond); both
    ways are exact.
    """
    # the only exchange of all variants; they come from many tasks, as one fingerprint makes 131 of them
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = ["band", "variant"]
    counted = variants(distinct.repartition(tasks, "fp")).withColumn("n", F.count("*").over(Window.partitionBy(*place))).where("n > 1")
    members = materialize(counted, "members")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    pairs = members.where("n = 2").groupBy(*place).agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where(near).select("a", "b")
    inside = (members.where((F.col("n") > 2) & (F.col("n") <= crowd)).groupBy(*place).agg(F.collect_list("fp").alias("m"))
              .select(F.explode(tree_of_links("m")).alias("l")).select("l.a", "l.b"))
    return pairs.unionByName(inside).unionByName(hub_links(members.where(F.col("n") > crowd).drop("n"))).distinct()


def groups(fps: DataFrame, least: str) -> DataFrame:
    """(fp, root, least): for each distinct fingerprint of ``fps`` its component and the component's smallest ``least``."""
    per_fp = materialize(fps.groupBy("fp").agg(F.min(least).alias("own")), "distinct")
    roots = components(links(per_fp.select("fp")))
    grouped = per_fp.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return grouped.join(grouped.groupBy("root").agg(F.min("own").alias("least")), "root").select("fp", "root", "least")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp, component_id): the smallest id reachable over links, itself included."""
    marked = materialize(docs.select(F.col(id_col).cast("long").alias(id_col), fingerprint(F.col(text_col), words).alias("fp")), "fingerprints")
    return marked.join(groups(marked, id_col), "fp").select(id_col, "fp", F.col("least").alias("component_id"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One document of each component, all its columns as they are: the smallest id; a null id only where all are null.

    Repeated rows of that document count as one. The texts move once, to meet the (id, hash of text) of those that stay.
    """
    own = {"__id": F.coalesce(F.col(id_col).cast("long"), F.lit(2 ** 63 - 1)), "__text": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))}
    docs = docs.withColumns(own)
    marked = materialize(docs.select(F.struct("__id", "__text").alias("who"), fingerprint(F.col(text_col), words).alias("fp")), "fingerprints")
    stay = groups(marked, "who").select("root", "least.__id", "least.__text").distinct().select("__id", "__text")
    one = Window.partitionBy("__id", "__text").orderBy(F.lit(0))
    return (docs.join(stay, ["__id", "__text"], "left_semi").withColumn("__n", F.row_number().over(one))
            .where("__n = 1").drop("__id", "__text", "__n"))
