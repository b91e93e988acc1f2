"""SimHash near-dedup by meet-in-the-middle ball hashing.

A text's fingerprint has 64 bits, bit i set if it is set in over half of the XXH64 values
(seed 42) of the text's 3-word shingles, repeats included. Fingerprints link at ``RADIUS``
= 3 or fewer differing bits; a document's class is the smallest doc_id reachable by links.

Search: half the radius is 1.5, so two balls meet in the middle, one of radius 1 and one of
radius 2. Every distinct fingerprint emits its 65 variants within 1 bit; those at up to 2
bits from each other share one. Fingerprints at exactly 3 bits differ in parity, and two of
their three bits lie in the same half of the 64; so it is enough that each fingerprint of
even parity also emits its 992 variants with two flips in one half: one of them is within 1
bit of the other. One shuffle brings equal variants together: it deals them by the bits that
the two flips leave (the other half and 8 bits of the flipped one), so that most variants of
a fingerprint travel side by side and compress; fingerprints of odd parity, which have to be
met under both halves, emit their variants for each. There the fingerprints that reach a
variant are tied to the least that reaches it within 1 bit; ties are verified on
all 64 bits and deduplicated. They are links, and they connect whatever shares a variant,
so their number is linear in the emitted rows and no pairs within a group are made. At most
65 distinct fingerprints are within 1 bit of a variant, and at most 2,081 within 2, so no
group is large however the texts are distributed. Exact copies share a fingerprint.

Classes: large-star / small-star rounds over the distinct links, in Spark, each written to
the shared folder; nothing is collected.

Defined results: null and empty texts have fingerprint zero and link like any other; a
null doc_id takes part but is nobody's class (a class of only null ids is null); repeated
rows share a class; very long texts are read whole, word by word; an empty table gives an
empty result; ``near_duplicates`` reads doc_id and text only, ``deduplicated`` returns all
columns of its input, of which none may be named _hash, _rest or _n. Of the rows of a class
that one stays whose doc_id is least, then its text's hash, then the hash of all its columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm.common import join_counted, stored

RADIUS = 3
SHINGLE = 3
SEED = 42
#: The bits that deal variants with two flips in the low and in the high half.
KEPT_BY_LOW = -(1 << 24)
KEPT_BY_HIGH = (0xFF << 56 | 0xFFFFFFFF) - (1 << 64)


def fingerprint_of(text: str | None) -> int:
    """The unsigned fingerprint of one text."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    stops = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *stops]
    hashed = xxhash.xxh64_intdigest
    spans = zip(starts, stops[SHINGLE - 1 :], strict=False) if len(words) >= SHINGLE else [(0, len(joined) + 1)]
    values = np.array([hashed(joined[a : b - 1], SEED) for a, b in spans], dtype="<u8")
    bits = np.unpackbits(values.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="int64")
    return int(np.packbits(2 * bits > len(values), bitorder="little").view("<u8")[0])


def fingerprints(text: Column) -> Column:
    """Fingerprints as signed longs."""

    @F.pandas_udf("long")
    def marked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint_of(t) for t in texts], dtype="uint64").view("int64"))

    return marked(text)


def _flips(width: int, low: int = 0) -> Column:
    """The masks that flip one of ``width`` bits from bit ``low`` on."""
    return F.transform(F.sequence(F.lit(low), F.lit(low + width - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))


def _pair_flips(width: int, low: int) -> Column:
    """The masks that flip two of ``width`` bits from bit ``low`` on."""
    ones = _flips(width, low)
    return F.flatten(F.transform(ones, lambda a: F.transform(F.filter(ones, lambda b: F.shiftrightunsigned(b, low) < F.shiftrightunsigned(a, low)), lambda b: a.bitwiseOR(b))))


def links(fps: DataFrame) -> DataFrame:
    """Distinct links (a, b), a < b, that connect all distinct fingerprints ``fps`` (fp) within the radius."""
    fp = F.col("fp")
    ones, even = _flips(64), F.bit_count("fp") % 2 == 0

    def emitted(some: DataFrame, flips: Column, dealt_by: int) -> DataFrame:
        reached = some.select("fp", F.explode(flips).alias("flip")).select(fp.bitwiseXOR(F.col("flip")).alias("variant"), "fp")
        return reached.select(F.col("variant").bitwiseAND(F.lit(dealt_by)).alias("part"), "variant", "fp")

    reach = emitted(fps, F.concat(F.array(F.lit(0).cast("long")), ones), KEPT_BY_LOW)
    reach = reach.unionByName(emitted(fps.where(~even), ones, KEPT_BY_HIGH))
    reach = reach.unionByName(emitted(fps.where(even), _pair_flips(32, 0), KEPT_BY_LOW))
    reach = reach.unionByName(emitted(fps.where(even), _pair_flips(32, 32), KEPT_BY_HIGH))
    near = F.when(F.bit_count(F.col("variant").bitwiseXOR(fp)) <= 1, fp)
    hub = F.min(near).over(Window.partitionBy("part", "variant"))
    tied = reach.repartition("part").withColumn("hub", hub).where((F.col("hub") != fp) & (F.bit_count(F.col("hub").bitwiseXOR(fp)) <= RADIUS))
    return tied.select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each node's component, for the nodes of ``edges`` (a, b)."""
    edges, last = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), None
    for _ in range(rounds):
        # large star: every larger neighbour is tied to the smallest neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = stored(join_counted(both, least, "a").where("b > a and m < b").select(F.col("m").alias("a"), "b").distinct())
        # small star: the smaller neighbours and the node itself are tied to the smallest
        down = large.groupBy("b").agg(F.min("a").alias("m"), F.count(F.lit(1)).alias("n"))
        tied = join_counted(large, down, "b")
        small = tied.select(F.col("m").alias("lo"), F.explode(F.array("a", "b")).alias("hi")).where("lo < hi").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
        edges = stored(small.distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def classes(docs: DataFrame, carry: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, fp, root (a fingerprint that names the class), component_id and the ``carry`` columns of every row of ``docs``."""
    carry = carry or {}
    marked = stored(docs.select("doc_id", fingerprints(F.col("text")).alias("fp"), *[c.alias(name) for name, c in carry.items()]))
    firsts = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    tree = components(links(firsts.select("fp")))
    linked = stored(firsts.join(tree.hint("shuffle_merge"), F.col("fp") == F.col("node")).select("fp", "root", "first", "n"))
    least = linked.groupBy("root").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("n"))
    rooted = join_counted(linked.withColumnRenamed("n", "rows"), least, "root").select("fp", "root", F.col("least").alias("component_id"), F.col("rows").alias("n"))
    alone = firsts.join(rooted.select(F.col("fp").alias("_fp")).hint("shuffle_merge"), F.col("fp") == F.col("_fp"), "left_anti")
    known = alone.select("fp", F.col("fp").alias("root"), F.col("first").alias("component_id"), "n").unionByName(rooted)
    return join_counted(marked, known, "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of ``docs`` (doc_id, text)."""
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each class of ``docs``: of the smallest doc_id, null ids last; all columns."""
    hashes = {"_hash": F.xxhash64("text"), "_rest": F.xxhash64(*docs.columns)}
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_hash", "_rest")).alias("best")
    kept = stored(classes(docs, hashes).groupBy("root").agg(best).select(F.col("best.doc_id").alias("kept_id"), F.col("best._hash").alias("kept_hash"), F.col("best._rest").alias("kept_rest")))
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("_hash") == F.col("kept_hash")) & (F.col("_rest") == F.col("kept_rest"))
    rows = docs.withColumns(hashes).join(kept.hint("shuffle_merge"), same, "left_semi")
    # rows alike in all columns are one
    once = Window.partitionBy("doc_id", "_hash", "_rest").orderBy("_rest")
    return rows.withColumn("_n", F.row_number().over(once)).where("_n = 1").select(*docs.columns)
