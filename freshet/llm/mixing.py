"""Mixing sources to target weights with a low-discrepancy schedule.

Slot t of the mix gets the point frac(t / golden ratio), which the cumulative target
shares map to a source. Slots are ranked per source, and the k-th slot of a source
takes the k-th block of ``block_words`` words of that source's documents, laid end to
end in a shuffled order (by a hash of the id) and repeated up to ``limit`` times. Points
are counted in integers (multiples of 2^-52), so that neighbouring slots stay apart however
many there are.

Ranks have no gaps, so what a document gives is the part of its passes below its source's
number of slots times ``block_words``; its place in the mix is the slot that takes the block
in which it begins.

Targets: sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3, ... and share
the corpus's words; a target stops at ``limit`` times its source's size, and the excess
is shared by weight among the rest until none is above.

Running positions are counted in two levels (bucket totals, then inside buckets), and
sources with many rows are joined apart, so no task gets a whole source. Everything is a
function of ids, texts and sources: reruns agree.

Defined results: null texts have size 0; a document without words takes nothing (``mixed``
keeps it once, first); a null source is a source; repeated rows lie side by side in the
layout and are counted each; rows of one id go by the hash of their text; an empty table
gives an empty result. ``mix`` reads doc_id, text and source only; ``mixed`` returns all
columns of its input, of which none may start with an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm.common import join_counted, stored, word_count

#: The golden ratio's inverse as a multiple of 2^-52, in two halves of 26 bits; odd, so that points repeat after 2^52 slots.
GOLDEN = round(0.6180339887498949 * (1 << 52)) | 1
HALF = 1 << 26
BLOCK_WORDS = 32
LIMIT = 3
LAYOUT_BUCKETS = 1024
SLOT_CHUNK = 4096
#: Least number of equal cells of the unit interval in which points meet shares; four for each source where that is more.
SHARE_CELLS = 4096
#: Tables of shares up to this many sources are broadcast, larger ones are shuffled.
BROADCAST_SOURCES = 50_000


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with the row's place (from 0) in a total order, by range partitions."""
    ranged = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(*order)
    return (
        ranged.withColumn(name, F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), F.col("_part") == F.col("_p"))  # a row for each shuffle partition
        .withColumn(name, F.col(name) + F.col("_before"))
        .drop("_part", "_p", "_before")
    )


def source_targets(rows: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, int, int]:
    """(source, sid, source_size, target, n rows) of rows (source, size); their number; all words."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    ranked = numbered(sizes, [F.col("source").asc_nulls_last()], "sid")
    ranked = stored(ranked.withColumn("weight", (F.col("sid") % 3 + 1).cast("double")))
    count, words, weights = ranked.agg(F.count(F.lit(1)), F.sum("source_size"), F.sum("weight")).first()
    cap = F.col("source_size").cast("double") * limit
    level = words / weights if count else 0.0
    while count:
        above = F.col("weight") * F.lit(level) > cap
        held, free = ranked.agg(F.sum(F.when(above, cap).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        raised = (words - held) / free if free else level
        if raised <= level:
            break
        level = raised
    targets = ranked.select("source", "sid", "source_size", F.least(cap, F.col("weight") * F.lit(level)).alias("target"), "n")
    return targets, count, words or 0


def golden_point(slot: Column) -> Column:
    """frac(slot * golden ratio), in [0, 1), by integers that stay below 2^63."""
    low, high = F.pmod(slot, F.lit(HALF)), F.pmod(F.floor(slot / HALF), F.lit(HALF))
    crossed = F.pmod(high * (GOLDEN % HALF) + low * (GOLDEN // HALF), F.lit(HALF)) * HALF
    return F.pmod(crossed + low * (GOLDEN % HALF), F.lit(1 << 52)) / float(1 << 52)


def schedule(targets: DataFrame, sources: int, words: int, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(slot, sid, rank): which source each slot takes from, and its rank there."""
    chunk, total = F.floor(F.col("sid") / 1000), float(max(words, 1))
    totals = targets.groupBy(chunk.alias("c")).agg(F.sum("target").alias("t"))
    before = Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)  # a row for every 1,000 sources
    starts = totals.select("c", F.coalesce(F.sum("t").over(before), F.lit(0.0)).alias("s"))
    inside = Window.partitionBy("c").orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    lows = targets.withColumn("c", chunk).join(starts.hint("shuffle_hash"), "c")
    low = (F.col("s") + F.coalesce(F.sum("target").over(inside), F.lit(0.0))) / total
    shares = lows.where("target > 0").select("sid", low.alias("low"), (low + F.col("target") / total).alias("high"))
    number = max(SHARE_CELLS, 4 * sources)
    reach = F.sequence(F.floor(F.col("low") * number), F.floor(F.col("high") * number))
    cells = shares.withColumn("cell", F.explode(reach))  # at most sources + cells rows
    points = (
        targets.sparkSession.range(-(-words // block_words))
        .select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("x"))
        .withColumn("at", F.floor(F.col("x") * number))
    )
    hit = (F.col("at") == F.col("cell")) & (F.col("x") >= F.col("low")) & (F.col("x") < F.col("high"))
    hinted = F.broadcast(cells) if sources <= BROADCAST_SOURCES else cells.hint("shuffle_merge")
    drawn = points.join(hinted, hit).select("slot", "sid", F.floor(F.col("slot") / SLOT_CHUNK).alias("chunk"))
    counts = drawn.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("sid", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranks = Window.partitionBy("sid", "chunk").orderBy("slot")
    return (
        drawn.withColumn("in", F.row_number().over(ranks) - 1)
        .join(offsets.hint("shuffle_hash"), ["sid", "chunk"])
        .select("slot", "sid", (F.col("before") + F.col("in")).alias("rank"))
    )


def layout(rows: DataFrame, key: Column, order: list[Column], buckets: int = LAYOUT_BUCKETS) -> DataFrame:
    """``rows`` (sid, size, ...) with ``start``: the words before the row in its source's shuffled order."""
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(key, F.lit("layout")), F.lit(buckets)).cast("int"))
    totals = dealt.groupBy("sid", "_bucket").agg(F.sum("size").alias("_words"))
    before = Window.partitionBy("sid").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("sid", "_bucket", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("sid", "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets.hint("shuffle_hash"), ["sid", "_bucket"])
        .withColumn("start", F.col("_before") + F.col("_in"))
        .drop("_bucket", "_before", "_in")
    )


def planned(docs: DataFrame, block_words: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Every row of ``docs`` with sid, size, source_size, target, start, taken, crc; and the schedule."""
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")))
    rows = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), crc.alias("text_crc32")))
    targets, sources, words = source_targets(rows, limit)
    slots = stored(schedule(targets, sources, words, block_words))
    ends = slots.groupBy(F.col("sid").alias("slot_sid")).agg(F.count(F.lit(1)).alias("slots"))
    named = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source")))
    known = targets.join(ends.hint("shuffle_hash"), F.col("sid") == F.col("slot_sid"), "left").select(
        named.alias("named"), "sid", "source_size", "target", F.coalesce("slots", F.lit(0)).alias("slots"), "n"
    )
    tagged = join_counted(rows.select("doc_id", "size", "text_crc32", named.alias("named")), known, "named").drop("named")
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    placed = layout(tagged, F.col("doc_id"), order)
    begin = lambda turn: F.lit(turn) * F.col("source_size") + F.col("start")
    end = F.col("slots") * block_words
    given = [F.greatest(F.lit(0), F.least(begin(t) + F.col("size"), end) - begin(t)) for t in range(limit)]
    return placed.withColumn("taken", sum(given[1:], given[0]).cast("long")), slots


def with_slot(placed: DataFrame, slots: DataFrame, turn: Column, block_words: int) -> DataFrame:
    """``placed`` with the slot that takes the block in which the row begins in pass ``turn`` (from 0); null if none does."""
    blocks = slots.select(F.col("sid").alias("_sid"), F.col("rank").alias("_rank"), F.col("slot").alias("first_slot"))
    asked = placed.withColumn("_block", F.floor((turn * F.col("source_size") + F.col("start")) / block_words))
    return asked.join(blocks.hint("shuffle_merge"), (F.col("sid") == F.col("_sid")) & (F.col("_block") == F.col("_rank")), "left").drop("_sid", "_rank", "_block")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, limit: int = LIMIT) -> DataFrame:
    """doc_id, size, source_size, target, taken, text_crc32, first_slot for every row of ``docs`` (doc_id, text, source)."""
    placed, slots = planned(docs, block_words, limit)
    out = with_slot(placed, slots, F.lit(0), block_words)
    first = F.when(F.col("taken") > 0, F.col("first_slot")).alias("first_slot")
    return out.select("doc_id", "size", "source_size", "target", "taken", "text_crc32", first)


def mixed(docs: DataFrame, block_words: int = BLOCK_WORDS, limit: int = LIMIT) -> DataFrame:
    """The mix in whole documents: each row of ``docs`` as often as round(taken / size), in order of slots; all columns.

    A source's slots take its documents in one run along its layout, so only the document
    at the run's end is rounded. Documents without words stay once, first.
    """
    placed, slots = planned(docs, block_words, limit)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(1).cast("int")
    nth = lambda *keys, by: F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
    plan = placed.select(
        F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_crc"), "sid", "start", "source_size", copies.alias("_copies"), nth("doc_id", "text_crc32", by=["sid", "start"]).alias("_m")
    ).where("_copies > 0")
    turns = plan.withColumn("_turn", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    order = with_slot(turns, slots, F.col("_turn"), block_words).select("_id", "_crc", "_m", F.col("first_slot").alias("_slot"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.withColumn("_row_crc", crc).withColumn("_n", nth("doc_id", "_row_crc", by=[F.col("source").asc_nulls_last(), F.xxhash64(*docs.columns)]))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row_crc") == F.col("_crc")) & (F.col("_n") == F.col("_m"))
    taken = rows.join(order.hint("shuffle_merge"), same)
    by = [F.col("_slot").asc_nulls_first(), F.col("doc_id"), F.col("_row_crc")]
    return taken.repartitionByRange(*by).sortWithinPartitions(*by).select(*docs.columns)
