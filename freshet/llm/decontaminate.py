"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are normalised: lower case, runs of anything but letters, digits and
underscores become one space. An item of m characters may be met with up to
k = floor(rate * m) edits. It is split into k + 1 pieces; k edits leave at least one
piece untouched, so every passage within k edits holds an exact piece. One Aho-Corasick
pass over a document finds all piece hits; the places they point to are merged per item
and verified with Myers' bit-parallel edit distance (free start and end in the document).

Items travel to the tasks in groups of at most ``GROUP_CHARS`` characters (one longer item
may exceed it alone); each group is one pass over the documents, so no task or driver
holds more than a group however large the benchmark is.

Defined results: null or empty texts and items match nothing; an item too short for an
edit (k = 0) counts only as whole words; repeated rows of documents or items give one row
for each (doc_id, item_id) with the least distance, in ties the one that ends first; rows
with null ids are matched like others; long texts are searched whole, in one pass; an empty
table gives an empty result. Columns other than the ids and texts are not read;
``decontaminated`` keeps them, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm.common import shared_dir, stored

ERROR_RATE = 0.08
GROUP_CHARS = 1_000_000

_WORDS = re.compile(r"\w+")


def normalised(text: str | None) -> str:
    return " ".join(_WORDS.findall((text or "").lower()))


def myers_least(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any substring of ``text``, and where it first ends."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        peq[ch] = peq.get(ch, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = mask, 0, m, m, 0
    for j, ch in enumerate(text, 1):
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & mask
        pv = (mh << 1 | ~(xv | ph)) & mask
        mv = ph & xv
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    """Pieces of some items (id, text) in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items: list[tuple[int, str, int]] = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            text = normalised(text)
            if not text:
                continue
            k = int(rate * len(text))
            text = text if k else f" {text} "
            cuts = [len(text) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(text[a:b], []).append((len(self.items), a))
            self.items.append((item_id, text, k))
        self.automaton = ahocorasick.Automaton()
        for piece, at in pieces.items():
            self.automaton.add_word(piece, (len(piece), at))
        if pieces:
            self.automaton.make_automaton()

    def matches(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item id, distance, budget, end in the normalised text) of each item found."""
        if not self.items:
            return
        text = f" {text} "
        places: dict[int, list[int]] = {}
        for end, (length, at) in self.automaton.iter(text):
            for item, offset in at:
                places.setdefault(item, []).append(end + 1 - length - offset)
        for item, starts in places.items():
            item_id, pattern, k = self.items[item]
            best, end = k + 1, 0
            for lo, hi in _merged(sorted(starts), 2 * k):
                a = max(0, lo - k)
                found, stop = myers_least(pattern, text[a : hi + len(pattern) + k])
                if found < best:
                    best, end = found, a + stop - 1
            if best <= k:
                yield item_id, best, k, end


def _merged(starts: list[int], gap: int) -> Iterator[tuple[int, int]]:
    lo = hi = starts[0]
    for s in starts[1:]:
        if s > hi + gap:
            yield lo, hi
            lo = s
        hi = s
    yield lo, hi


def item_groups(items: DataFrame, group_chars: int = GROUP_CHARS) -> list[DataFrame]:
    """Different ``items`` in groups of about ``group_chars`` characters, by a hash of id and text; one longer item is a group of its own size."""
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    groups = max(1, -(-chars // group_chars))
    group = F.pmod(F.xxhash64("item_id", "text"), F.lit(groups))
    return [items.where(group == g) if groups > 1 else items for g in range(groups)]


def contaminated(
    docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, group_chars: int = GROUP_CHARS
) -> DataFrame:
    """doc_id, item_id, distance, budget, match_end: every document that holds an item.

    With several groups each one's hits are written before the next is collected, and the
    plan that comes back reads the hits alone.
    """
    groups = item_groups(items.select("item_id", "text").dropDuplicates(), group_chars)
    path = f"{shared_dir(docs.sparkSession)}/freshet-{uuid.uuid4().hex}" if len(groups) > 1 else None
    for group in groups:
        held = [(r["item_id"], r["text"]) for r in group.collect()]  # at most a group's characters

        def scan(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            matcher = Matcher(held, rate)
            for batch in batches:
                rows = [(doc_id, *m) for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True) for m in matcher.matches(normalised(text))]
                out = pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "budget", "match_end"])
                yield out.astype({"doc_id": "Int64", "item_id": "Int64", "distance": "int32", "budget": "int32", "match_end": "int64"})

        found = docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(
            scan, "doc_id long, item_id long, distance int, budget int, match_end long"
        )
        if path:
            found.write.mode("append").option("compression", "zstd").parquet(path)
    if path:
        found = docs.sparkSession.read.schema(found.schema).parquet(path)
    best = Window.partitionBy("doc_id", "item_id").orderBy("distance", "match_end")
    return found.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def _holds(items: list[tuple[int, str]], rate: float):
    """Does a text hold one of some items?"""

    @F.pandas_udf("boolean")
    def holds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(items, rate)
        for texts in batches:
            yield pd.Series([next(matcher.matches(normalised(t)), None) is not None for t in texts], dtype=bool)

    return holds


def decontaminated(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, group_chars: int = GROUP_CHARS) -> DataFrame:
    """``docs`` without the rows whose text holds an item; each row is judged by its own text. No shuffle.

    With several groups, what one leaves is written before the next is collected.
    """
    groups = item_groups(items.select("item_id", "text").dropDuplicates(), group_chars)
    for i, group in enumerate(groups):
        held = [(r["item_id"], r["text"]) for r in group.collect()]  # at most a group's characters
        docs = docs.where(~_holds(held, rate)(F.col("text")))
        if i + 1 < len(groups):
            docs = stored(docs)
    return docs
