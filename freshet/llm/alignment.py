"""Alignment of the tokens of two tokenizers, in Arrow tables, with corpus-wide pair counts.

Both tokenizers cut the same bytes (a space and the text). Offsets at which tokens of both
end cut a document into groups; a link is a pair of token occurrences whose byte ranges
overlap.

1. **Blocks.** A task encodes whole documents, about ``BLOCK_CHARS`` characters at a time
   (one document at least), and works on a block in Arrow: token ids are the flattened
   lists, their documents the parent indices, their end offsets cumulative sums of token
   lengths less the sum before the document. Acero joins both token tables on (document,
   end): an end that both have closes a group. The full outer join has one row for each
   stretch between two ends, which lies in one token of either side, the next to end: each
   row is one link, and every link is one row, as ranges that overlap do so in one stretch.
   ``Table.group_by`` counts a block's documents by id pair. A block is stored as one row.
2. **Counts.** Spark adds the blocks' partial counts up by pair, and takes the greatest
   count of each A id.
3. **Back.** Each block's different pairs meet their counts in a join by pair, return as
   one packed row a block, and are gathered by the block's documents in Arrow again.

A pair has at most one row a block, so no pair is a hot key; rows of a block are bounded by
its characters. The rows that are shuffled are a block's different pairs, not links.

Defined results: texts null, empty or whose tokens do not stand for their bytes (for
sentencepiece, texts with U+2581) have no tokens: zeros and ''; equal rows count as so many
documents; null document ids are kept; an empty table gives an empty result; other columns
are not read. A text is aligned whole, in memory of about 200 bytes for each of its bytes.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm import common, encoders

VOCABULARY_A = "byte_bpe_50k.json"
VOCABULARY_B = "piece_bpe_32k.model"
#: Characters of a block's texts, about: the block ends with the document that reaches them.
BLOCK_CHARS = 1_500_000
BLOCK_DOCUMENTS = 50_000
#: Bits for the end in a (document, end) key: texts of up to a terabyte, 2^23 documents a block.
END_BITS = 40

_LISTS = ("n_a", "n_b", "n_groups", "n_links")
#: One block: its documents in order; its different pairs with the documents that hold them;
#: for each document the number of its different pairs, then which pairs, and how often each.
_BLOCK = (
    "doc_ids array<long>, n_a array<int>, n_b array<int>, n_groups array<int>, n_links array<int>, sha array<string>, "
    "pairs array<long>, holders array<int>, doc_pairs array<int>, pair_at array<int>, times array<int>"
)


def _lists(packed: list[bytes], dtype: np.dtype) -> pa.ListArray:
    """Packed ids of documents as a list array."""
    sizes = np.array([len(p) // dtype.itemsize for p in packed], dtype="int64")
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), dtype).astype("int32")))


def tokens_table(lists: pa.ListArray, lengths: np.ndarray, name: str) -> pa.Table:
    """(key, name) of each token: flattened ids, and (document, end) as one number, from parent indices and segmented cumulative sums."""
    ids, docs = pc.list_flatten(lists), pc.list_parent_indices(lists)
    total = pc.cumulative_sum(pc.take(pa.array(lengths), ids))
    sums = pa.concat_arrays([pa.array([0], pa.int64()), total])
    before = pc.take(sums, lists.offsets.slice(0, len(lists)))  # the sum where each document starts
    ends = pc.subtract(total, pc.take(before, docs))
    return pa.table({"key": pc.add(pc.shift_left(docs.cast(pa.int64()), END_BITS), ends), name: ids})


def linked(a: pa.Table, b: pa.Table) -> pa.Table:
    """(doc, a, b, a_end, b_end), a row for each link in byte order; ``a_end``: a token of A ends with it."""
    met = a.join(b, "key", join_type="full outer").sort_by("key").combine_chunks()
    # an end of one side alone lies in the other's next token; a document's last end is shared
    return pa.table(
        {
            "doc": pc.shift_right(met["key"], END_BITS), "a": pc.fill_null_backward(met["a"]), "b": pc.fill_null_backward(met["b"]),
            "a_end": pc.is_valid(met["a"]), "b_end": pc.is_valid(met["b"]),
        }
    )


def _group_texts(lists: pa.ListArray, ended: pa.ChunkedArray, shared: pa.ChunkedArray) -> pa.Array:
    """The tokens of each group, joined by commas: a group has the tokens that ended up to its last link."""
    stops = pc.filter(pc.cumulative_sum(ended.cast(pa.int32())), shared).to_numpy()
    groups = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]).astype("int32")), pc.list_flatten(lists).cast(pa.string()))
    return pc.binary_join(groups, ",")


class Aligner:
    """Both encoders, with what their ids stand for."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = encoders.encoder(path_a, True), encoders.encoder(path_b, True)

    def encoded(self, texts: list[str | None]) -> tuple[list[bytes], list[bytes]]:
        """Packed ids of both sides; nothing for texts without tokens."""
        a, b = self._side(self.a, texts), self._side(self.b, texts)
        return [x if y else b"" for x, y in zip(a, b, strict=True)], [y if x else b"" for x, y in zip(a, b, strict=True)]

    def _side(self, encoder: encoders.Encoder, texts: list[str | None]) -> list[bytes]:
        found = iter(encoder.encode([" " + t for t in texts if t], exact=True))
        return [next(found) if t else b"" for t in texts]

    def block(self, doc_ids: list, texts: list[str | None]) -> dict:
        """The row of a block of documents."""
        packed_a, packed_b = self.encoded(texts)
        n = len(texts)
        lists_a, lists_b = _lists(packed_a, self.a.dtype), _lists(packed_b, self.b.dtype)
        table_a, table_b = tokens_table(lists_a, self.a.lengths, "a"), tokens_table(lists_b, self.b.lengths, "b")
        links = linked(table_a, table_b)
        shared = pc.and_(links["a_end"], links["b_end"])
        per_doc = np.bincount(pc.filter(links["doc"], shared).to_numpy(), minlength=n)
        n_links = np.bincount(links["doc"].to_numpy(), minlength=n)
        sides = pc.binary_join_element_wise(_group_texts(lists_a, links["a_end"], shared), _group_texts(lists_b, links["b_end"], shared), "|")
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_doc)]).astype("int32")), sides), ";")
        pair = pc.add(pc.multiply(links["a"].cast(pa.int64()), 1 << 32), links["b"].cast(pa.int64()))
        by_doc = pa.table({"doc": links["doc"], "pair": pair}).group_by(["doc", "pair"]).aggregate([([], "count_all")]).sort_by([("doc", "ascending"), ("pair", "ascending")])
        holders = by_doc.group_by("pair").aggregate([([], "count_all")]).sort_by("pair")
        return {
            "doc_ids": doc_ids,
            "n_a": [len(p) // self.a.width for p in packed_a],
            "n_b": [len(p) // self.b.width for p in packed_b],
            "n_groups": per_doc.tolist(),
            "n_links": n_links.tolist(),
            "sha": [hashlib.sha256(t.encode()).hexdigest() if k else "" for t, k in zip(whole.to_pylist(), n_links, strict=True)],
            "pairs": holders["pair"].to_numpy(),
            "holders": holders["count_all"].to_numpy(),
            "doc_pairs": np.bincount(by_doc["doc"].to_numpy(), minlength=n),
            "pair_at": np.searchsorted(holders["pair"].to_numpy(), by_doc["pair"].to_numpy()),
            "times": by_doc["count_all"].to_numpy(),
        }


@functools.lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


_BLOCK_SCHEMA = pa.schema(
    [("doc_ids", pa.list_(pa.int64())), *[(c, pa.list_(pa.int32())) for c in _LISTS], ("sha", pa.list_(pa.string())), ("pairs", pa.list_(pa.int64()))]
    + [(c, pa.list_(pa.int32())) for c in ("holders", "doc_pairs", "pair_at", "times")]
)


def blocks(docs: DataFrame, path_a: str, path_b: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each block of ``docs`` (doc_id, text); see ``_BLOCK``. No shuffle."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(path_a, path_b)

        def row(ids: list, texts: list) -> pa.RecordBatch:
            found = align.block(ids, texts)
            return pa.RecordBatch.from_pydict({k: [v] for k, v in found.items()}, schema=_BLOCK_SCHEMA)

        ids: list = []
        texts: list = []
        chars = 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                chars += len(t or "")
                if chars >= block_chars or len(ids) >= BLOCK_DOCUMENTS:
                    yield row(ids, texts)
                    ids, texts, chars = [], [], 0
        if ids:
            yield row(ids, texts)

    made_rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(made, _BLOCK)
    return common.stored(made_rows.withColumn("block", F.monotonically_increasing_id()))


def pair_counts(made: DataFrame) -> DataFrame:
    """(a, b, documents, best) of every id pair that some document holds linked; best: the most for its a."""
    partial = made.select(F.explode(F.arrays_zip("pairs", "holders")).alias("p")).select("p.pairs", "p.holders")
    added = partial.groupBy("pairs").agg(F.sum("holders").alias("documents"))
    counts = common.stored(added.select(F.shiftright("pairs", 32).cast("int").alias("a"), F.col("pairs").bitwiseAND((1 << 32) - 1).cast("int").alias("b"), "documents"))
    most = counts.groupBy(F.col("a").alias("_a")).agg(F.max("documents").alias("_most"))
    return counts.join(most.hint("shuffle_hash"), F.col("a") == F.col("_a")).select("a", "b", "documents", (F.col("documents") == F.col("_most")).alias("best"))


def _gathered(made: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents of one block with the counts of their pairs."""
    row = {c: made[c][0].values for c in made.column_names if c != "block"}
    found = answers.sort_by("pair")
    if len(found) != len(row["pairs"]):
        raise ValueError("a pair of the block has no count")
    n = len(row["doc_ids"])
    at, times = row["pair_at"].to_numpy(), row["times"].to_numpy().astype("int64")
    doc = np.repeat(np.arange(n), row["doc_pairs"].to_numpy())
    sums = pa.table({"doc": doc, "count": found["documents"].to_numpy()[at] * times, "best": found["best"].to_numpy()[at] * times}).group_by("doc").aggregate([("count", "sum"), ("best", "sum")])
    count_sum, n_best = np.zeros(n, dtype="int64"), np.zeros(n, dtype="int64")
    count_sum[sums["doc"].to_numpy()], n_best[sums["doc"].to_numpy()] = sums["count_sum"].to_numpy(), sums["best_sum"].to_numpy()
    long = lambda c: row[c].cast(pa.int64())
    return pa.table(
        {"doc_id": row["doc_ids"], **{c: long(c) for c in _LISTS}, "n_best": n_best, "count_sum": count_sum, "groups_sha256": row["sha"]}
    )


def align(docs: DataFrame, vocabulary_a: str | None = None, vocabulary_b: str | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of ``docs`` (doc_id, text)."""
    a, b = vocabulary_a or encoders.public_path(VOCABULARY_A), vocabulary_b or encoders.public_path(VOCABULARY_B)
    made = blocks(docs, a, b, block_chars)
    counts = pair_counts(made).select((F.shiftleft(F.col("a").cast("long"), 32) + F.col("b").cast("long")).alias("pair"), "documents", F.col("best").cast("long").alias("best"))
    asked = made.select(F.col("block").alias("to_block"), F.explode("pairs").alias("_pair"))
    met = asked.join(counts.hint("merge"), F.col("_pair") == F.col("pair")).select("to_block", "pair", "documents", "best")
    # a block without any pair has no answers, but its documents
    return made.groupBy("block").cogroup(met.groupBy("to_block")).applyInArrow(
        _gathered, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )
