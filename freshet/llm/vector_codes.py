"""Vector code compression: integer codebooks by part, found through memoised grid cells.

Every component becomes floor(scale * x); a vector is cut into ``parts`` equal consecutive
parts, and each part position has a codebook of ``entries`` integer vectors. A round assigns
every part to the nearest entry (squared Euclidean distance, ties to the lower index) and
replaces each entry by its parts' componentwise floor(sum / count).

**Nearest entry.** A part falls into a coarse cell (each component shifted right by
``cell_bits``). For the cell's box, the least and the most distance to each entry are known;
an entry whose least distance is over another's most distance is dominated: it is nearest to
no point of the box. The entries that are left are kept in a memo by the cell's bytes, once
for each cell and worker, and only these are measured exactly. Equal bounds are kept, so ties
come out as they would without the memo.

**On Spark.** Vectors are written once as packed integers. A round is one pass that sums up
each task's parts by (position, entry), so at most parts x entries rows leave a task, and
Spark adds them up; the driver holds the codebooks alone (parts x entries vectors). Nothing
is shuffled by vector.

Defined results: a vector that is null, or holds null or non-finite components, takes no
part; a vector whose length is no multiple of ``parts``, or is shorter than the longest, is
filled up with zeros; components saturate at +-2^25 (|x| of 8,192 and more at a scale of
4,096), so that sums stay whole numbers; null ids come after all others, and rows alike in id
are taken by their components; with fewer rows than entries there are fewer entries; equal
rows are coded alike; an empty table gives an empty result; other columns are not read but
the label (null labels together).
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm import common

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Components of one cell differ in their last bits only.
CELL_BITS = 8
#: Cells that a worker remembers for each part position before it starts afresh.
MEMO_CELLS = 200_000
#: Components saturate here, so that distances of up to 2,048 of them fit 63 bits.
MOST = 1 << 25


def quantized(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """(vec_id, label, vec) of the usable vectors, written to the shared folder; vec packs 32-bit components, all of one length."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    usable = df.where(F.col(vector).isNotNull() & F.forall(F.col(vector), finite)).select(
        F.col(id_col).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("_x")
    )
    width = -(-(usable.agg(F.max(F.size("_x"))).first()[0] or 0) // parts) * parts

    @F.pandas_udf("binary")
    def packed(vectors: pd.Series) -> pd.Series:
        sizes = np.array([len(v) for v in vectors], dtype="int64")
        whole = np.zeros((len(vectors), width), dtype="<i4")
        flat = np.concatenate([np.zeros(0), *vectors])
        whole[np.arange(width) < sizes[:, None]] = np.clip(np.floor(scale * flat), -MOST, MOST)
        return pd.Series([row.tobytes() for row in whole])

    return common.stored(usable.select("vec_id", "label", packed("_x").alias("vec")))


class Cells:
    """Which entries of a codebook can be nearest anywhere in a coarse cell."""

    def __init__(self, book: np.ndarray, bits: int = CELL_BITS):
        self.book, self.bits = book.astype("int64"), bits
        self.memo: dict[bytes, int] = {}
        self.seen = self.measured = 0

    def candidates(self, cells: np.ndarray) -> np.ndarray:
        """A bit mask of entries not dominated, for each of different cells (rows)."""
        keys = [c.tobytes() for c in cells]
        new = [i for i, k in enumerate(keys) if k not in self.memo]
        if new:
            if len(self.memo) > MEMO_CELLS:
                self.memo, new = {}, range(len(keys))
            for lo in range(0, len(new), 4096):
                at = list(new[lo : lo + 4096])
                low = cells[at].astype("int64")[:, None, :] << self.bits
                high = low + (1 << self.bits) - 1
                near = np.maximum(np.maximum(low - self.book, self.book - high), 0)
                far = np.maximum(abs(self.book - low), abs(self.book - high))
                least, most = (near * near).sum(2), (far * far).sum(2)
                kept = least <= most.min(1, keepdims=True)
                masks = (kept.astype("int64") << np.arange(len(self.book))).sum(1)
                self.memo.update(zip([keys[i] for i in at], masks.tolist(), strict=True))
        return np.array([self.memo[k] for k in keys], dtype="int64")

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and the squared distance, for each row."""
        cells = np.ascontiguousarray(rows >> self.bits)
        whole = cells.view(np.dtype((np.void, cells.itemsize * cells.shape[1])))[:, 0] if cells.shape[1] else np.zeros(len(rows), "V1")
        _, first, place = np.unique(whole, return_index=True, return_inverse=True)
        masks = self.candidates(cells[first])[place.reshape(-1)]
        code = np.zeros(len(rows), dtype="int64")
        least = np.full(len(rows), np.iinfo("int64").max)
        for e in range(len(self.book)):
            at = np.flatnonzero(masks >> e & 1)
            off = rows[at].astype("int64") - self.book[e]
            far = (off * off).sum(1)
            closer = far < least[at]
            least[at[closer]], code[at[closer]] = far[closer], e
            self.measured += len(at)
        self.seen += len(rows)
        return code, least


@functools.lru_cache(maxsize=2)
def _memo(books: bytes, entries: int, parts: int, bits: int) -> list[Cells]:
    """One memo for each worker, set of codebooks and part position."""
    return [Cells(b, bits) for b in np.frombuffer(books, "int64").reshape(parts, entries, -1)]


def _assigned(batch: pd.Series, cells: list[Cells]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components by part, codes and squared distances of packed vectors."""
    parts = len(cells)
    vectors = np.frombuffer(b"".join(batch), "<i4").reshape(len(batch), parts, -1)
    found = [c.nearest(np.ascontiguousarray(vectors[:, p])) for p, c in enumerate(cells)]
    return vectors, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def start(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """(parts, entries, components) of the vectors with the smallest ids."""
    first = vectors.select("vec_id", "vec").orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(entries).collect()
    width = len(first[0]["vec"]) // (4 * parts) if first else 0
    whole = np.frombuffer(b"".join(bytes(r["vec"]) for r in first), "<i4").astype("int64")
    return np.ascontiguousarray(whole.reshape(len(first), parts, width).transpose(1, 0, 2))


def refined(vectors: DataFrame, books: np.ndarray, bits: int = CELL_BITS) -> np.ndarray:
    """The codebooks after one round."""
    parts, entries, _ = books.shape
    packed = books.tobytes()

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = _memo(packed, entries, parts, bits)
        total, n = np.zeros(books.shape, dtype="int64"), np.zeros((parts, entries), dtype="int64")
        for batch in batches:
            vecs, codes, _ = _assigned(batch["vec"], cells)
            for p in range(parts):
                np.add.at(total[p], codes[:, p], vecs[:, p])
                n[p] += np.bincount(codes[:, p], minlength=entries)
        at = np.argwhere(n)
        yield pd.DataFrame({"part": at[:, 0], "entry": at[:, 1], "n": n[n > 0], "total": list(total[n > 0])})

    partial = vectors.select("vec").mapInPandas(sums, "part long, entry long, n long, total array<long>")
    places = partial.select("part", "entry", "n", F.posexplode("total").alias("i", "t"))
    added = places.groupBy("part", "entry", "i").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).collect()  # the size of the codebooks
    out = books.copy()
    for r in added:
        out[r["part"], r["entry"], r["i"]] = r["t"] // r["n"]
    return out


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, bits: int = CELL_BITS) -> np.ndarray:
    books = start(vectors, parts, entries)
    for _ in range(rounds if books.size else 0):
        books = refined(vectors, books, bits)
    return books


def encode(vectors: DataFrame, books: np.ndarray, bits: int = CELL_BITS) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of every vector. No shuffle."""
    parts, entries, _ = books.shape
    packed = books.tobytes()

    @F.pandas_udf("code string, error long")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cells = _memo(packed, entries, parts, bits)
        for batch in batches:
            _, codes, errors = _assigned(batch, cells)
            yield pd.DataFrame({"code": [bytes(c).hex() for c in codes.astype("uint8")], "error": errors.sum(1)})

    return vectors.select("vec_id", "label", coded("vec").alias("_c")).select("vec_id", "label", "_c.code", "_c.error")


def decode(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """``coded`` with ``vector``, the integer vector that the code stands for."""
    table = F.array(*[F.array(*[F.array(*map(F.lit, e)) for e in p]) for p in books.tolist()])
    index = lambda p: F.conv(F.substr("code", F.lit(2 * p + 1), F.lit(2)), 16, 10).cast("int")
    return coded.withColumn("vector", F.concat(*[F.get(F.get(table, F.lit(p)), index(p)) for p in range(len(books))]))


def codebooks_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with the error summed over equal labels; a label may hold any share of the rows."""
    named = common.stored(coded.withColumn("_label", F.coalesce(F.concat(F.lit("v"), F.col("label").cast("string")), F.lit("null"))))
    sums = named.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    return common.join_counted(named, sums, "_label").drop("_label")


def compress(df: DataFrame, bits: int = CELL_BITS) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of the usable rows of ``df``."""
    vectors = quantized(df)
    books = fit(vectors, bits=bits)
    if not books.size:  # no rows, or no components: nothing to measure
        coded = vectors.select("vec_id", "label", F.lit("00" * PARTS).alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        coded = encode(vectors, books, bits)
    return with_label_error(coded).withColumn("codebooks_sha256", F.lit(codebooks_sha256(books)))
