"""Token-id files: every document compressed by itself with one shared zstandard dictionary.

``train`` makes the dictionary from a bounded sample of serialized id arrays. ``encode``
gives each document's ids (with the end id) as one zstandard frame. ``write`` range-partitions
the frames by document id and lays them out as files of blocks:

    block = header, index, frames, line feed
    header: magic, format version, bytes of an id, documents, SHA-256 of the dictionary,
            documents and tokens before the block in its file, bytes of all frames
    index, a column after the other: document ids, 1 for a null id, tokens, frame offsets

so that a document is read by one entry of an index and one frame of its own, and a frame
is never unpacked with another dictionary than its own (the hash is compared). Files go
through Spark's text writer (bytes cast to a string stay as they are, and the line feed ends
a block), so its commit protocol holds: a lost executor leaves no half file, on any store.

    path/data     the blocks, a file for each range of ids
    path/meta     one row: dictionary, its hash, bytes of an id, end id
    path/index    a row for each document, made by reading the files back: file, block
                  offset, frame offset and size, start, n_tokens, ids_crc32

``read`` gives the ids of all documents, ``lookup`` those of a few, from their files only.

Defined results: a null text is empty and has the end id alone; null document ids come
first; rows alike in id follow each other by a hash of their text, rows alike in both are
interchangeable; an empty table gives no documents; other columns are not read; a text may
be of any length that one task can hold (a frame is held whole).
"""

from __future__ import annotations

import functools
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freshet.llm import common, encoders

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: Most documents that the dictionary is trained on, characters of each, and bytes of the dictionary.
SAMPLE_DOCUMENTS = 2000
SAMPLE_CHARS = 4000
DICTIONARY_BYTES = 64 * 1024
LEVEL = 3
#: Bytes of a file and of a block, about: a block ends with the document that reaches them.
FILE_BYTES = 32 * 1024 * 1024
BLOCK_BYTES = 4 * 1024 * 1024
BLOCK_DOCUMENTS = 4096
#: Documents that a worker unpacks at once.
STEP_DOCUMENTS = 250
#: Files (a row each) up to which totals are broadcast.
BROADCAST_FILES = 200_000

MAGIC = b"FTOK"
VERSION = 1
_HEADER = struct.Struct("<4sHHI32sQQQ")


class Meta(NamedTuple):
    """What a set of files shares."""

    dictionary: bytes
    digest: bytes
    width: int
    end_id: int


def meta_of(dictionary: bytes, width: int, end_id: int = END_ID) -> Meta:
    return Meta(dictionary, hashlib.sha256(dictionary).digest(), width, end_id)


@functools.lru_cache(maxsize=2)
def _shared(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    if not dictionary:
        return None
    shared = zstandard.ZstdCompressionDict(dictionary)
    shared.precompute_compress(level=LEVEL)  # else each document would load it anew
    return shared


def sample(docs: DataFrame) -> list[str]:
    """At most ``SAMPLE_DOCUMENTS`` windows of ``SAMPLE_CHARS`` characters, of different texts, placed by hash."""
    rows = docs.where(F.length("text") > 0).select("text", F.xxhash64("text").alias("h"))
    share = max(1, rows.count() // (4 * SAMPLE_DOCUMENTS))
    at = F.pmod(F.shiftright("h", 8), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    drawn = rows.where(F.pmod("h", F.lit(share)) == 0).select("h", F.substr("text", at, F.lit(SAMPLE_CHARS)).alias("part"))
    least = drawn.groupBy("h").agg(F.min("part").alias("part")).orderBy(F.xxhash64("h"), "h").limit(SAMPLE_DOCUMENTS)
    return [r["part"] for r in least.collect()]


def train(docs: DataFrame, path: str, end_id: int = END_ID) -> Meta:
    """The dictionary of serialized id arrays; where there are too few to train on, their bytes in a row, or none."""
    encoder = encoders.encoder(path)
    end = np.array([end_id], dtype=encoder.dtype).tobytes()
    arrays = [ids + end for ids in encoder.encode(sample(docs))]
    dictionary = b"".join(arrays)[-DICTIONARY_BYTES:]
    if sum(map(len, arrays)) > 8 * DICTIONARY_BYTES:
        dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, arrays, level=LEVEL).as_bytes()
    return meta_of(dictionary, encoder.width, end_id)


def encode(docs: DataFrame, meta: Meta, path: str) -> DataFrame:
    """doc_id, tie (a hash of the text), n_tokens and frame of every row. No shuffle."""

    @F.arrow_udf("n_tokens long, frame binary")
    def framed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = encoders.encoder(path)
        end = np.array([meta.end_id], dtype=encoder.dtype).tobytes()
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=_shared(meta.dictionary), write_content_size=True, write_dict_id=False).compress
        for batch in batches:
            tokens, frames = [], []
            for at in range(0, len(batch), STEP_DOCUMENTS):  # a batch of Spark's as Python objects is large
                arrays = [ids + end for ids in encoder.encode([t or "" for t in batch.slice(at, STEP_DOCUMENTS).to_pylist()])]
                tokens += [len(a) // meta.width for a in arrays]
                frames += map(pack, arrays)
            yield pa.StructArray.from_arrays([pa.array(tokens, pa.int64()), pa.array(frames, pa.binary())], ["n_tokens", "frame"])

    coded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), framed("text").alias("_c"))
    return coded.select("doc_id", "tie", "_c.n_tokens", "_c.frame")


def _block(rows: list[tuple], meta: Meta, docs_before: int, tokens_before: int) -> bytes:
    ids, tokens, frames = zip(*rows, strict=True)
    null = np.array([i is None for i in ids], dtype="u1")
    offsets = np.cumsum([0, *map(len, frames)], dtype="<u8")
    header = _HEADER.pack(MAGIC, VERSION, meta.width, len(rows), meta.digest, docs_before, tokens_before, int(offsets[-1]))
    index = np.array([i or 0 for i in ids], dtype="<i8").tobytes() + null.tobytes() + np.array(tokens, dtype="<u8").tobytes() + offsets.tobytes()
    return header + index + b"".join(frames)


def write(frames: DataFrame, meta: Meta, path: str, file_bytes: int = FILE_BYTES) -> None:
    """The files of ``frames`` (as of ``encode``, written to the shared folder first) in ascending order of ids."""
    spark = frames.sparkSession
    spark.createDataFrame([(meta.dictionary, meta.digest, meta.width, meta.end_id)], "dictionary binary, digest binary, width int, end_id long").coalesce(1).write.parquet(f"{path}/meta")
    size = frames.agg(F.sum(F.length("frame"))).first()[0] or 0
    order = ["doc_id", "tie", "_row"]
    # rows alike in id and text are told apart by place, so that none is too many for a range
    placed = frames.withColumn("_row", F.monotonically_increasing_id())
    ranged = placed.repartitionByRange(-(-size // file_bytes) or 1, *order).sortWithinPartitions(*order).drop("tie", "_row")

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        held_bytes = held_tokens = docs = tokens = 0
        for batch in batches:
            for i, n, frame in zip(batch["doc_id"].astype("Int64").astype(object), batch["n_tokens"], batch["frame"], strict=True):
                held.append((None if i is pd.NA else int(i), int(n), bytes(frame)))
                held_bytes += len(frame)
                held_tokens += int(n)
                if held_bytes >= BLOCK_BYTES or len(held) >= BLOCK_DOCUMENTS:
                    yield pd.DataFrame({"block": [_block(held, meta, docs, tokens)]})
                    docs, tokens = docs + len(held), tokens + held_tokens
                    held, held_bytes, held_tokens = [], 0, 0
        if held:
            yield pd.DataFrame({"block": [_block(held, meta, docs, tokens)]})

    ranged.mapInPandas(blocks, "block binary").select(F.col("block").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{path}/data")


def read_meta(spark: SparkSession, path: str) -> Meta:
    row = spark.read.parquet(f"{path}/meta").first()
    return Meta(bytes(row["dictionary"]), bytes(row["digest"]), row["width"], row["end_id"])


class Block(NamedTuple):
    """One block's index; ``frames`` is where its frames start in the file."""

    at: int
    docs_before: int
    tokens_before: int
    ids: list
    tokens: np.ndarray
    offsets: np.ndarray
    frames: int


def parse(content: bytes, meta: Meta) -> Iterator[Block]:
    """The blocks of a file's bytes; a wrong magic, version, width or dictionary is an error."""
    at = 0
    while at < len(content):
        magic, version, width, n, digest, docs, tokens, size = _HEADER.unpack_from(content, at)
        if (magic, version, width) != (MAGIC, VERSION, meta.width):
            raise ValueError("not a block of token ids of this format")
        if digest != meta.digest:
            raise ValueError("the block was packed with another dictionary")
        p = at + _HEADER.size
        ids = np.frombuffer(content, "<i8", n, p)
        null = np.frombuffer(content, "u1", n, p + 8 * n)
        counts = np.frombuffer(content, "<u8", n, p + 9 * n)
        offsets = np.frombuffer(content, "<u8", n + 1, p + 17 * n)
        frames = p + 25 * n + 8
        yield Block(at, docs, tokens, [None if b else i for i, b in zip(ids.tolist(), null, strict=True)], counts.astype("int64"), offsets.astype("int64"), frames)
        at = frames + size + 1  # the line feed


def unpacker(meta: Meta):
    """A function from a frame to its ids, unsigned 32-bit little-endian."""
    unpack = zstandard.ZstdDecompressor(dict_data=_shared(meta.dictionary)).decompress
    dtype = np.dtype(f"<u{meta.width}")
    return lambda frame: np.frombuffer(unpack(frame), dtype).astype("<u4")


def _files(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.format("binaryFile").load(list(paths)).select("path", "content")


_INDEX = "file string, block long, doc_id long, frame long, size long, before long, n_tokens long, ids_crc32 long"


def build_index(spark: SparkSession, path: str) -> DataFrame:
    """Reads all files back, unpacks every frame, and writes and returns ``path/index``.

    ``start`` is the number of ids of all documents before: in its file, by the block, and
    in the files before, whose names sort by range.
    """
    meta = read_meta(spark, path)

    def indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = unpacker(meta)
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                view = memoryview(content)
                for b in parse(content, meta):
                    rows = []
                    for lo, hi in zip(b.offsets[:-1] + b.frames, b.offsets[1:] + b.frames, strict=True):
                        ids = unpack(view[lo:hi])
                        rows.append((lo, hi - lo, len(ids), zlib.crc32(ids.tobytes())))
                    out = pd.DataFrame(rows, columns=["frame", "size", "n", "ids_crc32"])
                    if (out["n"] != b.tokens).any():
                        raise ValueError(f"a frame of {name} holds another number of ids than its index tells")
                    out["before"] = b.tokens_before + np.cumsum(b.tokens) - b.tokens
                    yield out.assign(file=name.rsplit("/", 1)[-1], block=b.at, doc_id=pd.array(b.ids, dtype="Int64"), n_tokens=b.tokens)[[c.split()[0] for c in _INDEX.split(", ")]]

    rows = common.stored(_files(spark, f"{path}/data").mapInPandas(indexed, _INDEX))
    totals = rows.groupBy(F.col("file").alias("_file")).agg(F.sum("n_tokens").alias("_all"))
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    before = totals.select("_file", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_earlier"))
    files = len(_files(spark, f"{path}/data").inputFiles())
    joined = rows.join(F.broadcast(before) if files <= BROADCAST_FILES else before.hint("merge"), F.col("file") == F.col("_file"))
    index = joined.withColumn("start", F.col("before") + F.col("_earlier")).drop("_file", "_earlier", "before")
    index.write.option("compression", "zstd").parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and ids (with the end id) of all documents, file by file."""
    meta = read_meta(spark, path)

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = unpacker(meta)
        for batch in batches:
            for content in batch["content"]:
                view = memoryview(content)
                for b in parse(content, meta):
                    ids = [unpack(view[b.frames + lo : b.frames + hi]).astype("int64") for lo, hi in zip(b.offsets[:-1], b.offsets[1:], strict=True)]
                    yield pd.DataFrame({"doc_id": pd.array(b.ids, dtype="Int64"), "ids": ids})

    return _files(spark, f"{path}/data").mapInPandas(documents, "doc_id long, ids array<long>")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id, start and ids of a few documents (a list at the driver): their index rows, their files, their frames alone."""
    meta = read_meta(spark, path)
    wanted = spark.read.parquet(f"{path}/index").where(F.col("doc_id").isin(doc_ids)).select("doc_id", "start", "file", "frame", "size").toPandas()
    if wanted.empty:
        return spark.createDataFrame([], "doc_id long, start long, ids array<long>")
    by_file = {f: g.drop(columns="file") for f, g in wanted.groupby("file")}

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = unpacker(meta)
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = by_file[name.rsplit("/", 1)[-1]]
                ids = [unpack(memoryview(content)[a : a + n]).astype("int64") for a, n in zip(rows["frame"], rows["size"], strict=True)]
                yield rows[["doc_id", "start"]].assign(ids=ids)

    return _files(spark, *[f"{path}/data/{f}" for f in by_file]).mapInPandas(found, "doc_id long, start long, ids array<long>")


def write_documents(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Trains, encodes and writes ``docs`` (doc_id, text) to ``path``; returns the index of the files read back."""
    vocabulary = vocabulary or encoders.public_path(VOCABULARY)
    docs = docs.select("doc_id", "text")
    meta = train(docs, vocabulary, end_id)
    write(common.stored(encode(docs, meta, vocabulary)), meta, path)
    return build_index(docs.sparkSession, path)


def scratch(spark: SparkSession) -> str:
    """A new folder for files in the shared folder."""
    return f"{common.shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
