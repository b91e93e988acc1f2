"""Vector codes, token alignment and token files against loops, libraries and round trips."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.llm import alignment, encoders, queries, token_files, vector_codes

WORDS = ["the", "of", "Flüsse", "don't", "niño", "x1y2", "1,024.5", "(a)", "hello", "ciónci", "中文字", "😀", "é", "H̱d", "<|endoftext|>", "<s>", "</s>", "½", "ﬁx"]
SPACES = [" ", " ", " ", "  ", "\n", "\n\n", " \t", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d\x1f", "\x85", "\xa0", " ", "  ", " ", "　", "᠎", "​", ". ", ", ", ".", ",", "!) ", "▁"]


def random_texts(n: int, seed: int = 7) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(WORDS if r.random() < 0.6 else SPACES) for _ in range(r.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize(("name", "as_text"), [("byte_bpe_50k.json", False), ("byte_bpe_50k.json", True), ("piece_bpe_32k.model", True)])
def test_chunked_ids_are_the_librarys(name, as_text):
    e = encoders.Encoder(encoders.public_path(name), as_text, memo_chunks=500)
    assert e.cuttable
    texts = [t for t in random_texts(8000) if t]
    given = [" " + t for t in texts] if e.pieces else texts
    got = [np.frombuffer(p, e.dtype).tolist() for part in range(0, len(texts), 1000) for p in e.encode(given[part : part + 1000])]
    assert got == e._library_ids(texts)


def test_long_chunks_and_runs():
    e = encoders.Encoder(encoders.public_path("byte_bpe_50k.json"))
    texts = ["ab" * 30_000, " " * 5000, "\n" * 5000 + "x", "word " * 20_000]
    assert [np.frombuffer(p, e.dtype).tolist() for p in e.encode(texts)] == e._library_ids(texts)


def test_plain_words_go_to_the_model_as_the_library_cuts_them(monkeypatch):
    e, given = encoders.Encoder(encoders.public_path("byte_bpe_50k.json")), []
    texts = ["Straße of*** niño$$$ reeds\nOnetion&&& ÿes!\n", "a\nb \nc\n\nd", "end<|endoftext|>end*** \n<|endoftext|>\nAbc it's l'été** x×y ª÷º"]
    for seed in range(300):
        r = random.Random(seed)
        texts.append("".join(r.choice(["a", "Zürich", "<|endoftext|>", "*", "$$", "'s", "'", "\n", " ", "  ", "7", "_", "×", "\u0301", "\xa0", "\x1c"]) for _ in range(r.randint(1, 20))))
    wanted = e._library_ids(texts)
    monkeypatch.setattr(e, "_library_ids", lambda parts, plain=e._library_ids: given.extend(parts) or plain(parts))
    assert np.frombuffer(e.encode(texts[:1])[0], e.dtype).tolist() == wanted[0]
    assert not any(c.isalpha() for c in "".join(given))
    assert [np.frombuffer(p, e.dtype).tolist() for p in e.encode(texts)] == wanted


def test_token_bytes_give_the_text_back():
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        e = encoders.Encoder(encoders.public_path(name), True)
        stand = e.token_bytes()
        for t in random_texts(500):
            if t and "▁" not in t:
                (ids,) = e.encode([" " + t])
                assert b"".join(stand[i] for i in np.frombuffer(ids, e.dtype)) == (" " + t).encode()


# ---- vector codes


def loop_codes(rows: list[tuple], parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[dict, str]:
    """(position of the row -> (code, error)), sha256."""
    kept = [(i, r) for i, r in enumerate(rows) if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    vecs = {i: [int(np.floor(4096 * float(x))) for x in r[1]] for i, r in kept}
    width = -(-max((len(v) for v in vecs.values()), default=0) // parts) * parts
    vecs = {i: v + [0] * (width - len(v)) for i, v in vecs.items()}
    d = width // parts
    cut = {i: [v[p * d : (p + 1) * d] for p in range(parts)] for i, v in vecs.items()}
    first = sorted(vecs, key=lambda i: (rows[i][0] is None, rows[i][0] or 0))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]

    def nearest(part, book):
        far = [sum((a - b) ** 2 for a, b in zip(part, e, strict=True)) for e in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p in range(parts):
            of = defaultdict(list)
            for i in cut:
                of[nearest(cut[i][p], books[p])[0]].append(cut[i][p])
            for e, members in of.items():
                books[p][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out = {}
    for i in cut:
        found = [nearest(cut[i][p], books[p]) for p in range(parts)]
        out[i] = ("".join(f"{e:02x}" for e, _ in found), sum(f for _, f in found))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


SCHEMA = "vec_id long, embedding array<float>, label int, vec string, _label int"


def check_codes(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "own", 1) for r in rows], SCHEMA)
    got = vector_codes.compress(df.repartition(3), **kw).collect()
    want, sha = loop_codes(rows)
    assert sorted((str(g["vec_id"]), str(g["label"]), g["code"], g["error"]) for g in got) == sorted((str(rows[i][0]), str(rows[i][2]), *w) for i, w in want.items())
    sums = Counter()
    for i, (_, error) in want.items():
        sums[rows[i][2]] += error
    assert all(g["label_error"] == sums[g["label"]] for g in got)
    assert {g["codebooks_sha256"] for g in got} <= {sha}


@pytest.mark.parametrize("bits", [2, 8, 20])
def test_codes_equal_a_loop(spark, bits):
    r = random.Random(bits)
    rows = [(i, [r.gauss(0, 0.125 * (1 + i % 3)) for _ in range(16)], r.choice([None, 1, 2])) for i in range(150)]
    rows = [(i, np.float32(v).tolist(), lab) for i, v, lab in rows]
    check_codes(spark, rows, bits=bits)


def test_codes_of_ties_copies_nulls_and_few_rows(spark):
    r = random.Random(3)
    grid = [(i, [float(r.randint(-1, 1)) for _ in range(8)], 1) for i in range(60)]  # many ties, unused entries
    odd = [(None, [0.5] * 8, None), (60, None, 1), (61, [0.5, None] * 4, 1), (62, [float("nan")] * 8, 1), (63, [float("inf")] * 8, 1), (5, [0.25] * 8, 2)]
    check_codes(spark, grid + odd + [grid[7]] * 50)
    check_codes(spark, grid[:3])
    check_codes(spark, [(1, [0.1, 0.2, 0.3], 1), (2, [], 1), (3, [0.5] * 9, None)])
    check_codes(spark, [(1, [], 1)])
    check_codes(spark, [])


def test_codes_decode_to_entries_and_errors(spark, sf):
    vectors = vector_codes.quantized(spark.read.parquet(f"{sf}/embeddings.parquet"))
    books = vector_codes.fit(vectors, rounds=2)
    coded = vector_codes.decode(vector_codes.encode(vectors, books), books).join(vectors.select("vec_id", "vec"), "vec_id")
    for row in coded.limit(50).collect():
        own = np.frombuffer(bytes(row["vec"]), "<i4").astype("int64")
        assert ((own - np.array(row["vector"])) ** 2).sum() == row["error"]


def test_codes_equal_their_sql(spark, sf):
    got = queries.op11_vector_codes(spark, sf).toPandas().sort_values("vec_id").reset_index(drop=True)
    con = duckdb.connect()
    con.sql(f"create view embeddings as from '{sf}/embeddings.parquet'")
    want = con.sql(queries.ORACLES["op11_vector_codes"]).df().sort_values("vec_id").reset_index(drop=True)
    assert got.astype(str).equals(want[got.columns].astype(str))


def test_dominated_entries_are_left_out():
    book = np.array([[0, 0], [10_000, 0], [0, 10_000]])
    cells = vector_codes.Cells(book, 8)
    code, far = cells.nearest(np.array([[5, 5], [9_990, 1], [5_000, 5_000], [5, 5]], dtype="int32"))
    assert code.tolist()[:2] == [0, 1] and far[0] == 50
    assert cells.measured < cells.seen * len(book)
    assert len(cells.memo) == 3


# ---- alignment


def loop_align(rows: list[tuple]) -> list[tuple]:
    a = encoders.Encoder(encoders.public_path("byte_bpe_50k.json"), True)
    b = encoders.Encoder(encoders.public_path("piece_bpe_32k.model"))
    stand_a, stand_b = a.token_bytes(), b.token_bytes()
    docs = []
    for doc_id, text in rows:
        ids_a = a._library_ids([" " + text])[0] if text else []
        ids_b = b._library_ids([text])[0] if text else []
        bytes_of = lambda ids, stand: b"".join(stand[i] for i in ids)
        if not text or {bytes_of(ids_a, stand_a), bytes_of(ids_b, stand_b)} != {(" " + text).encode()}:
            docs.append((doc_id, [], [], [], ""))
            continue

        def spans(ids, stand):
            out, at = [], 0
            for i in ids:
                out.append((i, at, at + len(stand[i])))
                at += len(stand[i])
            return out

        sa, sb = spans(ids_a, stand_a), spans(ids_b, stand_b)
        links = [(x[0], y[0]) for x in sa for y in sb if x[1] < y[2] and y[1] < x[2]]
        groups, left_a, left_b = [], list(sa), list(sb)
        for end in sorted({s[2] for s in sa} & {s[2] for s in sb}):
            take = lambda left, end=end: [left.pop(0)[0] for _ in range(sum(s[2] <= end for s in left))]
            groups.append(",".join(map(str, take(left_a))) + "|" + ",".join(map(str, take(left_b))))
        docs.append((doc_id, ids_a, ids_b, links, ";".join(groups)))
    held = Counter(p for d in docs for p in set(d[3]))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    return [
        (str(i), len(x), len(y), g.count(";") + 1 if g else 0, len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "")
        for i, x, y, links, g in docs
    ]


@pytest.mark.parametrize("block_chars", [1, 400, 10_000_000])
def test_alignment_equals_a_loop(spark, block_chars):
    texts = [*random_texts(120, 5), "", None, " ", "  ", "the▁x", "the of " * 40, "the of " * 40, "a"]
    rows = [*enumerate(texts), (None, "hello there"), (3, texts[3])]
    df = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, block string")
    got = alignment.align(df.repartition(3), block_chars=block_chars).collect()
    assert sorted((str(g[0]), *g[1:]) for g in got) == sorted(loop_align(rows))


def test_alignment_of_no_rows_and_of_none_with_tokens(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = alignment.align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert sorted(tuple(g) for g in got) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_alignment_of_a_very_long_text(spark):
    text = "the cat sat, 日本語 on. " * 4000
    (got,) = alignment.align(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert got["n_links"] == got["n_a"] + got["n_b"] - got["n_groups"] and got["n_groups"] > 4000


# ---- token files


def expected_files(rows: list[tuple]) -> list[tuple]:
    library = encoders.Encoder(encoders.public_path("byte_bpe_50k.json"))
    out, at = [], 0
    for i, t in rows:
        ids = [*library._library_ids([t or ""])[0], 0]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("file_bytes", [800, 64 * 1024 * 1024])
def test_files_round_trip(spark, tmp_path, file_bytes, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", file_bytes)
    monkeypatch.setattr(token_files.write, "__defaults__", (file_bytes,))
    texts = [*random_texts(300, 9), None, "", "x" * 50_000]
    rows = [(i * 3 - 50, t) for i, t in enumerate(texts)]
    path = str(tmp_path / "files")
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, tie int").repartition(5)
    index = token_files.write_documents(df, path).collect()
    want = expected_files(rows)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in index) == want
    assert (len({r["file"] for r in index}) > 3) == (file_bytes == 800)
    library = encoders.Encoder(encoders.public_path("byte_bpe_50k.json"))
    found = {r["doc_id"]: r["ids"] for r in token_files.read(spark, path).collect()}
    assert found == {i: [*library._library_ids([t or ""])[0], 0] for i, t in rows}
    some = token_files.lookup(spark, path, [rows[5][0], rows[200][0], 10**9]).collect()
    assert sorted((r["doc_id"], r["start"], r["ids"]) for r in some) == [(rows[k][0], want[k][1], found[rows[k][0]]) for k in (5, 200)]
    assert token_files.lookup(spark, path, [10**9]).count() == 0


def test_files_of_null_and_repeated_ids_and_no_rows(spark, tmp_path):
    rows = [(None, "first"), (7, "same"), (7, "same"), (7, "other text"), (2, "two")] + [(9, "hot")] * 40
    index = token_files.write_documents(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "a")).orderBy("start").collect()
    assert [r["doc_id"] for r in index] == [None, 2, 7, 7, 7] + [9] * 40
    assert [r["start"] for r in index] == np.cumsum([0] + [r["n_tokens"] for r in index])[:-1].tolist()
    assert token_files.write_documents(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "b")).count() == 0


def test_another_dictionary_is_refused(spark, tmp_path):
    path = str(tmp_path / "f")
    token_files.write_documents(spark.createDataFrame([(1, "a text")], "doc_id long, text string"), path)
    content = spark.read.format("binaryFile").load(f"{path}/data").first()["content"]
    other = token_files.meta_of(b"other", 2)
    with pytest.raises(ValueError, match="another dictionary"):
        list(token_files.parse(bytes(content), other))


def test_dictionary_is_the_same_each_time_and_helps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    path = encoders.public_path("byte_bpe_50k.json")
    meta = token_files.train(docs, path)
    assert meta == token_files.train(docs.repartition(7), path)
    size = lambda m: token_files.encode(docs, m, path).agg(F.sum(F.length("frame"))).first()[0]
    assert size(meta) < 0.9 * size(token_files.meta_of(b"", 2))
