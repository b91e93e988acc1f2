"""MaxScore against brute force, SimHash classes against brute force."""

import itertools
import math
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from freshet.llm import simhash, topk_search


def brute_topk(rows, k, every):
    vecs = {}
    for i, v in rows:
        if v is None or any(x is None or math.isnan(x) or math.isinf(x) for x in v):
            continue
        vecs.setdefault(i, set()).add(tuple(math.floor(256 * x) for x in v))
    out = set()
    for q in vecs:
        if q is None or q % every:
            continue
        best = sorted(
            ((max(sum(a * b for a, b in zip(x, y, strict=False)) for x in vecs[q] for y in vecs[c]), c) for c in vecs if c != q), key=lambda s: (-s[0], s[1] is None, s[1])
        )[:k]
        out |= {(q, r, c, s) for r, (s, c) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("shard_rows,cells,sparse", [(8192, 4_000_000, False), (17, 200, False), (20, 240, True)])
def test_maxscore_equals_brute_force(spark, shard_rows, cells, sparse):
    rnd = random.Random(shard_rows)
    value = lambda: 0.0 if sparse and rnd.random() < 0.85 else rnd.gauss(0, 0.2)
    rows = [(i, [value() for _ in range(12)]) for i in range(120)]
    rows += [(200, None), (201, []), (202, [None] * 12), (203, [float("nan")] * 12), (204, [float("inf")] + [0.0] * 11), (205, [0.5] * 4), (None, [0.1] * 12)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), rows[5], (6, [1.0] * 12)]  # ties, a repeated row, an id with two vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = topk_search.quantized(df)
    got = {tuple(r) for r in topk_search.search(vectors, vectors.where("id % 10 = 0"), 5, shard_rows, cells).collect()}
    assert got == brute_topk(rows, 5, 10)


def test_maxscore_fewer_than_k_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<double>")
    v = topk_search.quantized(df)
    assert len(topk_search.search(v, v).collect()) == 2
    none = topk_search.quantized(df.where("false"))
    assert topk_search.search(none, none).collect() == []


def test_maxscore_many_vectors_of_one_id_and_empty_ones(spark):
    rows = [(7, [float(i % 9), float(i % 5), 1.0]) for i in range(50)] + [(i, [float(i), 1.0, -1.0]) for i in range(6)] + [(50, []), (51, []), (None, [])]
    v = topk_search.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    for shard_rows, cells in ((8192, 4_000_000), (3, 9)):
        got = {tuple(r) for r in topk_search.search(v, v, 5, shard_rows, cells).collect()}
        assert got == brute_topk(rows, 5, 1)
    empty = topk_search.quantized(spark.createDataFrame([(i, []) for i in range(3)], "vec_id long, embedding array<double>"))
    assert {tuple(r) for r in topk_search.search(empty, empty).collect()} == {(0, 1, 1, 0), (0, 2, 2, 0), (1, 1, 0, 0), (1, 2, 2, 0), (2, 1, 0, 0), (2, 2, 1, 0)}


def test_maxscore_bounds_save_work():
    rnd = random.Random(2)
    sparse = [(i, [rnd.random() * 100 if rnd.random() < 0.05 else 0 for _ in range(60)]) for i in range(2000)]
    shard = topk_search.Shard.of([(i, [int(x) for x in v]) for i, v in sparse])
    shard.answers([(i, [int(x) for x in v]) for i, v in sparse[:20]], 5)
    assert shard.seen < 0.9 * shard.asked and shard.probes < 0.7 * shard.all_probes


def test_maxscore_large_integers_stay_exact(spark):
    rows = [(i, [float(2**20 + i), float(i)]) for i in range(20)]
    v = topk_search.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {tuple(r) for r in topk_search.search(v, v.where("id = 0")).collect()}
    assert got == {x for x in brute_topk(rows, 5, 100)}


def naive_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in low).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def naive_components(fps):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in itertools.combinations(sorted(fps), 2):
        if bin(a ^ b).count("1") <= 3:
            root[find(b)] = find(a)
    return {f: find(f) for f in fps}


def test_fingerprints_equal_the_definition(spark):
    texts = ["", None, " \t\n", "one", "Two WORDS", "a b c", "A  b c d e É é", "x y z " * 50, "the quick brown fox jumps over the lazy dog"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in simhash.near_duplicates(df).collect()}
    assert got == {i: f"{naive_fingerprint(t):016x}" for i, t in enumerate(texts)}


def test_links_connect_what_brute_force_connects(spark):
    rnd = random.Random(7)
    fps = {rnd.getrandbits(64) for _ in range(40)}
    for base in list(fps)[:12]:
        for _ in range(8):
            f = base
            for _ in range(rnd.randint(1, 5)):
                f ^= 1 << rnd.randrange(64)
            fps.add(f)
            base = f if rnd.random() < 0.5 else base
    for apart in (1, 2, 3, 4):  # pairs with no other fingerprint near, bits of one half and of both
        for _ in range(60):
            base = rnd.getrandbits(64)
            fps |= {base, base ^ sum(1 << b for b in rnd.sample(range(64) if rnd.random() < 0.6 else rnd.choice([range(32), range(32, 64)]), apart))}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    edges = simhash.links(df)
    assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 3 for r in edges.collect())
    tree = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in simhash.components(edges).collect()}
    want = naive_components(fps)
    groups = lambda m: {frozenset(f for f in fps if m.get(f, f) == v) for v in {m.get(f, f) for f in fps}}
    assert groups(tree) == groups(want)


def test_near_duplicates_classes_and_dedup(spark):
    base = " ".join(f"word{i % 37} other{i % 11}" for i in range(400))
    rows = [(5, base), (3, base + " tail"), (9, base.upper()), (4, "short one"), (7, None), (2, ""), (None, base), (4, "short one"), (11, "entirely different text here and there")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    got = simhash.near_duplicates(df)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    by_id = {r.doc_id: r.component_id for r in got.collect()}
    fps = {i: naive_fingerprint(t) for i, t in rows}
    roots = naive_components(set(fps.values()))
    want = {i: min(j for j in fps if j is not None and roots[fps[j]] == roots[f]) for i, f in fps.items()}
    assert by_id == want and got.count() == len(rows)
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_a_crowd_of_near_copies_is_one_class(spark):
    chain, f = [0], 0
    for i in range(1200):  # a Gray code: each differs from the one before by one bit
        f ^= (i + 1) & -(i + 1)
        chain.append(f)
    df = spark.createDataFrame([(f,) for f in chain], "fp long")
    tree = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    assert set(tree) == set(chain) and set(tree.values()) == {0}


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).collect() == []
    assert simhash.deduplicated(df).collect() == []
