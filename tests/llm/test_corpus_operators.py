"""Chat formatting, mixing, sharding and the pipeline."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from freshet.llm import chat, mixing, sharding

EVENTS = "conv_id long, turn long, seq long, kind string, role string, text string"


def naive_fold(log):
    """Messages of one turn by a plain loop over sorted events."""
    kinds = set(chat.KINDS)
    out = []
    for _, kind, role, text in sorted(((s, k if k in kinds else "message", r, t) for s, k, r, t in log), key=lambda e: (e[0], e[1], e[2] or "", e[3] or "")):
        if kind == "message" or not out:
            out.append({"role": role, "text": (text or "") if kind != "delete" else "", "gone": kind == "delete"})
            continue
        m = out[-1]
        if role is not None:
            m["role"] = role
        if kind == "delta":
            m["text"] += text or ""
            m["gone"] = False
        elif kind == "delete":
            m["text"], m["gone"] = "", True
        else:
            m["text"], m["gone"] = text or "", False
    return [(m["role"] or "", m["text"]) for m in out if not m["gone"]]


def test_fold_equals_a_loop(spark):
    rnd = random.Random(4)
    kinds = ["message", "delta", "delta", "delta", "edit", "regenerate", "delete", None]
    logs, rows = {}, []
    for c in range(25):
        for t in range(3):
            seqs = rnd.sample(range(100), rnd.randint(1, 12))
            log = [(s, "message" if i == 0 else rnd.choice(kinds), rnd.choice(["user", "assistant"]) if i == 0 else None, rnd.choice(["a", "b<|im_end|>", "", None, "é"])) for i, s in enumerate(sorted(seqs))]
            logs[c, t] = log
            rows += [(c, t, *e) for e in log]
    rnd.shuffle(rows)
    got = {}
    for r in chat.fold_events(spark.createDataFrame(rows, EVENTS)).orderBy("conv_id", "turn", "part").collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text))
    assert got == {k: v for k, v in ((k, naive_fold(log)) for k, log in logs.items()) if v}


HARD = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|", "<|", "|>", "<", "\\", "a<", "|b", "<|im_end|>\n", "\n\n", "", None, "é<|x|>漢字", "tail <"]


def test_round_trip_and_loss_mask(spark):
    rows = []
    for c in range(4):
        for t, text in enumerate(HARD):
            rows.append((c, t, "assistant" if (t + c) % 2 else ["user", "sys\ntem", "od\\d<|", None][c], text))
    rows.append((0, 0, *rows[0][2:]))  # a repeated row
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("clash"))
    rendered = chat.render(chat.fold_events(chat.events_of(df)))
    got = {r.conv_id: r for r in chat.digest(rendered).collect()}
    for c in range(4):
        turns = sorted(((t, r or "", x or "") for cc, t, r, x in rows if cc == c), key=lambda z: z[0])
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in rendered.collect():
        assert r.formatted.count(chat.START) == r.formatted.count(chat.END + "\n") == len(HARD) + (r.conv_id == 0)
    assert chat.digest(chat.render(chat.fold_events(chat.events_of(df.where("false"))))).collect() == []


def naive_targets(sizes, limit=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    capped = set()
    while True:
        free = [s for s in order if s not in capped]
        left = sum(sizes.values()) - sum(limit * sizes[s] for s in capped)
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > limit * sizes[s]}
        if not over:
            return {s: limit * sizes[s] if s in capped else weight[s] * level for s in order}
        capped |= over


def corpus(spark, seed=5):
    rnd = random.Random(seed)
    rows, i = [], 0
    for source, docs, longest in [("big", 300, 120), ("mid", 60, 100), ("ä", 20, 60), ("tiny", 4, 5), ("zero", 3, 0), (None, 30, 50)]:
        for _ in range(docs):
            rows.append((i, " ".join(rnd.choices(["w", "longer", "é"], k=rnd.randint(0 if longest < 1 else 1, longest))), source))
            i += 1
    rows += [(9000, None, "mid"), (9001, rows[0][1], "big"), (9001, rows[0][1], "big"), (9002, " \t ", "mid")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("block_words", [1, 32])
def test_mix_meets_targets(spark, block_words):
    rows, df = corpus(spark)
    got = mixing.mix(df.withColumn("size", F.lit("clash")), block_words).collect()
    again = mixing.mix(df.repartition(7), block_words).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert len(got) == len(rows)
    sizes, source_of = {}, {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
        source_of[i] = s
    targets = naive_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - targets[s]) < 1e-6 * max(1, targets[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s, t in taken.items():
        assert abs(t - targets[s]) <= 4 * block_words + 3, (s, t, targets[s])


def test_mixed_repeats_whole_documents(spark):
    rows, df = corpus(spark)
    plan = mixing.mix(df)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    want = {}
    for r in plan.collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + (int(r.taken / r.size + 0.5) if r.size else 1)
    have = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert have == {k: v for k, v in want.items() if v}


def test_mix_of_nothing_and_of_no_words(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(none).collect() == [] and mixing.mixed(none).collect() == []
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert {(r.doc_id, r.taken) for r in mixing.mix(blank).collect()} == {(1, 0), (2, 0)}


def test_sharding_laws(spark):
    import zlib

    rows = [(i, f"text {i}" * (i % 5)) for i in range(3000)] + [(7, "text 7text 7"), (7, "text 7text 7"), (None, None), (None, "é")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash"))
    got = sharding.shard_documents(df, 40).collect()
    assert len(got) == len(rows)
    by_shard, shard_of = {}, {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r.slot)
        assert shard_of.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
        assert r.grown_shard in (r.shard, 40) and r.law == "key"
    assert set(by_shard) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    moved = sum(a != b for a, b in shard_of.values())
    assert 0 < moved < 3 * len(shard_of) / 41
    one = {r.doc_id: r for r in got}
    assert one[4].size == len(("text 4" * 4).encode()) + 16 and one[4].text_crc32 == zlib.crc32(("text 4" * 4).encode())
    # the shard depends on the key and the shards alone
    alone = sharding.shard_documents(df.where("doc_id % 3 = 0").repartition(5), 40)
    assert all((r.shard, r.grown_shard) == shard_of[r.doc_id] for r in alone.collect())
    assert sharding.shard_documents(df.where("false")).collect() == []


def test_rendezvous_follows_weights(spark):
    ids = spark.range(20000)
    counts = {r.s: r["count"] for r in ids.select(sharding.rendezvous(F.col("id"), [1.0, 2.0, 5.0]).alias("s")).groupBy("s").count().collect()}
    assert [round(counts[i] / 20000, 1) for i in range(3)] == [0.1, 0.2, 0.6]


def test_very_long_texts(spark):
    from freshet.llm import decontaminate, simhash

    rnd = random.Random(3)
    words = rnd.choices([f"w{i}" for i in range(500)], k=200_000)
    item = "a benchmark item that stands far inside of a very long document, with a typo"
    long = " ".join([*words[:150_000], item.replace("typo", "tipo"), *words[150_000:]])
    docs = spark.createDataFrame([(1, long), (2, long.upper()), (3, "short")], "doc_id long, text string")
    classes = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert classes == {1: 1, 2: 1, 3: 3}
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.contaminated(docs, items).collect()}
    assert found == {(1, 7, 1), (2, 7, 1)}
    assert [r.doc_id for r in decontaminate.decontaminated(docs, items).collect()] == [3]
    talk = [(1, t, "assistant" if t % 2 else "user", f"turn {t} <|im_end|> " * 5) for t in range(1500)] + [(2, 0, "assistant", "x<|" * 500_000)]
    table = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digest(chat.render(chat.fold_events(chat.events_of(table)))).collect()}
    assert got[1].n_turns == 1500 and got[1].loss_chars == sum(len(t) for _, n, _, t in talk[:-1] if n % 2)
    assert got[2].loss_sha256 == hashlib.sha256(talk[-1][3].encode()).hexdigest()


def test_decontaminated_judges_each_row(spark):
    from freshet.llm import decontaminate

    items = spark.createDataFrame([(i, f"item number {i} with quite some words of its own") for i in range(6)], "item_id long, text string")
    rows = [(None, "item number 3 with quite some words of its own"), (None, "clean"), (5, "clean"), (5, "x item number 4 with quite some words of its own x"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hit", F.lit("clash"))
    for group_chars in (1_000_000, 60):
        left = decontaminate.decontaminated(docs, items, group_chars=group_chars)
        assert left.columns == docs.columns
        assert sorted(map(repr, [(r.doc_id, r.text) for r in left.collect()])) == sorted(map(repr, [(None, "clean"), (5, "clean"), (6, None)]))


def test_golden_points_stay_apart(spark):
    from fractions import Fraction

    for first in (0, 10**12, 2**52 - 500):
        got = [r.x for r in spark.range(first, first + 1000).select(mixing.golden_point(F.col("id")).alias("x")).collect()]
        assert got == [float(Fraction(i * mixing.GOLDEN % 2**52, 2**52)) for i in range(first, first + 1000)]
        assert len(set(got)) == 1000 and max(b - a for a, b in zip(sorted(got), sorted(got)[1:], strict=False)) < 0.003


def test_mixed_comes_in_order_of_slots(spark):
    rows, df = corpus(spark)
    first = {r.doc_id: r.first_slot for r in mixing.mix(df).collect()}
    out = [r.doc_id for r in mixing.mixed(df).where("text rlike '[a-zé]'").collect()]
    seen = list(dict.fromkeys(out))
    assert [first[i] for i in seen] == sorted(first[i] for i in seen) and len(set(seen)) > 100


def test_pipeline_keeps_documents_when_nothing_can_be_learned(spark):
    import corpus_pipeline as p

    docs = spark.createDataFrame([(1, "some text", None, "a"), (2, "1 2 3", None, "a"), (3, None, None, "b")], "doc_id long, text string, lang string, source string")
    assert [r.doc_id for r in p.language(spark, docs, "").collect()] == [1]
    assert [p.least_score(n) for n in (1, 2, 4, 100)] == [0.9, 0.7, 0.35, 0.2]


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as p

    from freshet.llm import common, decontaminate, language_id, simhash

    docs = common.documents(spark, sf)
    columns, before = docs.columns, docs
    for name, stage in p.STAGES:
        after = common.stored(stage(spark, before, sf))
        if name != "shard":
            assert after.columns == columns
        if name == "language":
            gone = before.join(after, "doc_id", "left_anti").select("doc_id", "text")
            assert all(not language_id.words_of(r.text or "") for r in gone.collect())
        if name == "near_dedup":
            classes = simhash.near_duplicates(before)
            assert sorted(r.doc_id for r in after.select("doc_id").collect()) == sorted(r[0] for r in classes.select("component_id").distinct().collect())
        if name == "decontaminate":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            norm = [decontaminate.normalised(t) for _, t in items]
            left = [decontaminate.normalised(r.text) for r in after.select("text").collect()]
            assert not any(n in t for n in norm for t in left)
            assert after.count() < before.count()
        if name == "mix":
            assert after.join(before, "doc_id", "left_anti").count() == 0
        if name == "shard":
            assert after.count() == before.count() and set(columns) <= set(after.columns)
        before = after
    assert p.run(spark, sf).count() == before.count()
    empty = docs.where("false")
    for _, stage in p.STAGES:
        empty = stage(spark, empty, sf)
        assert empty.count() == 0


def test_queries_run_and_have_the_contract_columns(spark, sf):
    from freshet.llm.queries import ORACLES, QUERIES

    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) == 13
    want = {
        "op1": {"query_id", "rank", "vec_id", "score"}, "op2": {"doc_id", "fingerprint", "component_id"}, "op3": {"page_id", "url", "text", "n_chars"},
        "op4": {"page_id", "host", "path", "rule", "verdict"}, "op6": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
        "op7": {"doc_id", "n_bytes", "n_tokens", "over_limit"}, "op9": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
        "op10": {"doc_id", "size", "source_size", "target", "taken"}, "op11": {"vec_id", "code", "error", "label_error", "codebooks_sha256"},
        "op12": {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"}, "op13": {"doc_id", "start", "n_tokens", "ids_crc32"},
    }
    for name, query in QUERIES.items():
        if (key := name.split("_")[0]) in want:
            df = query(spark, sf)
            assert want[key] <= set(df.columns), name
