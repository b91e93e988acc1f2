"""Decontamination, language ID, HTML extraction, URL filter and token counts."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.llm import decontaminate, html_text, language_id, token_counts, url_filter


def naive_substring_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_myers_equals_dynamic_programming():
    rnd = random.Random(1)
    for _ in range(300):
        p = "".join(rnd.choices("abc", k=rnd.randint(1, 80)))
        t = "".join(rnd.choices("abc", k=rnd.randint(0, 120)))
        assert decontaminate.myers_least(p, t)[0] == naive_substring_distance(p, t)


@pytest.mark.parametrize("group_chars", [1_000_000, 150])
def test_contaminated_equals_brute_force(spark, group_chars):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choices("abcdefgh", k=rnd.randint(2, 9)))
    items = [(i, " ".join(word() for _ in range(rnd.randint(3, 40)))) for i in range(12)] + [(90, None), (91, ""), (92, "tiny"), (93, "?!")]
    docs = []
    for d in range(60):
        text = " ".join(word() for _ in range(60))
        if d % 2:
            passage = list(rnd.choice(items[:12])[1])
            for _ in range(rnd.randint(0, int(0.12 * len(passage)))):
                at, kind = rnd.randrange(len(passage)), rnd.randrange(3)
                passage[at : at + (kind != 0)] = [] if kind == 1 else [rnd.choice("xyz")]
            text = text[:150] + ", " + "".join(passage).upper() + "! " + text[150:]
        docs.append((d, text))
    docs += [(100, None), (101, ""), (102, items[0][1]), (102, items[0][1]), (103, "a tiny, thing"), (104, "tinyish"), (None, items[1][1])]
    got = decontaminate.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), group_chars=group_chars
    )
    found = {(r.doc_id, r.item_id): r.distance for r in got.collect()}
    want = {}
    for d, t in docs:
        for i, p in items:
            p, t2 = decontaminate.normalised(p), decontaminate.normalised(t)
            k = int(decontaminate.ERROR_RATE * len(p))
            if p:
                p = p if k else f" {p} "
                n = naive_substring_distance(p, f" {t2} ")
                if n <= k:
                    want[d, i] = min(n, want.get((d, i), n))
    assert found == want and len(want) > 10
    left = decontaminate.decontaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == sorted(d for d, _ in docs if d is not None and d not in {x for x, _ in want})


def test_contaminated_keeps_no_group_in_the_plan(spark):
    items = spark.createDataFrame([(i, f"item number {i} with some words of its own") for i in range(20)], "item_id long, text string")
    docs = items.select(F.col("item_id").alias("doc_id"), F.concat(F.lit("before "), "text", F.lit(" after")).alias("text"))
    assert len(decontaminate.item_groups(items, 100)) > 5
    found = decontaminate.contaminated(docs, items, rate=0.0, group_chars=100)
    assert "MapInPandas" not in found._jdf.queryExecution().toString()
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(i, i) for i in range(20)]


def test_contaminated_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs, items).collect() == []


def test_posteriors_equal_enumeration():
    import itertools

    rng = np.random.default_rng(3)
    model = language_id.Crf(["a", "b", "c"], np.zeros(0, dtype="uint64"), [])
    lengths = np.array([4, 1, 6, 2])
    scores, moves = rng.normal(size=(lengths.sum(), 3)), rng.normal(size=(3, 3))
    got = model.posteriors(scores, lengths, moves)
    at = 0
    for n in lengths:
        want, total = np.zeros((n, 3)), 0.0
        for path in itertools.product(range(3), repeat=n):
            p = np.exp(sum(scores[at + t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)))
            total += p
            for t, y in enumerate(path):
                want[t, y] += p
        np.testing.assert_allclose(got[at : at + n], want / total, rtol=1e-5)
        at += n


def test_language_held_out_accuracy_and_inputs(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    scored = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    right, n = scored.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert n > 100 and right / n > 0.98
    assert got.where("score < 0 or score > 1 or lang_pred is null").count() == 0
    # a passage in a second language is labelled as such
    model = language_id.train(language_id.training_sample(docs))
    en, de = "the of that with onthing tionthe " * 8, "der die und nicht einung keitver " * 8
    words = language_id.words_of(en + de)
    post = model.posteriors(_scored(model, words), np.array([len(words)]), model.transitions)
    labels = [model.langs[i] for i in post.argmax(axis=1)]
    assert labels[5] == "en" and labels[-5] == "de"


def _scored(model, words):
    at = model.emissions(words)
    return model.scores[at]


def test_language_edge_rows(spark):
    rows = [(1, "hello there world", "en"), (2, None, "en"), (3, "12 345 !!", None), (4, "", "de"), (None, "guten tag und", "de"), (5, "guten tag und", None)]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: (r.lang_pred, r.score, r.held_out) for r in language_id.identify(docs).collect()}
    assert got[2][:2] == ("und", 0.0) and got[3][:2] == ("und", 0.0) and got[4][:2] == ("und", 0.0) and got[None][2] is True
    assert language_id.identify(docs.where("false")).collect() == []
    unlabelled = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href='/'>Home</a></ul></nav>"
    "<div class='ad'>Buy {0}</div><div id=wrap>{body}</div><div class=shared>Shared words of the site</div><footer>&copy; site {0}</footer></body></html>"
)


def test_html_rules_and_templates(spark):
    bodies = {
        1: "<article><header><h1>Title &amp; more</h1></header><p><b>One\n two<br>three<p>Next &#233;&nbsp;x</p><form>Mail <input></form><div class=comments><p>reader</p></div><ul><li>a<li>b</ul></article>",
        2: "<div>Plain text <i>in</i> a div</div><p>and a paragraph",
        3: "<p>Broken < mark-up <b>here",
        4: "",
    }
    rows = [(i, "http://h.example/x", PAGE.format(i, body=b)) for i, b in bodies.items()]
    rows += [(100 + i, "http://h.example/y", PAGE.format(i, body=f"<p>Page {i}")) for i in range(12)]
    rows += [(200, "http://h.example/n", None), (201, None, "<p>no url"), (202, "http://h.example/z", ""), (203, "http://other.example/", "<div class=shared>Shared words of the site</div>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = html_text.main_text(df)
    assert out.columns[:4] == ["page_id", "url", "text", "n_chars"]
    got = {r.page_id: r.text for r in out.collect()}
    assert got[1] == "Title & more\n\nOne two three\n\nNext é x\n\na\n\nb"
    assert got[2] == "Plain text in a div\n\nand a paragraph"
    assert got[3] == "Broken < mark-up here"
    assert got[4] == "" and got[200] == "" and got[202] == "" and got[201] == "no url"
    assert got[105] == "Page 5"  # the shared block recurs on the host and is gone
    assert got[203] == "Shared words of the site"  # but not on the other host
    assert html_text.main_text(df.where("false")).collect() == []


def test_html_long_and_copied_articles(spark):
    article = "<article><h1>Same</h1>" + "<p>word &lt; word</p>" * 3000 + "</article>"
    rows = [(i, "http://h.example/", f"<html><body>{article}</body></html>") for i in range(15)]
    texts = {r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert texts == {"Same" + "\n\nword < word" * 3000}


def test_html_copies_inside_other_elements_keep_their_text(spark):
    bodies = {
        "wrapped": "<div id=wrap><div><article><p>First words.</p><p>More words.</p></article></div></div>",
        "section": "<article><section><p>First words.</p></section><section><p>More words.</p></section></article>",
        "parts": "<article><div>First words.</div><div>More words.</div><div>Last words.</div></article>",
        "div": "<div><p>First words.</p><p>More words.</p></div>",
        "plain": "<div>First words.</div><div>More words.</div><div>Last words.</div>",
        "below": "<p>First words.</p><p>More words.</p>",
    }
    rows = [(f"http://{h}.example/?utm={i}", f"<html><body>{b}</body></html>") for h, b in bodies.items() for i in range(12)]
    # the same text on pages that differ in a few words
    rows += [(f"http://day-{h}.example/{i}", f"<html><body><div>day {i}</div>{b}</body></html>") for h, b in bodies.items() for i in range(12) if h != "plain"]
    # without a host there is no site; on a host the notice is template
    rows += [(u, f"<div>Page {i}</div><div>Shared words</div>") for u in (None, "no-scheme/x", "http://site.example/") for i in range(12)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: " ".join(r.text.split()) for r in html_text.main_text(df).collect()}
    for i, (url, source) in enumerate(rows):
        kept = [w for w in ("First", "More", "Last") if w in source]
        assert [w for w in kept if f"{w} words." in got[i]] == kept, url
        if "Shared" in source:
            assert ("Shared words" in got[i]) == (url != "http://site.example/") and "Page" in got[i]


def test_url_rules_and_vocabulary(spark):
    rows = [
        (1, "http://a.example.com/en/1"), (2, "https://www.example.com/en/1"), (3, "http://x.net/es/9"), (4, "http://X.NET/ES/9"), (5, "ftp://casino-win.org/"),
        (6, "http://free.org/cheap?x=bets"), (7, "http://freely.org/cheap"), (8, None), (9, "no scheme casino"), (10, "http://com"), (11, "http://pornographer.org/"), (12, ""), (13, "http://notexample.com/en/"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df).collect()}
    assert got[1] == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert got[2] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[3][2:] == ("net/es/", "block") and got[4] == ("x.net", "/ES/9", None, "allow")
    assert got[5][2:] == (None, "block") and got[6][3] == "block" and got[7][3] == "allow"
    assert got[8] == ("", "", None, "allow") and got[9] == ("", "", None, "block")
    assert got[10] == ("com", "", None, "allow") and got[11][3] == "allow" and got[12][3] == "allow" and got[13][2] == "com/"
    assert url_filter.judge_urls(df.where("false")).collect() == []
    assert not set(url_filter.STRICT_TERMS) & set(url_filter.SUSPECT_TERMS) and not set(url_filter.SUSPECT_TERMS) & set(url_filter.SOFT_TERMS)
    more = [(1, "http://x.org/p%6Frn"), (2, "http://x.org/%46REE-gratis"), (3, "http://x.org/free/free/free"), (4, "http://x.org/poker-win"), (5, "http://x.org/poker"), (6, "http://x.org/" + "a-" * 100_000 + "casino"), (6, "http://x.org/" + "a-" * 100_000 + "casino")]
    weights = {r.page_id: (r.weight, r.verdict) for r in url_filter.judge_urls(spark.createDataFrame(more, "page_id long, url string"), rules=()).collect()}
    assert weights == {1: (3, "block"), 2: (2, "allow"), 3: (1, "allow"), 4: (3, "block"), 5: (2, "allow"), 6: (3, "block")}


TEXTS = [
    "", None, " \n\t", "Hello World", "don't stop I'll we've", "naïve café ÉTÉ ß", "a b c", "x\x1cy \x85z", "<|endoftext|>", "ab<|startoftext|>cd <|endoftext|>", "日本語 テキスト", "é ́ a ̀",
    "1234 56,78", "!!! ??? ...", "word " * 3000, "supercalifragilistic" * 30, "İstanbul Σίσυφος ΟΔΟΣ", "a'sb 's", " x ",
]


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_counts.vocabulary_path())
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    texts = TEXTS + docs
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = {r.doc_id: r for r in token_counts.count_tokens(df, limit=500).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(t.encode()), count(t), count(t) > 500)
        fit = got[i].fit_chars
        assert count(t[:fit]) <= 500 and (fit == len(t) or count(t[: fit + 1]) > 500)
    assert token_counts.count_tokens(df.where("false")).collect() == []


def test_every_prefix_count_is_exact(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_counts.vocabulary_path())
    short = [t for t in TEXTS if t is not None and len(t) < 60]
    df = spark.createDataFrame(list(enumerate(short)), "doc_id long, text string")
    for r in token_counts.prefix_tokens(df).collect():
        want = [len(library.encode(r.text[:i], add_special_tokens=False).ids) for i in range(len(r.text) + 1)]
        assert r.prefix_tokens == want, r.text


NASTY = list("ab'sStTrReEvV09.!<|>=-") + ["'s", "'ll", "é", "e\u0301", "\u0301", "\u0338", "\u0e01", "\u0e34", "\u0e48", "\u0915", "\u093c", "\u093f", "\u094d", "\u0958", "\u1100", "\u1161", "\u11a8", "\uac00"] + [
    "日", "本", "。", "\u3000", "\xa0", "\u2003", "\x85", "\x1c", "\u200b", "İ", "ß", "Σ", "Å", "½", "²", "Ⅷ", "😀", "\U00016d63", "\U00016d67", "\u023a", "<|endoftext|>", "<|startoftext|>",
]


def test_pieces_of_chunks_add_up():
    count = token_counts.counter(token_counts.vocabulary_path())
    assert count.cuttable
    rng = random.Random(11)
    for _ in range(300):
        chunk = "".join(rng.choice(NASTY) for _ in range(rng.randrange(1, 130)))
        want = count._encoded([chunk[:j] for j in range(1, len(chunk) + 1)])
        assert count.chunk_table(chunk).tolist() == want, chunk
        for budget in (0, 1, want[-1] // 2, want[-1] - 1, want[-1]):
            fit = next((j for j, n in enumerate(want) if n > budget), len(chunk))
            assert count._chunk_within(chunk, budget) == fit, (chunk, budget)


@pytest.mark.parametrize("kind", ["base64", "prose", "nbsp", "letters"])
def test_long_chunks_are_counted_a_few_prefixes_at_a_time(monkeypatch, kind):
    rng = random.Random(3)
    text = {
        "base64": "".join(rng.choices("ABCDEFGHabcdefgh0123456789+/", k=6000)),
        "prose": "".join(rng.choices("日本語文字列は長い。、", k=6000)),
        "nbsp": "\xa0".join(["some", "words", "here"] * 400),
        "letters": "".join(rng.choices("etaoinshrdlu", k=6000)),
    }[kind]
    count, calls = token_counts.PrefixCounter(token_counts.vocabulary_path()), []
    encoded = count._encoded
    monkeypatch.setattr(count, "_encoded", lambda texts: (calls.append(sum(map(len, texts))), encoded(texts))[1])
    fit = count.longest_within(text, 200)
    assert encoded([text[:fit]])[0] <= 200 < encoded([text[: fit + 1]])[0]
    assert max(calls) <= token_counts.BATCH_CHARS and sum(calls) < 1_000_000


def test_prefixes_of_long_pieces_come_from_the_merges(monkeypatch):
    count = token_counts.PrefixCounter(token_counts.vocabulary_path())
    rng = random.Random(5)
    words = ["".join(rng.choices(kind, k=rng.randrange(1, 90))) for kind in ("abcdefghijklmnopqrstuvwxyz", "aab", "éèabçñö", "日本語文字列", "#$%&*.,;<|>", "ABcdEF") for _ in range(60)]
    for w in words:
        assert list(count.piece_counts(w)) == count._encoded([w[:j] for j in range(1, len(w) + 1)]), w
    monkeypatch.setattr(count, "_in_batches", lambda texts: [1 for _ in range(sum(1 for _ in texts))] if isinstance(texts, list) else pytest.fail("encoded again"))
    began = time.time()
    text = "".join(rng.choices("etaoinshrdlu", k=1_000_000))
    fit = count.longest_within(text, 2048)
    assert 2048 < fit < 30_000 and time.time() - began < 30


def test_other_vocabularies_are_counted_whole():
    from tokenizers import Tokenizer

    path = token_counts.vocabulary_path("byte_bpe_50k.json")
    library, count = Tokenizer.from_file(path), token_counts.PrefixCounter(path)
    texts = ["two  words", " lead", "", "a b  c d" * 20]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert count.counts(texts)[0] == want
    assert count.table(texts[0]).tolist() == [len(library.encode(texts[0][:j], add_special_tokens=False).ids) for j in range(11)]


def test_html_template_counts_equal_a_plain_loop(spark):
    rng = random.Random(8)
    rows = []
    for i in range(160):
        site = rng.choice(["a", "a", "a", "b", "c"])
        nav = "".join(f"<li>{rng.choice(['Home', 'News', 'Shop', str(i)])}</li>" for _ in range(rng.randrange(4)))
        body = f"<div><p>Text {i % 120} of the page, long enough to be most of it, {'word ' * 20}</p></div>"
        html = f"<body><ul>{nav}</ul><div class=box><span>{rng.choice(['one', 'two', str(i)])}</span></div><article>{body}</article><div>{rng.choice(['foot', str(i)])}</div></body>"
        rows.append((i, f"http://{site}.example/{i}" if rng.random() < 0.9 else None, html))
    got = {r.page_id: r for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    pages = {i: html_text.Page(html) for i, _, html in rows}
    host = {i: url.split("/")[2] if url else "" for i, url, _ in rows}
    different = lambda test: len({pages[i].key for i in pages if test(i)})
    n_template = 0
    for i, page in pages.items():
        same_host = [j for j in pages if host[j] == host[i]] if host[i] else []
        size, gone = different(lambda j: j in same_host), set()
        for value, first, end in page.subtrees:
            recurs = different(lambda j: j in same_host and any(value == s[0] for s in pages[j].subtrees))
            if recurs >= html_text.MIN_PAGES and recurs**2 >= size:
                gone |= set(range(first, end))
        kept = [t for k, (t, dropped, content) in enumerate(page.blocks) if k not in gone and content and not dropped]
        assert (got[i].text, got[i].n_template) == ("\n\n".join(kept), len(gone)), i
        assert got[i].n_template + got[i].n_markup + len(kept) == len(page.blocks)
        n_template += len(gone)
    assert n_template > 100


@pytest.mark.parametrize(
    "source",
    ["<a \"" * 40_000, "<script \"" * 40_000, "<a \"'>'" * 40_000, "<a \"'>'" * 40_001 + ">", "<b>" * 40_000 + "<div></div>" * 40_000, "<div>" * 40_000 + "</span>" * 40_000, "<p><i>x" * 40_000, "<!--" * 40_000, "</ " * 40_000],
    ids=range(9),
)
def test_html_broken_pages_take_linear_time(source):
    began = time.time()
    html_text.Page(source)
    assert time.time() - began < 10


def test_html_keeps_article_text_whatever_holds_it():
    page = lambda body: html_text.kept_text(html_text.packed_page(html_text.Page(f"<article>{body}</article>"), bytes), None)[0]
    assert page("<p>Energy <math><mi>E</mi></math> = 3 <object>three</object></p>") == "Energy E = 3 three"
    assert page("<p class='share-holder-news'>Kept</p><p class='related-work'>too</p><div class='related-posts'>gone</div><p class='site_ad box'>gone</p>") == "Kept\n\ntoo"
    assert page("<p>a < b <svg><text>label</text></svg> c") == "a < b c"


def test_grams_equal_a_plain_loop():
    words = ["a", "ab", "straße", "日本", "नमस्ते", "abcdefgh"]
    hashed, begins = language_id.grams_of(words)
    of = lambda gram: language_id.grams_of([gram])[0]
    seen = {}
    for w, at in zip(words, begins, strict=True):
        edged = f"^{w}$"
        for i in range(len(edged)):
            for c, n in enumerate((2, 3, 4, 5)):
                gram = edged[i : i + n]
                wanted = len(gram) == n and (n < 5 or i == 0 or i + n == len(edged))
                assert (hashed[at + i, c] != 0) == wanted
                if wanted:
                    assert seen.setdefault(gram, hashed[at + i, c]) == hashed[at + i, c]
    assert len(set(seen.values())) == len(seen) and len(of("ab")) == 4


def test_words_are_letters_and_marks(spark):
    assert language_id.words_of("Über ² ½ ① x1y _z नमस्ते") == ["über", "x", "y", "z", "नमस्ते"]
    rows = [(i, "the cat and dog", "en") for i in range(9)] + [(i, "der hund und die katze", "de") for i in range(20, 29)] + [(50, "² ½ ①", None)]
    got = {r.doc_id: r.lang_pred for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[50] == "und" and got[3] == "en" and got[25] == "de"


def test_language_of_long_texts_and_long_labelled_documents(spark):
    rng = random.Random(4)
    say = lambda words, n: " ".join(rng.choices(words.split(), k=n))
    en, de, xx = "the of and to in that is was for it", "der die und in den von zu das mit sich", "qo wex zud jop vak"
    rows = [(i, say(en, 30), "en") for i in range(40)] + [(i, say(de, 30), "de") for i in range(40, 80)]
    rows += [(i, say(xx, 5000), "xx") for i in range(80, 90)]  # all longer than a training window
    rows += [(100, say(en, 60_000) + " " + say(de, 20_000), None)]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows if lang)
    assert got[100].lang_pred == "en" and abs(got[100].score - 0.75) < 0.05


def test_more_than_two_hundred_languages_are_learned(spark):
    rows = [(i * 10 + j, f"{chr(0x4E00 + i) * 3} {chr(0x4E00 + i)} x", f"l{i}") for i in range(250) for j in range(6)]
    sample = language_id.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len({lang for _, lang in sample}) > 240
    model = language_id.train(sample)
    langs, _ = model.predict([f"{chr(0x4E00 + i) * 3}" for i in range(250)])
    assert sum(lang == f"l{i}" for i, lang in enumerate(langs)) > 200
