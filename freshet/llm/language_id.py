"""Language ID by a linear-chain conditional random field over words.

Every word of a text is labelled with a language by forward-backward. A word's score for a
language adds up learned weights of its features: character n-grams of 2 to 4 with word
edges, affixes of 1 to 4 letters (the grams that touch an edge, of up to 5 with it), and
membership in a lexicon of frequent words. Learned transition weights tie neighbours, so a
passage in a second language inside a text is labelled as such. A text of any length is read
whole: for prediction its chain is worked on in stretches of ``STRETCH`` words, with ``BESIDE``
words of the text on both sides, whose own posteriors are left out, so that messages come in
from both sides; training cuts its windows into chains of ``STRETCH`` words.
The text's language is the one with the largest mean posterior over all its words, and that
mean is the score.

Words are a letter and the letters and combining marks after it (Unicode L and M), lower-cased.

Training (numpy, on the driver) uses a bounded sample of labelled documents that are not
held out: ``SAMPLE_DOCS`` in all and ``PER_LANG`` a language at most (expected numbers, as
a hash of id and text draws them), ``TRAIN_CHARS`` characters of each, a window placed by
hash where a document is longer. All labels take part; with more languages the grams kept
are fewer (``MAX_FEATURES``, ``MAX_CELLS`` weights). Words first take their document's
language; weights without transitions are fitted; forward-backward with a sticky prior
relabels the words (documents may mix languages); then weights and transitions are fitted
together by the gradient of the sequence likelihood.

Defined results: ``und`` with score 0 if the text is null or has no letter, or if nothing
could be learned (no labels); a null id counts as held out; repeated rows are predicted
alike; ties go to the language that sorts first; an empty table gives an empty result.
Output columns replace input columns of the same name; other columns are not read by
``identify`` and kept by ``predict``. Predictions read nothing but the text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import join_counted

FOLDS = 5
PER_LANG = 300
SAMPLE_DOCS = 3000
TRAIN_CHARS = 6000
MAX_FEATURES = 60_000
MAX_CELLS = 12_000_000
LEXICON = 2000
MEMO_WORDS = 300_000
#: Words whose chains are held at once, for four languages; fewer for more.
BATCH_WORDS = 400_000
STRETCH = 256
#: Words on both sides of a stretch that it is read with.
BESIDE = 32
STICKY = 0.95

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_EDGES = (1, 2)  # code points that stand for a word's start and end
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the grams that start at each place of each word (edges included), 0 for none; where each word begins.

    Columns: grams of 2, 3 and 4, and of 5 if they touch an edge.
    """
    start, end = map(chr, _EDGES)
    codes = np.frombuffer((start + (end + start).join(words) + end).encode("utf-32-le", "surrogatepass"), "<u4").astype("uint64")
    lengths = np.fromiter(map(len, words), "int64", len(words)) + 2
    begins = np.cumsum(lengths) - lengths
    left = np.repeat(begins + lengths, lengths) - np.arange(len(codes))  # places up to the word's end
    first = np.zeros(len(codes), dtype=bool)
    first[begins] = True
    out = np.zeros((len(codes), 4), dtype="uint64")
    rolling = codes + np.uint64(1)
    for n in range(2, 6):
        rolling = rolling[:-1] * _PRIME + codes[n - 1 :] if len(rolling) > 1 else rolling[:0]
        m = len(rolling)
        mixed = (rolling ^ (rolling >> np.uint64(29))) * _PRIME + np.uint64(n)
        fits = left[:m] >= n
        if n == 5:
            fits &= first[:m] | (left[:m] == n)
        out[:m, n - 2] = np.where(fits, mixed, np.uint64(0))
    return out, begins


class Crf:
    """Weights of features and transitions, and forward-backward over batches of texts.

    Features are numbered: grams by their sorted hashes, then the lexicon, then one without weight for all others.
    """

    def __init__(self, langs: list[str], grams: np.ndarray, lexicon: list[str]):
        self.langs, self.grams = langs, np.sort(grams)
        self.lexicon = {w: len(grams) + i for i, w in enumerate(lexicon)}
        self.weights = np.zeros((len(grams) + len(lexicon) + 1, len(langs)), dtype="float32")
        self.transitions = np.zeros((len(langs), len(langs)), dtype="float32")
        self.batch_words = max(1000, BATCH_WORDS * 4 // max(4, len(langs)))
        self.memo: dict[str, int] = {}
        self.scores = np.zeros((0, len(langs)), dtype="float32")

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}, "scores": self.scores[:0]}

    def rows_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers of words, laid end to end (5 for each place of a word), and where each word's begin."""
        hashed, begins = grams_of(words)
        none = len(self.weights) - 1
        rows = np.full((len(hashed), 5), none, dtype="int64")
        if len(self.grams):
            at = np.searchsorted(self.grams, hashed)
            at[at == len(self.grams)] = 0
            rows[:, :4] = np.where(self.grams[at] == hashed, at, none)
        get = self.lexicon.get
        rows[begins, 4] = [get(w, none) for w in words]
        return rows.ravel(), begins * 5

    def emissions(self, words: list[str]) -> np.ndarray:
        """Row numbers of the words in ``self.scores``; new words are scored first."""
        if len(self.memo) > MEMO_WORDS:
            self.memo, self.scores = {}, self.scores[:0]
        memo = self.memo
        new = [w for w in set(words) if w not in memo]
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            rows, starts = self.rows_of(part)
            memo.update(zip(part, range(len(memo), len(memo) + len(part)), strict=True))
            places = self.weights[rows].reshape(-1, 5, len(self.langs)).sum(axis=1)
            self.scores = np.concatenate([self.scores, np.add.reduceat(places, starts // 5, axis=0)])
        return np.fromiter(map(memo.__getitem__, words), dtype="int64", count=len(words))

    def messages(self, scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, ...]:
        """Order of the words by place in their chain, and in that order local scores, forward and backward messages; moves.

        Chains are laid end to end in ``scores``. They are taken longest first, so that those
        still running at a step are a prefix; messages are rescaled at each step.
        """
        by_size = np.argsort(-lengths, kind="stable")
        sizes = lengths[by_size]
        begins = (np.cumsum(lengths) - lengths)[by_size]
        step = np.arange(len(scores)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = (np.repeat(begins, sizes) + step)[np.argsort(step, kind="stable")]
        running = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right")
        at = np.concatenate([[0], np.cumsum(running)])
        local = scores[order]
        local = np.exp(local - local.max(axis=1, keepdims=True)) + np.float32(1e-12)
        move = np.exp(transitions - transitions.max())
        alpha, beta = np.empty_like(local), np.ones_like(local)
        for t, n in enumerate(running):
            a = local[at[t] : at[t + 1]]
            if t:
                a = (alpha[at[t - 1] : at[t - 1] + n] @ move) * a
            alpha[at[t] : at[t + 1]] = a / a.sum(axis=1, keepdims=True)
        back = move.T.copy()
        for t in range(len(running) - 2, -1, -1):
            n = running[t + 1]
            b = (beta[at[t + 1] : at[t + 2]] * local[at[t + 1] : at[t + 2]]) @ back
            beta[at[t] : at[t] + n] = b / b.sum(axis=1, keepdims=True)
        return order, local, alpha, beta, move

    def posteriors(self, scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
        """Posterior of each label for each word of chains laid end to end."""
        order, _, alpha, beta, _ = self.messages(scores, lengths, transitions)
        joint = alpha * beta
        out = np.empty_like(joint)
        out[order] = joint / joint.sum(axis=1, keepdims=True)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text."""
        sums, counts = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), dtype="int64")
        held: list[list[str]] = []
        where: list[int] = []
        cores: list[tuple[int, int]] = []
        total = 0

        def flush() -> None:
            if held:
                lengths = np.fromiter(map(len, held), "int64", len(held))
                at = self.emissions([w for ws in held for w in ws])
                post = self.posteriors(self.scores[at], lengths, self.transitions)
                begins = np.cumsum(lengths) - lengths
                first, size = np.array(cores).T
                # a sum over each core, which is not empty; what lies between two cores is passed over
                edges = np.stack([begins + first, begins + first + size], axis=1).ravel()
                padded = np.concatenate([post, np.zeros((1, post.shape[1]))])
                np.add.at(sums, where, np.add.reduceat(padded, edges, axis=0)[::2])
            held.clear()
            where.clear()
            cores.clear()

        for i, text in enumerate(texts if self.langs else []):
            words = words_of(text) if text else []
            counts[i] = len(words)
            for a in range(0, len(words), STRETCH):
                lead = max(0, a - BESIDE)
                held.append(words[lead : a + STRETCH + BESIDE])
                where.append(i)
                cores.append((a - lead, min(STRETCH, len(words) - a)))
                total += len(held[-1])
                if total >= self.batch_words:
                    flush()
                    total = 0
        flush()
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        means = np.clip(sums / np.maximum(counts, 1)[:, None], 0, 1)
        best = means.argmax(axis=1)
        langs = [self.langs[b] if n else "und" for b, n in zip(best, counts, strict=True)]
        return langs, [float(m[b]) if n else 0.0 for m, b, n in zip(means, best, counts, strict=True)]


def _features(sample: list[tuple[list[str], str]], langs: int) -> tuple[np.ndarray, list[str]]:
    """The grams kept (most frequent, at least twice) and the lexicon."""
    counts: Counter = Counter()
    for words, _ in sample:
        counts.update(words)
    lexicon = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]]
    hashed, begins = grams_of(list(counts)) if counts else (np.zeros((0, 4), dtype="uint64"), np.zeros(0, dtype="int64"))
    times = np.repeat(np.fromiter(counts.values(), "int64", len(counts)), np.diff(np.append(begins, len(hashed))))
    grams, at = np.unique(hashed.ravel(), return_inverse=True)
    number = np.bincount(at, weights=np.repeat(times, 4), minlength=len(grams))
    usable = np.flatnonzero((grams != 0) & (number > 1))
    most = usable[np.lexsort((grams[usable], -number[usable]))][: max(1, min(MAX_FEATURES, MAX_CELLS // max(1, langs)))]
    return grams[most], sorted(lexicon)


def train(sample: list[tuple[str, str]], epochs: int = 3, batch: int = 40_000, rate: float = 0.3, decay: float = 1e-4) -> Crf:
    """A field fitted to (text, lang) pairs. Deterministic."""
    sample = [(words, lang) for text, lang in sample if (words := words_of(text))]
    langs = sorted({lang for _, lang in sample})
    model = Crf(langs, *_features(sample, len(langs)))
    if len(langs) < 2:
        return model
    # texts of all languages in turn, in batches of about `batch` words
    turn: Counter = Counter()
    dealt = []
    for words, lang in sample:
        dealt.append((turn[lang], lang, words))
        turn[lang] += 1
    dealt.sort(key=lambda x: x[:2])
    number_of_lang = {lang: i for i, lang in enumerate(langs)}
    batches, size = [[]], 0
    for _, lang, words in dealt:
        if size >= batch:
            batches.append([])
            size = 0
        batches[-1] += [(number_of_lang[lang], words[a : a + STRETCH]) for a in range(0, len(words), STRETCH)]
        size += len(words)
    number = len(langs)
    square_w, square_t = np.full_like(model.weights, 1e-6), np.full_like(model.transitions, 1e-6)
    other = (1 - STICKY) / max(1, number - 1)
    sticky = np.log(np.full((number, number), other) + np.eye(number) * (STICKY - other)).astype("float32")

    def step(rows, starts, gap, moves=None) -> None:
        lens = np.diff(np.append(starts, len(rows)))
        word = np.repeat(np.arange(len(starts)), lens)
        known = rows < len(model.weights) - 1
        rows, word = rows[known], word[known]
        grad = np.stack([np.bincount(rows, weights=gap[word, c], minlength=len(model.weights)) for c in range(number)], axis=1)
        grad = (grad / len(gap) + decay * model.weights * (grad != 0)).astype("float32")
        square_w[:] += grad**2
        model.weights -= rate * grad / np.sqrt(square_w)
        if moves is not None:
            moves = (moves / len(gap) + decay * model.transitions).astype("float32")
            square_t[:] += moves**2
            model.transitions -= rate * moves / np.sqrt(square_t)

    encoded = []
    for group in batches:
        distinct = sorted({w for _, words in group for w in words})
        number_of = {w: i for i, w in enumerate(distinct)}
        rows, starts = model.rows_of(distinct)
        ids = np.array([number_of[w] for _, words in group for w in words])
        lengths = np.array([len(words) for _, words in group])
        labels = np.repeat([y for y, _ in group], lengths)
        encoded.append((rows, starts, ids, lengths, labels))

    def scored(rows, starts, ids):
        return np.add.reduceat(model.weights[rows], starts, axis=0)[ids]

    def by_word(ids, n, gap):
        return np.stack([np.bincount(ids, weights=gap[:, c], minlength=n) for c in range(number)], axis=1)

    for _ in range(epochs):  # words one by one, with their document's language
        for rows, starts, ids, _, labels in encoded:
            s = scored(rows, starts, ids)
            p = np.exp(s - s.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(ids)), labels] -= 1
            step(rows, starts, by_word(ids, len(starts), p) * (len(starts) / len(ids)))
    # words relabelled by their passage, documents may mix languages
    relabelled = [model.posteriors(scored(rows, starts, ids), lengths, sticky).argmax(axis=1) for rows, starts, ids, lengths, _ in encoded]
    model.transitions[:] = sticky
    for _ in range(epochs):  # the whole chain
        for (rows, starts, ids, lengths, _), labels in zip(encoded, relabelled, strict=True):
            order, *found, move = model.messages(scored(rows, starts, ids), lengths, model.transitions)
            local, alpha, beta = (np.empty_like(f) for f in found)
            local[order], alpha[order], beta[order] = found
            p = alpha * beta
            p /= p.sum(axis=1, keepdims=True)
            inner = np.ones(len(ids), dtype=bool)
            inner[np.cumsum(lengths) - lengths] = False
            after = np.flatnonzero(inner)
            left, right = alpha[after - 1], beta[after] * local[after]
            scale = np.einsum("ti,ij,tj->t", left, move, right, optimize=True)
            expected = move * ((left / scale[:, None]).T @ right)
            seen = np.zeros((number, number))
            np.add.at(seen, (labels[after - 1], labels[after]), 1)
            p[np.arange(len(ids)), labels] -= 1
            step(rows, starts, by_word(ids, len(starts), p) * (len(starts) / len(ids)), (expected - seen) * (len(starts) / len(ids)))
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == 0, F.lit(True))


def training_sample(docs: DataFrame, per_lang: int = PER_LANG, sample_docs: int = SAMPLE_DOCS, chars: int = TRAIN_CHARS) -> list[tuple[str, str]]:
    """About ``per_lang`` (text, lang) pairs of each label, ``sample_docs`` in all at most; long texts by a window of ``chars``."""
    lettered = F.rlike("text", F.lit(r"\p{L}"))
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("train")), F.lit(1 << 30))
    usable = docs.where(F.col("lang").isNotNull() & lettered & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("rows", F.col("n"))
    langs = sizes.count()
    share = F.lit(float(min(per_lang, sample_docs / max(1, langs)))) / F.col("rows")
    drawn = join_counted(usable, sizes, "lang").where(draw / float(1 << 30) < share)
    place = F.pmod(F.xxhash64("text", "doc_id", F.lit("window")), F.greatest(F.length("text") - chars + 1, F.lit(1))).cast("int") + 1
    window = drawn.select("doc_id", F.substr("text", place, F.lit(chars)).alias("text"), "lang")
    return [(r["text"], r["lang"]) for r in sorted(window.collect(), key=lambda r: (r["doc_id"], r["text"], r["lang"]))]


def predict(docs: DataFrame, model: Crf, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score. No shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # bounded: MAX_CELLS weights

    @F.pandas_udf("lang string, score double")
    def labelled(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        field = shipped.value
        for texts in batches:
            langs, scores = field.predict(list(texts))
            yield pd.DataFrame({"lang": langs, "score": scores})

    return docs.withColumn("_label", labelled(F.col(text))).withColumns({"lang_pred": F.col("_label.lang"), "score": F.col("_label.score")}).drop("_label")


def identify(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id, text, lang)."""
    model = train(training_sample(docs, per_lang))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")
