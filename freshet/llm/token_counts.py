"""Exact token counts at every prefix of a text, by dynamic programming.

The vocabulary's pre-tokenizer drops white space, so no token crosses it and a text's
count is the sum over its chunks (runs without ASCII white space). With C_c(j) the
library's count for the first j characters of chunk c,

    N(i) = N(start of the chunk that holds i) + C_chunk(i - start)

gives the exact count N(i) of every prefix. Whole-chunk counts C_c(len) come from the
library once per distinct chunk and worker (a memo of bounded size); N at the chunk
ends is then a running sum, and a truncation or budget question is a binary search in N.

Inside a chunk the same sum runs over its pieces: no token crosses from letters to
others, from or to a digit, or over white space that is not ASCII (``cuts``, which leaves
out places where normalisation or a special token might join the sides). Inside a piece
the table is filled from its own shorter prefixes (``MergeTable``): with P(i) the count of
the first i bytes when the word goes on, and L(i) the last of those tokens,

    P(i) = P(i - |t|) + 1 for the one token t that ends at i and that merging leaves
    apart from L(i - |t|); C(i) = P(i - |t|) + 1 with t the token that ends the word at i

so nothing is encoded again, and a piece of any length takes time in proportion to the
characters up to the limit. Only pieces with characters whose normalisation depends on
their neighbours are counted prefix by prefix by the library, few at a time.

Vocabularies with another normalizer or pre-tokenizer have one chunk a text, which the
library counts, and its prefixes are counted by the library too.

Special-token strings inside texts are handled as the library does by default.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows are
counted alike; an empty table gives an empty result; input columns named like an output
column are replaced.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Distinct chunks a worker remembers before it starts afresh.
MEMO_CHUNKS = 600_000
#: Characters of texts that are split into chunks at once (one text at least).
SLICE_CHARS = 2_000_000
#: Chunks that go to the library as one text, with a marker word between them.
JOINED_CHUNKS = 200
#: Characters of prefixes, or of pieces, that go to the library at once (one text at least).
BATCH_CHARS = 200_000

# The normalizer and pre-tokenizer that ``cuts`` is written for.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Punctuation that joins neither a letter or digit before it nor a special token.
_TAIL = b".,;:!?#$%&*)"
_SPACES = frozenset("\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | {chr(c) for c in range(0x2000, 0x200B)}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def _joining() -> frozenset[str]:
    """Characters that normalisation may join with the one before."""
    parts = (unicodedata.decomposition(chr(c)).split() for c in range(0x20000))
    second = {chr(int(p[1], 16)) for p in parts if len(p) == 2 and p[0][0] != "<"}
    return frozenset(second | {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]})


@functools.cache
def _capital_with_mark() -> re.Pattern:
    """A-Z before a character that normalisation may join with a letter, other marks between them or not."""
    return re.compile(f"[A-Z][^\\x00-\\x7f]*[{''.join(sorted(_joining()))}]")


@functools.lru_cache(maxsize=50_000)
def _kind(c: str) -> tuple[str, bool]:
    """L(etter), N(umber), S(pace), O(ther) or "" (not certain), and if a piece can start with the character.

    Certain are characters that normalisation leaves one character of the same kind and
    that have had their kind since Unicode 3.2, so that all libraries agree on it.
    """
    if c in _SPACES:
        return "S", True
    kind = lambda x, data: k if (k := data.category(x)[0]) in "LN" else "O"
    low, old = c.lower(), unicodedata.ucd_3_2_0
    if len(low) != 1 or c in _joining() or c.isspace() or old.category(c)[0] == "C" or unicodedata.category(c)[0] == "C":
        return "", False
    if unicodedata.normalize("NFC", c) != c or unicodedata.normalize("NFC", low) != low:
        return "", False
    if len({kind(c, unicodedata), kind(c, old), kind(low, unicodedata)}) > 1:
        return "", False
    return kind(c, unicodedata), unicodedata.combining(c) == 0


@functools.lru_cache(maxsize=50_000)
def _most_bytes(c: str) -> int:
    """Bytes that a character can come to by normalisation, taken apart or not."""
    return max(len(t.encode()) for x in (c, c.lower()) for t in (x, unicodedata.normalize("NFD", x)))


def cuts(chunk: str, special: list[str] = ()) -> list[int]:
    """Positions that no token crosses, in the chunk and in all its prefixes; 0 first.

    An apostrophe stays with the letter after it, and a ``special`` string stays whole.
    """
    held = set()
    for word in special:
        at = chunk.find(word)
        while at >= 0:
            held.update(range(at + 1, at + len(word)))
            at = chunk.find(word, at + 1)
    out, (before, _), last = [0], _kind(chunk[0]), chunk[0]
    for i in range(1, len(chunk)):
        c = chunk[i]
        kind, starts = _kind(c)
        if starts and before and (kind != before or kind == "N") and not (last == "'" and kind == "L") and i not in held:
            out.append(i)
        before, last = kind, c
    return out


def _byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 as it is, others from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(0x100 + others.index(b)) for b in range(256)]


class MergeTable:
    """Token counts at all prefixes of one word, from the merges of a byte-pair vocabulary with word ends."""

    def __init__(self, model: dict):
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rank = {tuple(m): i for i, m in enumerate(merges)}
        self.end, self.vocab = model["end_of_word_suffix"], frozenset(model["vocab"])
        self.longest = max(len(t) - len(self.end) * t.endswith(self.end) for t in self.vocab)
        self.symbols = _byte_symbols()
        self.known: dict[tuple[str, str], bool] = {}

    def _parts(self, token: str) -> list[str]:
        if token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def _merged(self, parts: list[str]) -> list[str]:
        """Merges by rank, leftmost first."""
        while len(parts) > 1:
            pair = min(zip(parts, parts[1:], strict=False), key=lambda p: self.rank.get(p, len(self.rank)))
            if pair not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                both = i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair
                out.append(parts[i] + parts[i + 1] if both else parts[i])
                i += 1 + both
            parts = out
        return parts

    def apart(self, left: str, right: str) -> bool:
        """Do both tokens come out as they are when their characters are merged side by side?"""
        found = self.known.get((left, right))
        if found is None:
            if len(self.known) > MEMO_CHUNKS:
                self.known = {}
            found = self.known[left, right] = self._merged(self._parts(left) + self._parts(right)) == [t for t in (left, right) if t]
        return found

    def counts(self, word: str) -> Iterator[int]:
        """C(1), C(2), ... at the characters of a normalised word, which is one piece."""
        text, plain, last = "", [0], [""]
        for c in word:
            for b in c.encode():
                text += self.symbols[b]
                i = len(text)
                start = self._start(text, last, "")
                plain.append(plain[start] + 1)
                last.append(text[start:i])
            yield plain[self._start(text, last, self.end)] + 1

    def _start(self, text: str, last: list[str], end: str) -> int:
        """Where the last token of ``text`` starts."""
        i = len(text)
        for at in range(max(0, i - self.longest), i):
            token = text[at:] + end
            if token in self.vocab and self.apart(last[at], token):
                return at
        raise ValueError("a byte without a token")


class PrefixCounter:
    """Counts of whole texts and of all their prefixes for one vocabulary file."""

    def __init__(self, path: str, memo: int = MEMO_CHUNKS):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.memo_size, self.memo = memo, {}
        parts = json.loads(self.library.to_str())
        normal, pre, added = parts.get("normalizer") or {}, parts.get("pre_tokenizer") or {}, parts.get("added_tokens") or []
        first, model = (pre.get("pretokenizers") or [{}])[0], parts["model"]
        self.special = [t["content"] for t in added]
        self.cuttable = (
            normal.get("normalizers") == _NORMALIZERS
            and first.get("pattern") == {"Regex": _SPLIT}
            and first.get("behavior") == "Removed"
            and first.get("invert") is True
            and [(p.get("type"), p.get("add_prefix_space"), p.get("use_regex")) for p in pre["pretokenizers"][1:]] == [("ByteLevel", False, False)]
            and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
        )
        mergeable = model.get("type") == "BPE" and model.get("end_of_word_suffix") and not model.get("continuing_subword_prefix")
        mergeable = mergeable and not model.get("dropout") and not model.get("ignore_merges")
        self.merges = MergeTable(model) if self.cuttable and mergeable else None
        ends = [t.removesuffix("</w>") for t in model["vocab"] if t.endswith("</w>")] if self.cuttable else []
        words = sorted((w for w in ends if w.isascii() and w.isalpha() and w.islower()), key=lambda w: (-len(w), w))
        #: a word of one token, to mark the ends of chunks that go to the library together
        self.marker = next((w for w in words[:100] if self._encoded([w]) == [1]), None)

    def _encoded(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunk_counts(self, chunks: list[str]) -> list[int]:
        """Counts of chunks, which go to the library joined by the marker word.

        Where other words give the marker's token too, the number of markers tells and the
        chunks go one by one.
        """
        if self.marker is None:
            return self._encoded(chunks)
        groups = [chunks[i : i + JOINED_CHUNKS] for i in range(0, len(chunks), JOINED_CHUNKS)]
        joined = [f" {self.marker} ".join([*g, ""]) for g in groups]
        mark = self.library.encode(self.marker, add_special_tokens=False).ids[0]
        out: list[int] = []
        for group, e in zip(groups, self.library.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ends = np.flatnonzero(np.array(e.ids) == mark)
            out += (np.diff(ends, prepend=-1) - 1).tolist() if len(ends) == len(group) else self._encoded(group)
        return out

    def _chunks(self, text: str) -> list[bytes]:
        """The chunks of a text with A-Z lower-cased, as the normalizer does last.

        As they are where that would make a special token, or where a mark after A-Z may be
        composed with the small letter only: the normalizer composes before it lower-cases.
        """
        data = text.encode()
        if not text.isascii() and _capital_with_mark().search(text):
            return data.split()
        low = data.lower()
        return (data if any(w.encode() in low for w in self.special) else low).split()

    def _stem(self, chunk: bytes) -> bytes:
        """The chunk without punctuation at its end, where a piece ends there; else the chunk."""
        stem = chunk.rstrip(_TAIL)
        if not stem or len(stem) == len(chunk):
            return chunk
        last = chr(stem[-1]) if stem[-1] < 128 else stem[-4:].decode(errors="ignore")[-1]
        return stem if _kind(last)[0] in ("L", "N") else chunk

    def learn(self, chunks: set[bytes]) -> None:
        """Puts the counts of chunks not yet known into the memo; punctuation at a chunk's end is counted for itself."""
        if len(self.memo) > self.memo_size:
            self.memo = {}
        memo = self.memo
        ended, new = [], set()
        for c in chunks:
            if c not in memo:
                stem = self._stem(c)
                if len(stem) < len(c):
                    ended.append((c, stem, c[len(stem) :]))
                    new.update(x for x in ended[-1][1:] if x not in memo)
                else:
                    new.add(c)
        left = iter(new)
        while batch := list(islice(left, 5000)):
            memo.update(zip(batch, self._chunk_counts([c.decode() for c in batch]), strict=True))
        memo.update((c, memo[stem] + memo[tail]) for c, stem, tail in ended)

    def slices(self, texts: list[str]) -> Iterator[list[tuple[str, list[bytes]]]]:
        """Texts with their chunks, of which only few are held at once; the memo knows all the chunks."""
        held, chars = [], 0
        for t in texts:
            held.append((t, self._chunks(t)))
            chars += len(t)
            if chars >= SLICE_CHARS:
                self.learn(set().union(*[c for _, c in held]))
                yield held
                held, chars = [], 0
        self.learn(set().union(*[c for _, c in held]))
        yield held

    def counts(self, texts: list[str], limit: int | None = None) -> tuple[list[int], list[int]]:
        """Tokens of each text, and the characters of its ``longest_within`` the limit (of all of it without limit)."""
        tokens: list[int] = []
        fits: list[int] = []
        if not self.cuttable:
            tokens = self._encoded(texts)
            fits = [len(t) if limit is None or n <= limit else self._piece_within(t, limit) for t, n in zip(texts, tokens, strict=True)]
            return tokens, fits
        for held in self.slices(texts):
            known = self.memo.__getitem__
            for text, chunks in held:
                each = list(map(known, chunks))
                tokens.append(sum(each))
                fits.append(len(text) if limit is None or tokens[-1] <= limit else self._within(text, chunks, each, limit))
        return tokens, fits

    def _within(self, text: str, chunks: list[bytes], each: list[int], budget: int) -> int:
        """The character where the running sum of the chunks' counts goes over the budget."""
        totals = np.cumsum(each, dtype="int64")
        k = int(np.searchsorted(totals, budget, side="right"))
        data = text.encode()
        rest = data.split(None, k)[k]  # from chunk k on
        start = len(data[: len(data) - len(rest)].decode())
        return start + self._chunk_within(rest.split(None, 1)[0].decode(), budget - int(totals[k - 1] if k else 0))

    def chunk_ends(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Chunks, their end positions in characters, and N at those ends."""
        chunks, known = [c.decode() for c in text.encode().split()], self._chunks(text)
        self.learn(set(known))
        ends, at = [], 0
        for c in chunks:
            at = text.index(c, at) + len(c)
            ends.append(at)
        return chunks, np.array(ends, dtype="int64"), np.cumsum([self.memo[c] for c in known], dtype="int64")

    def pieces(self, chunk: str) -> list[str]:
        at = cuts(chunk, self.special) if self.cuttable else [0]
        return [chunk[a:b] for a, b in zip(at, [*at[1:], len(chunk)], strict=True)]

    def _in_batches(self, texts: Iterable[str]) -> Iterator[int]:
        """Counts of texts, of which only few are held at once."""
        batch, chars = [], 0
        for t in texts:
            if batch and chars + len(t) > BATCH_CHARS:
                yield from self._encoded(batch)
                batch, chars = [], 0
            batch.append(t)
            chars += len(t)
        yield from self._encoded(batch)

    def _normal(self, piece: str) -> str | None:
        """The normalised piece, if it is one word to the vocabulary and each character is normalised for itself."""
        kinds = {_kind(c) for c in piece}
        if self.merges is None or len({k for k, _ in kinds}) > 1 or not all(k in ("L", "O") for k, _ in kinds):
            return None
        return None if any(w in piece for w in self.special) else "".join(c.lower() for c in piece)

    def piece_counts(self, piece: str, first: int = 1) -> Iterator[int]:
        """C(first), C(first + 1), ... of a piece."""
        normal = self._normal(piece)
        if normal is not None:
            return islice(self.merges.counts(normal), first - 1, None)
        return self._in_batches(piece[:j] for j in range(first, len(piece) + 1))

    def chunk_table(self, chunk: str) -> np.ndarray:
        """C(1), C(2), ... of a chunk."""
        out, before = [], 0
        for piece in self.pieces(chunk):
            out += [before + n for n in self.piece_counts(piece)]
            before = out[-1]
        return np.array(out, dtype="int64")

    def _chunk_within(self, chunk: str, budget: int) -> int:
        """Characters of the longest prefix of a chunk of which no shorter prefix has over ``budget`` tokens."""
        start, pieces = 0, self.pieces(chunk)
        for piece, n in zip(pieces, self._in_batches(pieces), strict=True):
            fit = self._piece_within(piece, budget)
            if fit < len(piece):
                return start + fit
            start, budget = start + len(piece), budget - n
        return len(chunk)

    def _piece_within(self, piece: str, budget: int) -> int:
        # a prefix has at most a token a byte, so shorter ones are within
        least = self._first_with(piece, budget)
        if least > len(piece):
            return len(piece)
        return next((j for j, m in enumerate(self.piece_counts(piece, least), least - 1) if m > budget), len(piece))

    def _first_with(self, piece: str, budget: int) -> int:
        """Characters of the shortest prefix that might have over ``budget`` tokens."""
        total = 0
        for j, c in enumerate(piece, 1):
            total += _most_bytes(c)
            if total > budget:
                return j
        return len(piece) + 1

    def table(self, text: str) -> np.ndarray:
        """N(0), N(1), ..., N(len(text))."""
        out, before, end = np.zeros(len(text) + 1, dtype="int64"), 0, 0
        if not self.cuttable:
            out[1:] = list(self.piece_counts(text)) if text else []
            return out
        for chunk, stop, total in zip(*self.chunk_ends(text), strict=True):
            start = stop - len(chunk)
            out[end + 1 : start + 1] = before
            out[start + 1 : stop + 1] = before + self.chunk_table(chunk)
            before, end = total, stop
        out[end + 1 :] = before
        return out

    def longest_within(self, text: str, budget: int) -> int:
        """Characters of a longest prefix of which no shorter prefix has over ``budget`` tokens."""
        return self.counts([text], budget)[1][0]


@functools.lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def count_tokens(df: DataFrame, text: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``df`` with n_bytes, n_tokens, over_limit and fit_chars (the prefix within ``limit``). No shuffle."""
    path = path or vocabulary_path()

    @F.pandas_udf("n_tokens long, fit_chars long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        count = counter(path)
        for texts in batches:
            tokens, fits = count.counts([t or "" for t in texts], limit)
            yield pd.DataFrame({"n_tokens": tokens, "fit_chars": fits}, dtype="int64")

    return df.withColumns({"n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "_counted": counted(F.col(text))}).withColumns(
        {"n_tokens": F.col("_counted.n_tokens"), "over_limit": F.col("_counted.n_tokens") > limit, "fit_chars": F.col("_counted.fit_chars")}
    ).drop("_counted")


def prefix_tokens(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``df`` with prefix_tokens: N(0) ... N(length), the count at every prefix of the text."""
    path = path or vocabulary_path()

    @F.pandas_udf("array<long>")
    def tables(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(path)
        for texts in batches:
            yield pd.Series([count.table(t or "") for t in texts])

    return df.withColumn("prefix_tokens", tables(F.col(text)))
