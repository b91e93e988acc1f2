"""Token ids of whole texts by a public tokenizer's library, a distinct chunk at a time.

A text is cut where no token can cross, each distinct chunk goes to the library once a
worker (a memo of bounded size), and a text's ids are its chunks' ids in a row, as
little-endian unsigned integers of ``width`` bytes.

Where a cut is safe:

- byte-level BPE (``.json``): before an ASCII white space character that follows a
  character which is no white space. The pre-tokenizer's pieces have white space at their
  start only, or throughout, so none crosses; and its one look-ahead, past a run of white
  space, sees the same characters, as chunks never end inside a run. Also between a Latin-1
  letter and ASCII punctuation that is no apostrophe, as pieces hold letters or others, and
  between a line feed that is no part of a longer run and a Latin-1 letter;
- sentencepiece BPE (``.model``): before a space that follows another character, if the
  model leaves texts as they are and no piece of its vocabulary has its space sign after
  another character. The library puts a space before each text, so a chunk goes there
  without its first.

New chunks go to the library joined, where they may stand side by side, and the ids are cut
at the chunks' ends by the bytes that tokens stand for. A chunk of a space and Latin-1 letters
is one piece of the byte-level pre-tokenizer, so such words go to the library's model in its
byte symbols, a line each, without the pre-tokenizer's pattern.

Other vocabularies, and texts with characters on which libraries differ (U+180E, the
model's space sign U+2581), are encoded whole.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

#: Distinct chunks, and their characters, that a worker remembers before it starts another memo; it keeps the one before.
MEMO_CHUNKS = 300_000
MEMO_CHARS = 10_000_000
#: Characters of chunks that go to the library at once (one chunk at least).
BATCH_CHARS = 500_000
_LETTER, _SIGN = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
#: Words of certain letters; punctuation before white space; a line feed before a letter; else up
#: to white space (a run that starts with another character than ASCII's does not end a chunk).
_BYTE_CHUNK = re.compile(rf" ?[{_LETTER}]+(?=[ \n{_SIGN}])|[{_SIGN}]+(?=[ \n])|\n(?=[{_LETTER}])|\s*\S+(?:[^\S \t-\r]\s*\S*)*|\s+")
#: One piece for the byte-level pre-tokenizer, wherever it stands as a chunk.
_BYTE_WORD = re.compile(rf" ?[{_LETTER}]+")
_PIECE_CHUNK = re.compile(r" +[^ ]+| +")
_SPACE_SIGN = "\u2581"
#: Whole characters that a normalizer would change: compatibility forms, marks, runs of spaces.
_PROBE = "a  bﬁ é Ａ　 \t½ "


def _byte_symbols() -> dict[int, str]:
    """The symbol of each byte in a byte-level vocabulary."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(others)}


_SYMBOLS = _byte_symbols()
_WORD_SYMBOLS = _SYMBOLS | {ord("\n"): "\n"}  # between words


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _batches(chunks: Iterable[str]) -> Iterator[list[str]]:
    batch, chars = [], 0
    for c in chunks:
        if batch and chars + len(c) > BATCH_CHARS:
            yield batch
            batch, chars = [], 0
        batch.append(c)
        chars += len(c)
    if batch:
        yield batch


class Encoder:
    """Ids of texts for one vocabulary file, without begin, end or added special tokens.

    An encoder is used with ``exact`` always or never. ``special_as_text`` reads the strings of special tokens in texts as ordinary text; else
    they are handled as the library does by default.
    """

    def __init__(self, path: str, special_as_text: bool = False, memo_chunks: int = MEMO_CHUNKS):
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # the memo before this one
        self.memo_chunks, self.memo_chars = memo_chunks, 0
        self.pieces = path.endswith(".model")
        if self.pieces:
            from sentencepiece import SentencePieceProcessor

            self.library = SentencePieceProcessor(model_file=path)
            self.size = self.library.get_piece_size()
        else:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            self.library.no_truncation()
            self.library.no_padding()
            self.library.encode_special_tokens = special_as_text
            self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.width = 2 if self.size <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.cuttable = self._pieces_cuttable() if self.pieces else self._bytes_cuttable()
        self.words = None
        if self.cuttable and not self.pieces:
            from tokenizers.pre_tokenizers import CharDelimiterSplit

            self.words = Tokenizer(self.library.model)  # the same model, not a copy
            self.words.pre_tokenizer = CharDelimiterSplit("\n")
        #: a space at the end of a text, to which the library gives nothing when it stands alone
        self.fixed = {" ": np.array([self.library.piece_to_id(_SPACE_SIGN)], dtype=self.dtype).tobytes()} if self.pieces else {}
        self.memo.update(self.fixed)
        #: the bytes of each id
        self.stand = self.token_bytes()
        self.lengths = np.array([len(t) for t in self.stand], dtype="int64")
        self.lossy: set[str] = set()

    def _pieces_cuttable(self) -> bool:
        names = self.library.id_to_piece(list(range(self.size)))
        across = any(_SPACE_SIGN in n.lstrip(_SPACE_SIGN) for n in names)
        return not across and self.library.normalize(_PROBE) == _SPACE_SIGN + _PROBE.replace(" ", _SPACE_SIGN)

    def _bytes_cuttable(self) -> bool:
        parts = json.loads(self.library.to_str())
        pre, added = parts.get("pre_tokenizer") or {}, parts.get("added_tokens") or []
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex")
        odd = any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or re.search(rf"\s|^[{_LETTER}]+[{_SIGN}]", t["content"]) for t in added)
        return bool(plain) and parts.get("normalizer") is None and not odd

    def _library_ids(self, texts: list[str]) -> list[list[int]]:
        if self.pieces:
            return self.library.encode(texts, num_threads=1)
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _whole(self, texts: list[str]) -> list[bytes]:
        """Packed ids of texts that the library gets one by one; for pieces they start with a space."""
        given = [t[1:] for t in texts] if self.pieces else texts
        return [np.array(ids, dtype=self.dtype).tobytes() for ids in self._library_ids(given)]

    def _joined(self, chunks: list[str]) -> list[bytes]:
        """Packed ids of chunks that start with white space and end with another character."""
        text = "".join(chunks)
        return self._parted(chunks, self._library_ids([text[1:] if self.pieces else text])[0])

    def _of_words(self, words: list[str]) -> list[bytes]:
        """Packed ids of chunks that are one piece each."""
        symbols = "\n".join(words).encode().decode("latin-1").translate(_WORD_SYMBOLS)
        return self._parted(words, self.words.encode_batch_fast([symbols], add_special_tokens=False)[0].ids)

    def _parted(self, chunks: list[str], found: list[int]) -> list[bytes]:
        """The packed ids of each of the chunks whose ids are ``found``; one by one, if tokens do not end where they do."""
        ids = np.array(found, dtype=self.dtype)
        ends = np.cumsum(self.lengths[ids])
        wanted = np.cumsum([len(c.encode()) for c in chunks])
        at = np.searchsorted(ends, wanted)
        if not len(ends) or ends[-1] != wanted[-1] or (ends[at] != wanted).any():
            return self._whole(chunks)
        data, stops = ids.tobytes(), ((at + 1) * self.width).tolist()
        return [data[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def chunks(self, text: str) -> list[str] | None:
        """The chunks of a text, which join to it; None if it must stay whole. For pieces the text starts with a space."""
        if not self.cuttable or text in ("", " ") or "\u180e" in text or _SPACE_SIGN in text:
            return None
        return (_PIECE_CHUNK if self.pieces else _BYTE_CHUNK).findall(text)

    def learn(self, new: set[str], exact: bool) -> None:
        """Different chunks that the memo lacks go into it, and if ``exact`` into ``lossy`` if their tokens stand for other bytes."""
        memo, older = self.memo, self.older
        word = _BYTE_WORD.fullmatch if self.words else None
        again = new.intersection(older)
        memo.update((c, older[c]) for c in again)
        for batch in _batches(new - again):
            self.memo_chars += sum(map(len, batch))
            apart, beside, words = [], [], []
            for c in batch:
                (words if word and word(c) else apart if c[0] not in " \n" or c[-1].isspace() else beside).append(c)
            for part, ids_of in ((apart, self._whole), (beside, self._joined), (words, self._of_words)):
                ids = ids_of(part) if part else []
                memo.update(zip(part, ids, strict=True))
                if exact and not self.stands(b"".join(ids), "".join(part)):
                    self.lossy.update(c for c, i in zip(part, ids, strict=True) if not self.stands(i, c))

    def _chunk_ids(self, cuts: list[list[str]], exact: bool) -> list[list[bytes]]:
        """The packed ids of each chunk of each text."""
        if len(self.memo) > self.memo_chunks or self.memo_chars > MEMO_CHARS:
            self.older, self.memo, self.memo_chars = self.memo, dict(self.fixed), 0
        memo = self.memo
        found = [list(map(memo.get, c)) for c in cuts]
        gaps = [k for k, ids in enumerate(found) if None in ids]
        self.learn({c for k in gaps for c, i in zip(cuts[k], found[k], strict=True) if i is None}, exact)
        for k in gaps:
            found[k] = [memo[c] if i is None else i for c, i in zip(cuts[k], found[k], strict=True)]
        return found

    def stands(self, ids: bytes, text: str) -> bool:
        """Do the tokens stand for the bytes of the text?"""
        return b"".join(map(self.stand.__getitem__, np.frombuffer(ids, self.dtype).tolist())) == text.encode()

    def encode(self, texts: list[str], exact: bool = False) -> list[bytes]:
        """Packed ids of texts. For pieces a text starts with the space that the library would put before it.

        ``exact``: nothing for texts whose tokens stand for other bytes.
        """
        out: list[bytes] = []
        held: list[tuple[str, list[str]]] = []
        chars = 0
        for text in [*texts, None]:
            cut = None if text is None else self.chunks(text)
            if cut is not None:
                held.append((text, cut))
                chars += len(text)
            if cut is None or chars > BATCH_CHARS:
                for (t, c), parts in zip(held, self._chunk_ids([c for _, c in held], exact), strict=True):
                    ids = b"".join(parts)
                    # where no chunk is lossy the whole is right; where one is, another may make up for it
                    sure = not exact or not self.lossy or self.lossy.isdisjoint(c) or self.stands(ids, t)
                    out.append(ids if sure else b"")
                held, chars = [], 0
            if cut is None and text is not None:
                (ids,) = self._whole([text])
                out.append(ids if not exact or self.stands(ids, text) else b"")
        return out

    def token_bytes(self) -> list[bytes]:
        """What each id stands for: byte-level symbols decoded; pieces in UTF-8 with their spaces and bytes."""
        if self.pieces:
            names = self.library.id_to_piece(list(range(self.size)))
            single = [self.library.is_byte(i) for i in range(self.size)]
            return [bytes([int(n[3:5], 16)]) if b else n.replace(_SPACE_SIGN, " ").encode() for n, b in zip(names, single, strict=True)]
        byte = {s: b for b, s in _SYMBOLS.items()}
        added = {t for t in self.library.get_added_tokens_decoder()}
        names = [self.library.id_to_token(i) or "" for i in range(self.size)]
        return [n.encode() if i in added else bytes(byte[c] for c in n) for i, n in enumerate(names)]


@functools.lru_cache(maxsize=4)
def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """One encoder for each worker and vocabulary."""
    return Encoder(path, special_as_text)
