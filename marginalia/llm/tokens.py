"""Token ids of whole texts by a public tokenizer, with each distinct word encoded once."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from marginalia.llm.common import ragged, raw_text
from marginalia.llm.hashing import LOWER, KeyTable, prefix_sums, range_hash

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: White space that str.split() knows and the tokenizer's \s does not.
SPLIT_ONLY = "\x1c\x1d\x1e\x1f"
CHUNKS = re.compile(r"(?:[^\s]|[\x1c-\x1f])+")
#: Lower-cased texts whose normal form and words are plain to see: printable ASCII and Latin-1 letters.
SIMPLE = re.compile(r"[\t\n\r\x20-\x7e\xdf-\xf6\xf8-\xff]*").fullmatch
#: The vocabulary's word pattern over those characters.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\sa-z0-9\xdf-\xf6\xf8-\xff]+").findall


#: Classes of the bytes of plain texts: 0 white space, 1 letter, 2 digit, 3 other; 9 is not plain.
CLASS = np.full(256, 9, np.uint8)
CLASS[0x21:0x7F] = 3
CLASS[[0x09, 0x0A, 0x0D, 0x20]] = 0
CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), 0xC3]] = 1
CLASS[0x30:0x3A] = 2
CLASS[0x27] = 9


def plain_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Splits texts of printable ASCII without apostrophes, and Latin-1 letters, into words by their bytes alone.

    Returns which texts are such, the lower-cased bytes, and starts and ends of the words of those texts.
    """
    low, kind = LOWER[raw], CLASS[raw]
    before = np.concatenate((np.zeros(1, np.uint8), raw[:-1])) if len(raw) else raw
    latin = before == 0xC3
    tail = (raw >= 0x80) & (raw < 0xC0)
    low[latin & (raw < 0x9F) & tail & (raw != 0x97)] += 32
    bad = (kind == 9) | (tail & ~latin) | (latin & ((raw == 0x97) | (raw == 0xB7)))
    mark = (raw == 0x7C) & (before == 0x3C)  # <| may begin a special token
    plain = np.diff(np.concatenate((np.zeros(1, np.int64), np.cumsum(bad | mark)))[offsets]) == 0
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    edge = np.ones(len(raw) + 1, bool)
    if len(raw):
        edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    edge |= first
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    used = (kind[starts] != 0) & np.repeat(plain, np.diff(np.searchsorted(starts, offsets))) if len(raw) else np.zeros(0, bool)
    return plain, low, starts[used], ends[used]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkEncoder:
    """Encodes texts as the tokenizer does without special tokens.

    The vocabulary splits texts into words before it applies merges, and drops white space, so a text's ids are those
    of its words in turn. Plain texts are split by their bytes, and each distinct word goes to the tokenizer's model
    once. Other texts are split by the vocabulary's pattern, or else each distinct chunk between white space goes
    through the whole tokenizer once. Beyond `most` known words and chunks, those seen only once are forgotten.
    """

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.letters = self._byte_letters()
        self.index: dict[str, int] = {}  # words and chunks of texts that aren't plain
        self.flat, self.length, self.uses = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.tables = [(KeyTable(np.zeros(0, np.uint64)), np.zeros(0, np.int64))] * 2  # hashes of plain words: most of them, and the latest

    @staticmethod
    def _byte_letters() -> dict[int, str]:
        """How byte-level vocabularies write the UTF-8 bytes of Latin-1 characters: printable bytes as themselves, the rest from U+0100 on."""
        printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        rest = iter(range(0x100, 0x200))
        letter = {b: chr(b) if b in printable else chr(next(rest)) for b in range(256)}
        return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0x80, 0x100)}

    def _forget(self) -> None:
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) > self.most // 2:
            keep = np.sort(keep[np.argsort(-self.uses[keep], kind="stable")[: self.most // 2]])
        place = np.full(len(self.length), -1)
        place[keep] = np.arange(len(keep))
        starts = np.cumsum(self.length) - self.length
        self.flat = self.flat[ragged(starts[keep], self.length[keep])]
        self.length, self.uses = self.length[keep], np.zeros(len(keep), np.int64)
        self.index = {w: int(place[i]) for w, i in self.index.items() if place[i] >= 0}
        keys = np.concatenate([t.keys for t, _ in self.tables])
        at = place[np.concatenate([x for _, x in self.tables])]
        self.tables = [(KeyTable(keys[at >= 0]), at[at >= 0]), (KeyTable(keys[:0]), at[:0])]

    def _learn(self, words: list[str], chunks: bool = False) -> np.ndarray:
        """Adds words, or chunks, which go through the whole tokenizer; their codes."""
        lengths, flat = [], []
        tokenize, letters = self.tokenizer.model.tokenize, self.letters
        for w in words:
            if chunks:
                ids = self.tokenizer.encode(w, add_special_tokens=False).ids
            else:
                ids = [t.id for t in tokenize(w if w.isascii() else w.translate(letters))]
            flat += ids
            lengths.append(len(ids))
        codes = len(self.length) + np.arange(len(lengths))
        self.flat = np.concatenate((self.flat, np.array(flat, np.uint32)))
        self.length = np.concatenate((self.length, np.array(lengths, np.int64)))
        self.uses = np.concatenate((self.uses, np.zeros(len(lengths), np.int64)))
        return codes

    def _plain_codes(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = range_hash(prefix_sums(low), starts, ends)
        (main, main_at), (late, late_at) = self.tables
        codes = main.find(h)
        codes[codes >= 0] = main_at[codes[codes >= 0]]
        rest = np.flatnonzero(codes < 0)
        if len(rest):
            again = late.find(h[rest])
            again[again >= 0] = late_at[again[again >= 0]]
            codes[rest] = again
            rest = rest[again < 0]
        if len(rest):
            keys, one, back = np.unique(h[rest], return_index=True, return_inverse=True)
            data = low.tobytes()
            found = self._learn([data[a:b].decode() for a, b in zip(starts[rest[one]].tolist(), ends[rest[one]].tolist(), strict=True)])
            codes[rest] = found[back]
            keys, at = np.concatenate((late.keys, keys)), np.concatenate((late_at, found))
            if len(keys) > 60_000:
                self.tables = [(KeyTable(np.concatenate((main.keys, keys))), np.concatenate((main_at, at))), (KeyTable(keys[:0]), at[:0])]
            else:
                self.tables[1] = (KeyTable(keys), at)
        return codes

    def _other_codes(self, text: str) -> np.ndarray:
        low = text.lower()
        chunks = "<|" in text or not SIMPLE(low)
        found = WORDS(low) if not chunks else CHUNKS.findall(text) if any(c in text for c in SPLIT_ONLY) else text.split()
        keys = [f"{c}\n" for c in found] if chunks else found
        if new := list(set(keys).difference(self.index)):
            codes = self._learn([w[:-1] for w in new] if chunks else new, chunks)
            self.index.update(zip(new, codes.tolist(), strict=True))
        return np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))

    def encode(self, column: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts of a string column, each text's followed by `end`, and n + 1 offsets."""
        if len(self.length) > self.most:
            self._forget()
        n = len(column)
        raw, offsets = raw_text(column)
        plain, low, starts, ends = plain_words(raw, offsets)
        codes = self._plain_codes(low, starts, ends)
        words = np.diff(np.searchsorted(starts, offsets))
        where = np.cumsum(words) - words
        other = np.flatnonzero(~plain).tolist()
        if other:
            more, total = [codes], len(codes)
            for k in other:
                more.append(self._other_codes(column[k].as_py() or ""))
                where[k], words[k] = total, len(more[-1])
                total += len(more[-1])
            codes = np.concatenate(more)[ragged(where, words)]
        self.uses += np.bincount(codes, minlength=len(self.uses))
        first = np.cumsum(self.length) - self.length
        lengths = self.length[codes]
        ids = self.flat[ragged(first[codes], lengths)] if len(codes) else np.zeros(0, np.uint32)
        edges = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(words)))]
        if end is not None:
            ids = np.insert(ids, edges[1:], np.uint32(end))
            edges = edges + np.arange(n + 1)
        return ids.astype("<u4", copy=False), edges


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each Python worker and tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
