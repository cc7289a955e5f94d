"""Token ids of whole texts with a public tokenizer file, each distinct unit encoded once and then looked up.

Units are words (the tokenizer's splits never join what white space separates). A word of plain letters (A-Z, a-z,
U+00C0 to U+00FF) and other ASCII is cut further into runs of letters, which are lower-cased and go to the tokenizer's
BPE model directly, and the rest; words with anything else, an apostrophe or a bar are encoded whole. Units are looked up by a 64-bit
hash (a collision among a few million units has a probability of about 1e-7).
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa

from .common import byte_set, first_rows, slices, utf8, word_hashes, word_spans

END_OF_DOCUMENT = 1
#: Words whose ids a Python worker keeps between slices.
CACHED_WORDS = 600_000
_tables: dict = {}


def public_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# Byte-level BPE writes every byte as a printable character: its own code point, or one from 256 on.
_PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
_PRINT = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_PRINTED))}
_ASCII_LETTER = byte_set((0x41, 0x5A), (0x61, 0x7A))
_ODD = byte_set((0x27, 0x27), (0x7C, 0x7C), (0x80, 0xFF))


def units(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, word and kind (0 letters, 1 other ASCII, 2 whole word) of the units of words."""
    n = len(data)
    letter, odd = _ASCII_LETTER[data], _ODD[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) if n > 1 else np.zeros(0, np.int64)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # not the signs for times and division
    for at in (lead, lead + 1):
        letter[at], odd[at] = True, False
    odds = np.concatenate(([0], np.cumsum(odd)))
    whole = odds[ends] > odds[starts]
    turn = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    of = np.maximum(np.searchsorted(starts, turn, "right") - 1, 0)
    turn = turn[(turn > starts[of]) & (turn < ends[of]) & ~whole[of]] if len(starts) else turn[:0]
    first = np.sort(np.concatenate((starts, turn)))
    word = np.searchsorted(starts, first, "right") - 1
    last = np.minimum(np.concatenate((first[1:], [n])), ends[word])
    return first, last, word, np.where(whole[word], 2, np.where(letter[first], 0, 1)) if len(first) else np.zeros(0, np.int64)


class WordTable:
    """Ids of units by hash: sorted keys, and per key a range of one flat array."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def encode(self, texts: list[bytes], kinds: list[int]) -> list[list[int]]:
        out = [None] * len(texts)
        rest = [i for i, k in enumerate(kinds) if k]
        for i, k in enumerate(kinds):
            if not k:
                low = texts[i].decode("utf-8").lower()
                out[i] = [t.id for t in self.model.tokenize(low if low.isascii() else low.encode().decode("latin-1").translate(_PRINT))]
        for a in range(0, len(rest), 20_000):
            part = rest[a : a + 20_000]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([texts[i].decode("utf-8", "replace") for i in part], add_special_tokens=False), strict=True):
                out[i] = e.ids
        return out

    def lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and each word's number of ids."""
        words = len(starts)
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        starts, ends, word, kind = units(data, starts, ends)
        hashes = word_hashes(data, starts, ends, lower=True)
        whole = np.flatnonzero(kind == 2)
        hashes[whole] = word_hashes(data, starts[whole], ends[whole]) ^ np.uint64(0x5851F42D4C957F2D)
        unique, where, inverse, often = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        slot = np.minimum(np.searchsorted(self.keys, unique), max(0, len(self.keys) - 1))
        known = self.keys[slot] == unique if len(self.keys) else np.zeros(len(unique), bool)
        at, size = np.zeros(len(unique), np.int64), np.zeros(len(unique), np.int64)
        at[known], size[known] = self.at[slot[known]], self.size[slot[known]]
        new = np.flatnonzero(~known)
        raw, pick = data.tobytes(), where[new]
        ids = self.encode([raw[a:b] for a, b in zip(starts[pick].tolist(), ends[pick].tolist(), strict=True)], kind[pick].tolist())
        size[new] = [len(x) for x in ids]
        at[new] = len(self.flat) + first_rows(size[new])
        flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(size[new].sum()))))
        counts = size[inverse]
        pos = np.repeat(at[inverse] - first_rows(counts), counts) + np.arange(int(counts.sum()))
        out = flat[pos]
        keep = new[often[new] > 1] if len(self.keys) > CACHED_WORDS // 2 else new
        if len(keep) and len(self.keys) + len(keep) <= CACHED_WORDS:
            into = np.searchsorted(self.keys, unique[keep])
            self.at = np.insert(self.at, into, at[keep])
            self.size = np.insert(self.size, into, size[keep])
            self.keys = np.insert(self.keys, into, unique[keep])
            self.flat = flat
        return out, np.bincount(word, counts, minlength=words).astype(np.int64)


def table(path: str) -> WordTable:
    if path not in _tables:
        _tables[path] = WordTable(path)
    return _tables[path]


def documents_ids(column: pa.Array, path: str):
    """Yields (first row, ids, offsets): the ids of a slice's rows, each row's with END_OF_DOCUMENT after them."""
    words = table(path)
    data, at = utf8(column)
    for i, j in slices(at):
        part = data[at[i] : at[j]]
        starts, ends, row = word_spans(part, at[i : j + 1] - at[i])
        flat, counts = words.lookup(part, starts, ends)
        of = np.repeat(row, counts)
        per_row = np.bincount(of, minlength=j - i) + 1
        offsets = np.concatenate(([0], np.cumsum(per_row)))
        ids = np.full(int(offsets[-1]), END_OF_DOCUMENT, np.uint32)
        ids[np.arange(len(flat)) + of] = flat
        yield i, ids, offsets


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of one document; only longer ones are cut."""
    return [(s, min(capacity, length - s)) for s in range(0, length, capacity)]
