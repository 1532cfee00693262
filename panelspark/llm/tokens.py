"""Token ids of whole texts with a public tokenizer file, by units that are encoded once and remembered.

Both supported pre-tokenizers cut a text at places that its bytes show: at white space, and between an ASCII letter or
digit and a plain mark.  The pieces between such cuts are encoded one by one with the same ids as in the text, so a batch
needs the tokenizer for units not seen before and puts its ids together from a table.  Units are told apart by a 64-bit
hash and their length.  Texts where the cuts need not hold (other white space, control characters, text that looks like a
special token) are encoded whole.
"""
from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa

from panelspark.llm.common import is_blank, lower_ascii, span_hashes, text_buffer

#: With more remembered units than this a worker starts anew.
UNITS = 1_000_000
_ODD = re.compile("<\\||[\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
#: Neighbours of an ASCII letter or digit that never share a token with it.
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?*#%&$")] = True
_WORD = np.zeros(256, bool)
_WORD[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = True


class UnitEncoder:
    """encode(column) gives all ids (uint32) one after the other and the n+1 places where texts begin.

    spaced: white space is part of the text (byte-level rule: a single space belongs to the next word, of a longer run all
    but the last character is one piece).  Otherwise white space is dropped and ASCII letters are lower-cased.
    """

    def __init__(self, path: str, spaced: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tok, self.spaced = Tokenizer.from_file(path), spaced
        self._reset()

    def _reset(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.at = np.empty(0, np.int64)
        self.size = np.empty(0, np.int32)
        self.ids = np.empty(1 << 16, np.uint32)
        self.used = 0

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _cuts(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the units."""
        n = len(data)
        blank = is_blank(data)
        first = np.zeros(n + 1, bool)
        first[offs] = True
        begin = first[:-1].copy()
        word, mark = _WORD[data], _MARK[data]
        begin[1:] |= (word[:-1] & mark[1:]) | (mark[:-1] & word[1:])
        if not self.spaced:
            begin[1:] |= blank[:-1] != blank[1:]
            starts = np.flatnonzero(begin)
            ends = np.append(starts[1:], n)
            keep = ~blank[starts]
            return starts[keep], ends[keep]
        last = np.append(blank[:-1] & ~blank[1:], False) & ~first[1:]  # last blank of a run, a word follows
        begin |= last
        begin[1:] |= (blank[1:] & ~blank[:-1]) | (last[:-1] & (data[:-1] != 32))
        starts = np.flatnonzero(begin)
        return starts, np.append(starts[1:], n)

    def _learn(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw = data.tobytes()
        flat, size = self._encode([raw[s:e].decode("utf-8", "replace") for s, e in zip(starts.tolist(), ends.tolist())])
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[:self.used], np.empty(len(self.ids) + len(flat), np.uint32)])
        self.ids[self.used:self.used + len(flat)] = flat
        at = self.used + np.cumsum(size) - size
        self.used += len(flat)
        place = np.searchsorted(self.keys, hashes)
        self.keys, self.at, self.size = np.insert(self.keys, place, hashes), np.insert(self.at, place, at), np.insert(self.size, place, size)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = column.to_pylist()
        odd = np.array([bool(t and _ODD.search(t)) for t in texts])
        plain = column if not odd.any() else pa.array([None if o else t for o, t in zip(odd, texts)], pa.large_string())
        data, offs = text_buffer(plain)
        flat, ends = self._by_units(data, offs)
        if odd.any():
            whole, size = self._encode([t for o, t in zip(odd, texts) if o])
            n = np.diff(ends)
            n[odd] = size
            out_ends = np.concatenate([[0], np.cumsum(n)])
            out, at = np.empty(out_ends[-1], np.uint32), np.concatenate([[0], np.cumsum(size)])
            out[np.repeat(~odd, n)] = flat
            for k, i in enumerate(np.flatnonzero(odd)):
                out[out_ends[i]:out_ends[i + 1]] = whole[at[k]:at[k + 1]]
            flat, ends = out, out_ends
        return flat, ends

    def _by_units(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(offs), np.int64)
        if not self.spaced:
            data = lower_ascii(data)
        starts, ends = self._cuts(data, offs)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(offs), np.int64)
        hashes = span_hashes(data, starts, ends)
        own, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > UNITS:
            self._reset()
        at = np.searchsorted(self.keys, own)
        known = np.zeros(len(own), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == own[inside]
        if not known.all():
            new = where[~known]
            self._learn(data, own[~known], starts[new], ends[new])
            at = np.searchsorted(self.keys, own)
        size = self.size[at][back]
        total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        take = np.repeat(self.at[at][back] - total[:-1], size) + np.arange(total[-1])
        return self.ids[take], total[np.searchsorted(starts, offs)]


_encoders: dict[tuple, UnitEncoder] = {}


def encoder(path: str, spaced: bool) -> UnitEncoder:
    """One per Python worker."""
    if (path, spaced) not in _encoders:
        _encoders[path, spaced] = UnitEncoder(path, spaced)
    return _encoders[path, spaced]
