"""Digests and occurrences of words of records, made for whole Arrow batches at once."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash

CACHE_WORDS = 1_000_000

_WORDS = re.compile(r"[^\W_]+|[\x00\x01]")
_MARKS = re.compile(r"[^\w\x00\x01]+|_+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


class _Hashes(dict):
    """Word to 64-bit hash; the separators of statements and records have 0 and 1."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self["\x00"], self["\x01"] = 0, 1
        code = self[word] = xxhash.xxh3_64_intdigest(word) | 2 if word not in "\x00\x01" else ord(word)
        return code


_hashes = _Hashes()


def statements(records: list[list[str | None] | None]) -> list[list[str]]:
    """Statements of each record in lower case; null, empty and blank ones left out, as are the two separators."""
    return [[s.lower().replace("\x00", " ").replace("\x01", " ") for s in r or () if s and not s.isspace()] for r in records]


class Batch:
    """For a batch of records: has (any statement), root (digest of the sorted plain forms), and per record the words."""

    def __init__(self, records: list[list[str | None] | None]):
        own = statements(records)
        self.has = np.array([bool(r) for r in own], bool)
        text = "\x01".join("\x00".join(r) for r in own)
        plain = _MARKS.sub("", text).split("\x01") if records else []
        self.root = [xxhash.xxh3_128_digest("\x00".join(sorted(p.split("\x00")))) for p in plain]
        tokens = _WORDS.findall(text)
        code = np.fromiter(map(_hashes.__getitem__, tokens), np.uint64, len(tokens))
        is_word = code > 1
        record = np.cumsum(code == 1)[is_word]
        word = code[is_word]
        n = len(word)
        self.words = np.bincount(record, minlength=len(records)) if n else np.zeros(len(records), np.int64)
        # words counted as often as they occur: the r-th occurrence of a word in a record is an element of its own
        order = np.lexsort((word, record))
        w, r = word[order], record[order]
        new = np.ones(n, bool)
        new[1:] = (w[1:] != w[:-1]) | (r[1:] != r[:-1])
        at = np.arange(n)
        nth = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
        element = mix(w + nth * _PRIME)
        order = np.lexsort((element, r))
        self.element, self.element_of = element[order], r[order]
        self.bag = np.zeros(len(records), np.uint64)
        if n:
            starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            self.bag[r[starts]] = mix(np.add.reduceat(mix(self.element ^ _PRIME), starts))


def lists(values: np.ndarray, of: np.ndarray, n: int) -> pa.Array:
    """values, which lie in order of their record `of`, as a list of signed integers for each of n records."""
    ends = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(of, minlength=n), out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(f"i{values.dtype.itemsize}")))
