"""Exact byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece of text there is exactly one token that ends its encoding. A token t that matches the
end of a prefix is that token if and only if t starts the text or is compatible with the last token of the prefix
before it, where two tokens are compatible if BPE keeps them apart when their bytes stand side by side. One scan with
a suffix-link automaton over the vocabulary gives all matches that end at each place; the last tokens are stored, and
following them back from the end emits the ids. The work is linear in the text, whatever its shape.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import ahocorasick
import regex

TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
TOKENIZER_FILE = "byte_bpe_50k.json"

#: Words kept per Python worker; when full the table is emptied, so memory is bounded and no word is treated differently.
CACHE_WORDS = 400_000
CACHE_WORD_CHARS = 48

#: The pre-splitting pattern of the tokenizer, for pure ASCII and for any text.
ASCII_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
ANY_SPLIT = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable ones stand for themselves, the others follow from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, following = [], 256
    for b in range(256):
        if b in shown:
            out.append(chr(b))
        else:
            out.append(chr(following))
            following += 1
    return out


class PrefixEncoder:
    """Encodes text; holds the vocabulary, its automaton and a bounded table of words met so far."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        ids: dict[str, int] = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.letters = {b: x for b, x in enumerate(byte_letters())}
        #: merged[(left, right)] is the rank of that merge; parts[id] its two halves and rank, None for single bytes.
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            self.merged[ids[a], ids[b]] = rank
            self.parts.setdefault(ids[a + b], (ids[a], ids[b], rank))
        self.automaton = ahocorasick.Automaton()
        for token, i in ids.items():
            self.automaton.add_word(token, (i, len(token)))
        self.automaton.make_automaton()
        self._apart: dict[tuple[int, int], bool] = {}
        self.words = _Words(self)

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves tokens a and b as they are when b follows a.

        Undo the merges on both sides of the border from the latest to the earliest. At each step the two tokens
        that touch the border could have been merged across it; that would have happened if this merge ranks before
        both merges that are undone next to it.
        """
        known = self._apart.get((a, b))
        if known is not None:
            return known
        key, apart = (a, b), True
        before_a = before_b = len(self.merged) + 1  # ranks of the merges that took the border tokens away
        while True:
            across = self.merged.get((a, b))
            # Of equal merges that overlap, BPE makes the left one first.
            if across is not None and across < before_a and across <= before_b:
                apart = False
                break
            pa, pb = self.parts.get(a), self.parts.get(b)
            if pa is None and pb is None:
                break
            if pb is None or (pa is not None and pa[2] > pb[2]):
                before_a, a = pa[2], pa[1]
            else:
                before_b, b = pb[2], pb[0]
        if len(self._apart) > 2_000_000:
            self._apart.clear()
        self._apart[key] = apart
        return apart

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-split piece of any length."""
        text = "".join(map(self.letters.__getitem__, word.encode("utf-8")))
        size = len(text)
        last, back = array("i", [-1]) * (size + 1), array("i", [0]) * (size + 1)
        compatible = self.compatible
        for end, (token, length) in self.automaton.iter(text):
            at, start = end + 1, end + 1 - length
            if last[at] < 0 and (start == 0 or compatible(last[start], token)):
                last[at], back[at] = token, start
        out = []
        while size:
            out.append(last[size])
            size = back[size]
        out.reverse()
        return out

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids of a text as little-endian 32-bit integers; empty for null and empty texts."""
        if not text:
            return b""
        split = ASCII_SPLIT if text.isascii() else ANY_SPLIT
        return b"".join(map(self.words.__getitem__, split.findall(text)))


class _Words(dict):
    """Word to encoded bytes, filled on demand."""

    def __init__(self, encoder: PrefixEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        code = array("i", self.encoder.encode_word(word)).tobytes()
        if len(word) <= CACHE_WORD_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = code
        return code


_encoders: dict[str, PrefixEncoder] = {}


def encoder(path: str | None = None) -> PrefixEncoder:
    """The encoder of this Python worker; built once a process."""
    path = path or os.path.join(TOKENIZER_DIR, TOKENIZER_FILE)
    if path not in _encoders:
        _encoders[path] = PrefixEncoder(path)
    return _encoders[path]
