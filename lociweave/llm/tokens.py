"""Tokens of whole texts, a batch at a time, with each distinct piece encoded once.

Where a tokenizer's rules let no token cross, a text can be cut, and its ids are those of its
pieces, one after another. Such places are: before a blank (``\\x20`` or ``\\n``) that follows
none, and between an ASCII letter, digit or mark and an ASCII character of another of these
kinds (an apostrophe is none of them, as it may begin a contraction).

A batch's pieces are runs of its UTF-8 bytes, cut and told apart by numpy without a step in
Python for each. Distinct ones are encoded by the tokenizers library and kept in a bounded
table of the worker, which changes the time, never the ids. A text with other white space, control characters, a special token's string or a letter whose
lower case depends on its neighbours is encoded whole, and so are all texts where the
tokenizer file declares other rules than ``_layout`` knows.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .words import LOWER, mix, ragged_arange

#: Pieces and ids that a worker keeps at most; then it begins anew.
KEPT_PIECES, KEPT_IDS = 1_000_000, 8_000_000
#: Bytes of texts whose pieces are looked up together. A longer text goes alone.
BATCH_BYTES = 4_000_000

#: White space, controls and joiners other than the two blanks, and the sigma.
_ODD = (
    r"[\t\x0b-\x1f\x7f-\xa0\xad\x{34f}\x{61c}\x{115f}\x{1160}\x{1680}\x{17b4}\x{17b5}\x{180b}-\x{180f}\x{2000}-\x{200f}\x{2028}-\x{202f}"
    r"\x{205f}-\x{206f}\x{3000}\x{feff}\x{3a3}]"
)

#: Kinds of bytes: 1 letters, 2 digits, 3 marks, 4 blanks, 0 what no cut touches.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[0x30:0x3A] = 2
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = 1
_KIND[0x27] = 0
_KIND[[0x20, 0x0A]] = 4

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

#: The split patterns after which a text may be cut as above, as tokenizer files write them.
_WORDS_OR_MARKS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _layout(spec: dict) -> str | None:
    """How the tokenizer of this file treats blanks: ``kept`` in front of words, ``dropped`` with case folded, or None: not known."""
    before, split = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
    if before is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space"):
        return "kept"
    steps = [(x["type"], x.get("pattern"), x.get("content")) for x in (before or {}).get("normalizers", [])]
    known = [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
    parts = split.get("pretokenizers", [])
    if steps == known and len(parts) == 2 and parts[0]["type"] == "Split" and parts[1]["type"] == "ByteLevel":
        first, second = parts
        if first["pattern"] == {"Regex": _WORDS_OR_MARKS} and first["invert"] and first["behavior"] == "Removed" and not second["use_regex"] and not second["add_prefix_space"]:
            return "dropped"
    return None


def piece_keys(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Of each piece its first 24 bytes as three numbers, and its length."""
    at, sizes = begins[:-1], np.diff(begins)
    padded = np.concatenate([data, np.zeros(32, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))  # the eight bytes from each place
    out = np.empty((len(at), 4), np.uint64)
    for k in range(3):
        out[:, k] = eight[np.minimum(at + 8 * k, len(data))] & _MASKS[np.clip(sizes - 8 * k, 0, 8)]
    out[:, 3] = sizes
    return out


class Encoder:
    """ids of texts as unsigned 32-bit numbers."""

    #: Numbers that are kept of each token.
    width = 1

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.layout = _layout(spec)
        special = [re.escape(t["content"]) for t in spec.get("added_tokens", [])]
        self.odd = "|".join([_ODD, *special]) if self.layout else None
        # the same vocabulary and merges for pieces that normalising and splitting leave as they are
        split = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        self.bare = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": split, "added_tokens": []})) if self.layout else None
        self.plain = re.compile(" ?[A-Za-z]+" if self.layout == "kept" else "[a-z]+").fullmatch
        self._forget()

    def _forget(self) -> None:
        self.named: dict[str, int] = {}
        self.hashes, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # of short pieces, sorted by hash
        # of all pieces, the empty one first
        self.keys = np.zeros((1, 4), np.uint64)
        self.starts = self.counts = self.chars = np.zeros(1, np.int64)
        self.flat = np.zeros((0, self.width), np.uint32)

    def _encode(self, tokenizer: Tokenizer, texts: list[str]) -> list[list]:
        """For each text its tokens' numbers, in one list."""
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of texts one after another, and how many each has."""
        found: list[list] = [[]] * len(texts)
        plain = [i for i, t in enumerate(texts) if self.plain(t)] if self.bare else []
        rest = sorted(set(range(len(texts))).difference(plain)) if len(plain) < len(texts) else []
        for tokenizer, chosen in ((self.bare, plain), (self.tokenizer, rest)):
            for i, x in zip(chosen, self._encode(tokenizer, [texts[i] for i in chosen]) if chosen else [], strict=True):
                found[i] = x
        counts = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum()))
        return flat.reshape(-1, self.width), counts // self.width

    def _add(self, texts: list[str], keys: np.ndarray) -> np.ndarray:
        """New places in the table for these pieces."""
        flat, counts = self._rows(texts)
        at = np.arange(len(self.starts), len(self.starts) + len(texts))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
        self.flat, self.counts, self.keys = np.concatenate([self.flat, flat]), np.concatenate([self.counts, counts]), np.concatenate([self.keys, keys])
        self.chars = np.concatenate([self.chars, np.fromiter(map(len, texts), np.int64, len(texts))])
        return at

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of pieces, where each begins (one more at the end), and for each text the index of its first one (one more at the end)."""
        kind = _KIND[data]
        starts = np.zeros(len(data) + 1, bool)
        starts[1:-1] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & ((kind[:-1] > 0) & (kind[:-1] < 4) | (kind[1:] == 4))
        starts[offsets] = True
        starts = starts[:-1]
        if self.layout == "dropped" and self.width == 1:  # blanks leave nothing; a word begins where one ends
            solid = kind < 4
            starts[1:] |= solid[1:] & ~solid[:-1]
            starts &= solid
            first = np.searchsorted(np.flatnonzero(starts), offsets)
            data, starts = LOWER[data[solid]], starts[solid]
            return data, np.append(np.flatnonzero(starts), len(data)), first
        begins = np.append(np.flatnonzero(starts), len(data))
        return data, begins, np.searchsorted(begins[:-1], offsets)

    def _look_up(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The table's place of each piece; the table takes up those that it lacks.

        Pieces of up to 24 bytes are told apart by their bytes as three numbers and their length, found by a hash of
        these; longer ones, and any whose hash another one has, by a dictionary.
        """
        if len(self.starts) > KEPT_PIECES or len(self.flat) > KEPT_IDS:
            self._forget()
        n, sizes = len(begins) - 1, np.diff(begins)
        keys = piece_keys(data, begins)
        hashes = mix(mix(mix(keys[:, 0] + keys[:, 3] * _STEP) + keys[:, 1]) + keys[:, 2])
        codes, distinct = pd.factorize(hashes)
        first = np.empty(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(n - 1, -1, -1)
        own = keys[first]
        same = (own[codes] == keys).all(axis=1)
        where = np.searchsorted(self.hashes, distinct)
        short = own[:, 3] <= 24
        known = np.zeros(len(distinct), bool)
        within = where < len(self.hashes)
        known[within] = self.hashes[where[within]] == distinct[within]
        places = np.full(len(distinct), -1, np.int64)
        places[known] = self.places[where[known]]
        places[known & (self.keys[places] != own).any(axis=1)] = -1
        new = np.flatnonzero(~known & short)
        text = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(begins.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        if len(new):
            places[new] = self._add(text.take(pa.array(first[new])).to_pylist(), own[new])
            order = np.argsort(distinct[new])
            self.hashes, self.places = (np.insert(x, where[new][order], y[new][order]) for x, y in ((self.hashes, distinct), (self.places, places)))
        places[~short] = -1
        out = places[codes]
        other = ~same | (out < 0)
        if len(other := np.flatnonzero(other)):
            names = text.take(pa.array(other)).to_pylist()
            if missing := list(dict.fromkeys(x for x in names if x not in self.named)):
                self.named.update(zip(missing, self._add(missing, np.full((len(missing), 4), 0xFF, np.uint64)).tolist(), strict=True))
            out[other] = [self.named[x] for x in names]
        return out

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of texts that may be cut, and how many each has."""
        data, begins, first = self._cut(data, offsets)
        at = self._look_up(data, begins)
        counts = self.counts[at]
        rows = self.flat[np.repeat(self.starts[at], counts) + ragged_arange(counts)]
        return rows, np.diff(np.concatenate([[0], np.cumsum(counts)])[first])

    def rows(self, texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of ``texts`` (null: empty), whose UTF-8 bytes are ``data`` from ``offsets``, and how many each has."""
        n = len(offsets) - 1
        odd = pc.match_substring_regex(texts, self.odd).fill_null(False).to_numpy(zero_copy_only=False) if self.odd else np.ones(n, bool)
        if not odd.any():
            return self._pieces(data, offsets)
        whole, n_whole = self._rows([t or "" for t in texts.filter(pa.array(odd)).to_pylist()])
        sizes = np.where(odd, 0, np.diff(offsets))
        cut, n_cut = self._pieces(data[np.repeat(~odd, np.diff(offsets))], np.concatenate([[0], np.cumsum(sizes)]))
        counts = n_cut.copy()
        counts[odd] = n_whole
        out, mine = np.empty((int(counts.sum()), self.width), cut.dtype), np.repeat(odd, counts)
        out[mine], out[~mine] = whole, cut
        return out, counts

    def ids(self, texts: pa.Array, data: np.ndarray, offsets: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after another, ``end_id`` after each, and where each text's begin (one more at the end)."""
        rows, counts = self.rows(texts, data, offsets)
        ids = rows[:, 0]
        if end_id is not None:
            counts = counts + 1
            out = np.full(int(counts.sum()), end_id, np.uint32)
            own = np.ones(len(out), bool)
            own[np.cumsum(counts) - 1] = False
            out[own] = ids
            ids = out
        return ids, np.concatenate([[0], np.cumsum(counts)])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    return Encoder(path)
