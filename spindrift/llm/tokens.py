"""Token ids of whole texts, as a public tokenizer file gives them.

`WordBpe` gives the very ids of `tokenizers.Tokenizer.encode(text,
add_special_tokens=False)` for the lower-casing word tokenizer, in which no token
crosses white space. Chunks between white space are remembered, and all new words
of a batch are merged together, one merge of every word at a time, in numpy. Texts
with characters outside Latin-1, or with what could be a special token, go to
the library whole.
"""

from __future__ import annotations

import gc
import json
import re
from collections import defaultdict
from pathlib import Path

import numpy as np

_OTHER_SPACE = re.compile("[\x1c-\x1f]")
_LETTERS = "a-zªµºß-öø-ÿ"
_NUMBERS = "0-9²³¹¼½¾"
_SPACE = "\t-\r \x85\xa0"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACE}{_LETTERS}{_NUMBERS}]+")
LONGEST_MERGED = 64  # bytes; longer words go to the library
REMEMBERED = 600_000  # chunks kept by a worker; beyond that, those of the batch at hand
NO_RANK = np.int32(1 << 30)


class PairTable:
    """Open-addressing table from a pair of symbol ids to the rank of its merge and the merged id."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(8, int(len(left)).bit_length() + 3)
        n = 1 << self.bits
        self.keys = np.full(n, -1, np.int64)
        self.rank = np.full(n, NO_RANK, np.int32)
        self.merged = np.zeros(n, np.int32)
        keys = left.astype(np.int64) << 32 | right
        at, left_over, self.steps = self.slot(keys), np.arange(len(keys)), 0
        while len(left_over):
            slots = (at[left_over] + self.steps) & (n - 1)
            free = self.keys[slots] == -1
            _, first = np.unique(slots, return_index=True)
            put = np.zeros(len(slots), bool)
            put[first] = True
            put &= free
            who = left_over[put]
            self.keys[slots[put]], self.rank[slots[put]], self.merged[slots[put]] = keys[who], who, merged[who]
            left_over = left_over[~put]
            self.steps += 1

    def slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = self.slot(keys)
        rank, merged = np.full(keys.shape, NO_RANK, np.int32), np.zeros(keys.shape, np.int32)
        for k in range(self.steps):
            slots = (at + k) & ((1 << self.bits) - 1)
            hit = self.keys[slots] == keys
            rank[hit], merged[hit] = self.rank[slots[hit]], self.merged[slots[hit]]
        return rank, merged


class WordBpe:
    """Encoder for one tokenizer file; `batch` is the way in."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._lib = Tokenizer.from_file(path)
        self._chunks: dict[str, bytes] = {}
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self._table = PairTable(*(np.asarray([vocab[f(p)] for p in pairs], np.int64) for f in (lambda p: p[0], lambda p: p[1], "".join)))
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        hidden = [b for b in range(256) if b not in set(shown)]
        letter = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self._inner = np.asarray([vocab[letter[b]] for b in range(256)], np.int32)
        self._last = np.asarray([vocab[letter[b] + end] for b in range(256)], np.int32)

    def _asked(self, text: str) -> bytes:
        return np.asarray(self._lib.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _merge_all(self, words: list[bytes]) -> list[bytes]:
        """Byte-pair merges of words of one length, lowest rank first, leftmost first."""
        n, width = len(words), len(words[0])
        raw = np.frombuffer(b"".join(words), np.uint8).reshape(n, width)
        ids = self._inner[raw]
        ids[:, -1] = self._last[raw[:, -1]]
        if width == 1:
            return [x.tobytes() for x in ids.astype("<u4")]
        size = np.full(n, width)
        rank, into = self._table.find(ids[:, :-1], ids[:, 1:])
        done_ids, live = np.zeros((n, width), "<u4"), np.arange(n)
        while True:
            at = rank.argmin(axis=1)
            row = np.arange(len(at))
            more = rank[row, at] < NO_RANK
            if not more.all():
                done_ids[live[~more], : ids.shape[1]] = ids[~more]
                live, ids, rank, into, at = live[more], ids[more], rank[more], into[more], at[more]
                row = np.arange(len(at))
            if not len(live):
                break
            ids[row, at] = into[row, at]
            size[live] -= 1
            if ids.shape[1] == 2:
                done_ids[live, :1] = ids[:, :1]
                break
            # drop the column after each merge
            keep = np.arange(ids.shape[1])[None, :] != (at + 1)[:, None]
            ids = ids[keep].reshape(len(live), -1)
            # of the pairs, the one that merged goes
            keep = np.arange(rank.shape[1])[None, :] != at[:, None]
            rank, into = rank[keep].reshape(len(live), -1), into[keep].reshape(len(live), -1)
            # every row's number of symbols is the same, so rows need no padding
            for where, ok in ((at - 1, at > 0), (at, at < rank.shape[1])):
                r, w = row[ok], where[ok]
                rank[r, w], into[r, w] = self._table.find(ids[r, w], ids[r, w + 1])
        flat, ends = done_ids.tobytes(), size * 4
        step = width * 4
        return [flat[k * step : k * step + e] for k, e in enumerate(ends.tolist())]

    def _learn(self, chunks: set[str]) -> None:
        known = self._chunks
        mixed = [(c, _PIECE.findall(c)) for c in chunks if not c.isalpha()]  # letters alone are one word
        words = {c for c in chunks if c.isalpha()}
        for _, pieces in mixed:
            words.update(pieces)
        by_size: defaultdict[int, list[tuple[str, bytes]]] = defaultdict(list)
        for w in words.difference(known):
            raw = w.encode()
            by_size[len(raw)].append((w, raw))
        for width, group in by_size.items():
            names = [w for w, _ in group]
            known.update(zip(names, self._merge_all([raw for _, raw in group]) if width <= LONGEST_MERGED else map(self._asked, names)))
        for c, pieces in mixed:
            known[c] = b"".join([known[p] for p in pieces])

    def batch(self, texts: list[str]) -> list[bytes]:
        """All ids of each text, as little-endian uint32 bytes."""
        collecting = gc.isenabled()
        gc.disable()  # many small objects and no cycles: the collector would only walk them again and again
        try:
            return self._batch(texts)
        finally:
            if collecting:
                gc.enable()

    def _batch(self, texts: list[str]) -> list[bytes]:
        split: list[list[str] | bytes] = []
        new: set[str] = set()
        for text in texts:
            try:
                text.encode("latin-1")
                plain = "<|" not in text and not _OTHER_SPACE.search(text)
            except UnicodeEncodeError:
                plain = False
            chunks = text.lower().split() if plain else self._asked(text)
            if plain:
                new.update(chunks)
            split.append(chunks)
        if len(self._chunks) > REMEMBERED:  # before looking, so that nothing this batch needs is dropped
            self._chunks = {c: self._chunks[c] for c in new.intersection(self._chunks)}
        fresh = new.difference(self._chunks)
        if fresh:
            self._learn(fresh)
        get = self._chunks.__getitem__
        return [x if isinstance(x, bytes) else b"".join(map(get, x)) for x in split]


_loaded: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """The encoder for a file, loaded once in each Python worker."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def public_path(name: str) -> str:
    """Where a file of the public tokenizers lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
