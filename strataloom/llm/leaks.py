"""Evaluation texts inside training texts.

A document leaks an item when it holds ``words`` consecutive words of the item,
or all of its words in a row if it has fewer, up to ``max_edits`` word edits
(replaced, left out or put in).  Words are longest runs of letters and digits,
without case.  Of an item of few words at most a quarter may be edited.

Windows of words are embedded by a CGK random walk: a random bit, hashed from
the step and the word read, says whether the walk over the window moves on, and
the word read at each step is the output.  Windows at a small edit distance get
outputs at a small Hamming distance, equal windows equal ones.  Bit sampling
over the outputs gives LSH keys; a document window that meets an item window
under a key is verified by exact edit distance.  Document windows have all
sizes from ``words - max_edits`` to ``words + max_edits``.  With ``max_edits=0``
one repetition finds everything; with more, ``repetitions`` sets the recall.

A window with more than ``max_edits`` words, or more than twice as many pairs of
neighbours, that no item holds can't match, so such windows are skipped before
they are embedded.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._texts import per_row

_WORD = re.compile(r"[^\W_]+")
#: Words of items that one pass over the documents holds; more items take more passes.
BLOCK_WORDS = 1_000_000
#: Repetitions and sampled outputs where edits are allowed.
EDIT_REPETITIONS, EDIT_SAMPLED = 12, 5
#: Document windows that are embedded at once, and characters of texts that are looked through together.
_AT_ONCE, _TOGETHER = 65_536, 1_000_000


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def edits_of(size: int, max_edits: int) -> int:
    """The edits that a window of an item may have: a quarter of its words at most."""
    return min(max_edits, size // 4)


class Embedding:
    """CGK walks and sampled outputs for windows about one size.

    Bits are hashed from (step, word), so nothing is held for a word but one
    random number.
    """

    def __init__(self, size: int, edits: int, word_hashes: np.ndarray, repetitions: int, sampled: int, seed: int):
        rnd = np.random.default_rng([seed, size])
        self.steps = 3 * (size + edits)
        self.hashes, self.end = word_hashes, len(word_hashes) - 1
        # windows that agree at the end of their walks say little, so outputs are sampled where walks still read words
        self.places = [np.sort(rnd.choice(2 * size, min(sampled, 2 * size), replace=False)) for _ in range(repetitions)]
        odd = lambda: rnd.integers(0, 2**63, (repetitions, self.steps), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.turn, self.mix = odd(), odd()

    def keys(self, windows: np.ndarray) -> np.ndarray:
        """LSH keys (repetitions x windows) of rows of word numbers."""
        n, size = windows.shape
        out = np.zeros((len(self.places), n), dtype=np.uint64)
        padded = np.hstack([windows, np.full((n, 1), self.end, dtype=windows.dtype)]).ravel()
        first = np.arange(n, dtype=np.int64) * (size + 1)
        top = np.uint64(63)
        for r, places in enumerate(self.places):
            at = np.zeros(n, dtype=np.int64)
            wanted = set(places.tolist())
            for j in range(int(places[-1]) + 1):
                read = self.hashes[padded[first + at]]
                if j in wanted:
                    out[r] += read * self.mix[r, j]
                    out[r] ^= out[r] >> np.uint64(29)
                at += ((read * self.turn[r, j]) >> top).astype(np.int64)
                np.minimum(at, size, out=at)
        return out


def within(a: list[int], b: list[int], most: int) -> bool:
    """Whether the edit distance of two short sequences is at most *most*."""
    return bool(all_within(np.array([a], dtype=np.int64).reshape(1, -1), np.array([b], dtype=np.int64).reshape(1, -1), most)[0])


def all_within(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Row by row, whether the edit distance of two arrays of sequences is at most *most*; only the band about the diagonal is filled."""
    n, wide, high = len(a), a.shape[1], b.shape[1]
    if abs(wide - high) > most:
        return np.zeros(n, dtype=bool)
    if most == 0:
        return (a == b).all(axis=1)
    far = np.full(n, most + 1, dtype=np.int64)
    row = [np.full(n, j, dtype=np.int64) if j <= most else far for j in range(high + 1)]
    for i in range(1, wide + 1):
        fresh = [np.full(n, i, dtype=np.int64) if i <= most else far]
        for j in range(1, high + 1):
            if abs(i - j) > most:
                fresh.append(far)
            else:
                fresh.append(np.minimum(np.minimum(row[j], fresh[j - 1]) + 1, row[j - 1] + (a[:, i - 1] != b[:, j - 1])))
        row = fresh
    return row[high] <= most


class ItemIndex:
    """LSH tables of the windows of a bounded block of items.

    Each different window is held once, with the items that have it, so text
    shared by many items is verified once.
    """

    def __init__(self, items: list[tuple[object, str]], words: int, max_edits: int, repetitions: int, sampled: int, seed: int):
        self.number: dict[str, int] = {}
        listed = [(key, [self.number.setdefault(w, len(self.number)) for w in words_of(text or "")]) for key, text in items]
        self.unknown = len(self.number)  # any word of no item; the number after it stands for the end of a window
        hashes = np.random.default_rng(seed).integers(0, 2**63, self.unknown + 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        pairs = [np.array(ids[:-1], dtype=np.int64) * (self.unknown + 1) + np.array(ids[1:], dtype=np.int64) for _, ids in listed if len(ids) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, dtype=np.int64)
        holders: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
        for key, ids in listed:
            size = min(words, len(ids))
            for i in range(len(ids) - size + 1 if ids else 0):
                holders[size][tuple(ids[i : i + size])].add(key)
        self.tables = []
        for size, held in sorted(holders.items()):
            edits = edits_of(size, max_edits)
            embedding = Embedding(size, edits, hashes, repetitions if edits else 1, min(sampled, max(2, size // 2 - 1)) if edits else sampled, seed)
            windows = list(held)
            keys = embedding.keys(np.array(windows, dtype=np.int64))
            # per repetition: sorted keys and the windows under them
            order = np.argsort(keys, axis=1, kind="stable")
            self.tables.append((size, edits, embedding, np.array(windows, dtype=np.int64), list(held.values()), np.take_along_axis(keys, order, axis=1), order))

    def found(self, text: str) -> Iterator[object]:
        """Keys of the items that the text holds."""
        return (item for _, item in self.found_in([(None, text)]))

    def found_in(self, texts: list[tuple[object, str]]) -> Iterator[tuple[object, object]]:
        """(key of a text, key of an item that it holds) of several texts, which are looked through as one row of words."""
        get, unknown = self.number.get, self.unknown
        words: list[int] = []
        begins = []
        for _, text in texts:
            words.append(-1)  # no window goes over it
            begins.append(len(words))
            words += [get(w, unknown) for w in words_of(text)]
        ids = np.array(words, dtype=np.int64)
        most = max((e for _, e, *_ in self.tables), default=0)
        strange = np.concatenate([[0], np.cumsum(np.where(ids < 0, most + 1, ids == unknown))])
        pairs = ids[:-1] * (unknown + 1) + ids[1:]
        place = np.minimum(np.searchsorted(self.pairs, pairs), max(0, len(self.pairs) - 1))
        odd = np.concatenate([[0], np.cumsum(self.pairs[place] != pairs if len(self.pairs) else np.ones(len(pairs), dtype=bool))])
        done: set = set()
        for size, edits, embedding, windows, holders, keys, order in self.tables:
            for length in range(size - edits, size + edits + 1):
                if len(ids) < length:
                    continue
                starts = np.flatnonzero((strange[length:] - strange[:-length] <= edits) & (odd[length - 1 :] - odd[: len(odd) - length + 1] <= 2 * edits))
                for i in range(0, len(starts), _AT_ONCE):
                    some = starts[i : i + _AT_ONCE]
                    # repeated windows are looked at once
                    here, which = np.unique(ids[some[:, None] + np.arange(length)], axis=0, return_inverse=True)
                    near = self._near(here, windows, embedding.keys(here), keys, order, edits)
                    if not len(near):
                        continue
                    by_window: dict[int, list[int]] = defaultdict(list)
                    for m, w in near.tolist():
                        by_window[m].append(w)
                    texts_at = np.searchsorted(begins, some, "right") - 1
                    seen = set()
                    for m, t in zip(which.ravel().tolist(), texts_at.tolist(), strict=True):
                        if m in by_window and (m, t) not in seen:
                            seen.add((m, t))
                            for w in by_window[m]:
                                for item in holders[w]:
                                    if (t, item) not in done:
                                        done.add((t, item))
                                        yield texts[t][0], item

    @staticmethod
    def _near(here: np.ndarray, windows: np.ndarray, rows: np.ndarray, keys: np.ndarray, order: np.ndarray, edits: int) -> np.ndarray:
        """(document window, item window) pairs that meet under a key of some repetition and are close."""
        met: list[np.ndarray] = []
        close: list[np.ndarray] = []
        size = 0

        def verify() -> None:
            codes = np.unique(np.concatenate(met))
            for k in range(0, len(codes), _AT_ONCE):
                mine, theirs = np.divmod(codes[k : k + _AT_ONCE], len(windows))
                good = all_within(here[mine], windows[theirs], edits)
                close.append(np.stack([mine[good], theirs[good]], axis=1))

        for r, row in enumerate(rows):
            low, high = np.searchsorted(keys[r], row, "left"), np.searchsorted(keys[r], row, "right")
            counts = high - low
            ends = np.cumsum(counts)
            at = 0
            while at < len(here):
                # so many document windows that their partners fit a batch
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 16 * _AT_ONCE, "right")))
                n = counts[at:upto]
                total = int(n.sum())
                if total:
                    mine = np.repeat(np.arange(at, upto), n)
                    theirs = order[r][np.repeat(low[at:upto], n) + np.arange(total) - np.repeat(np.cumsum(n) - n, n)]
                    met.append(mine * len(windows) + theirs)
                    size += total
                    if size > 16 * _AT_ONCE:
                        verify()
                        met.clear()
                        size = 0
                at = upto
        if met:
            verify()
        return np.unique(np.concatenate(close), axis=0) if close else np.zeros((0, 2), dtype=np.int64)


@functools.lru_cache(maxsize=2)
def _index(block: _Block) -> ItemIndex:
    return ItemIndex(block.items, *block.how)


class _Block:
    """A block of items, equal to any other with the same digest, so that a Python worker builds its index once."""

    def __init__(self, items: list[tuple[object, str]], how: tuple):
        self.items, self.how = items, how
        self.digest = hashlib.sha256(repr((items, how)).encode("utf-8", "surrogatepass")).hexdigest()

    def __hash__(self) -> int:
        return hash(self.digest)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Block) and self.digest == other.digest


def leaked(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str | Column = "doc_id",
    text: str | Column = "text",
    item_id: str | Column = "item_id",
    item_text: str | Column = "text",
    words: int = 12,
    max_edits: int = 0,
    repetitions: int | None = None,
    sampled: int | None = None,
    seed: int = 7,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(doc_id, item_id), one row for each document and item that it leaks.

    The items are taken in blocks of about *block_words* words (a block is one
    pass over the documents and the only thing held on the driver); the
    documents stream through without a shuffle.  Items without words and null
    texts match nothing; an item entered under two ids gives both; other
    columns are ignored.
    """
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    how = (words, max_edits, repetitions or (EDIT_REPETITIONS if max_edits else 1), sampled or (EDIT_SAMPLED if max_edits else 8), seed)
    texts = items.select(as_col(item_id).alias("item_id"), as_col(item_text).alias("text")).where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (block_words * 6)))
    docs = documents.select(as_col(doc_id).alias("doc_id"), as_col(text).alias("text")).where(F.col("text").isNotNull())
    types = (docs.schema["doc_id"].dataType.simpleString(), texts.schema["item_id"].dataType.simpleString())
    out = None
    for b in range(blocks):
        part = texts if blocks == 1 else texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        held = _Block([(r.item_id, r.text) for r in part.orderBy("item_id", "text").collect()], how)

        def setup(held=held) -> dict:
            return {"index": _index(held)}

        def pairs(rows, index: ItemIndex):
            return index.found_in(rows)

        one = per_row(docs, pairs, f"doc_id {types[0]}, item_id {types[1]}", setup, _TOGETHER)
        out = one if out is None else out.unionByName(one)
    return out.distinct()
