"""Runs of words that repeat with a period, found while the words of a text are appended.

A run with period q is a longest stretch of words in which words q apart are the same; it counts if q is its
smallest period and it holds at least max(`min_words`, 2 q) words. Words are appended in parts. Each completed
block of m = 2**k words, aligned to m, gets a catcher: it watches the appended words for another copy of its
block, 2 m - 1 to 4 m - 2 places on. Those distances tile all periods, and q words in a row always hold an
aligned block of their size class, so of every square at least one block's copy is caught. A copy q places on
opens two comparisons of words q apart, back from the block and onward from it, in steps that double; the
onward one of a stretch that reaches the last word goes on with the next part. A stretch of q equal pairs is a
square; squares of one stretch are one run, and a stretch with a smaller period that covers it takes its place.

Texts are appended one after another, parted by words that occur nowhere else, so catchers of all texts of a
batch work side by side; a text that is longer than `part` words is appended in parts. Work is done in the
tasks that read the texts; nothing is shuffled. Words are compared by 64-bit fingerprints.

Null and empty texts have no words and no runs; null and repeated ids are kept, a row each; an empty table gives
none; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, prefix_hash, span_hash, text_chunks, words

_LEFT = np.uint64(0xC2B2AE3D27D4EB4F)


class Catchers:
    """Catchers over the completed blocks of a growing sequence of words (fingerprints)."""

    def __init__(self, min_words: int = 12):
        self.min_words = min_words
        self.n = 0
        #: names[k][i] is the fingerprint of the 2**k words from i, made of those of its halves.
        self.names = [np.zeros(0, dtype=np.uint64)]
        #: start, end, period of stretches that hold a square, or end at the last word and may come to hold one.
        self.found = np.zeros((0, 3), dtype=np.int64)

    def append(self, more: np.ndarray, longest: int | None = None) -> None:
        """Append words. `longest`: no run is longer than this (texts are parted), so larger blocks need no catchers."""
        old, self.n = self.n, self.n + len(more)
        self._name(more)
        is_open = self.found[:, 1] == old
        grown = self.found[is_open]
        grown[:, 1] += self._reach(grown[:, 1] - grown[:, 2], grown[:, 1], self.n - grown[:, 1], 1)
        found = [self.found[~is_open], grown[self._kept(grown)]]
        k = 0
        while 3 * (m := 1 << k) - 1 <= self.n and (longest is None or 4 * m - 2 <= longest):
            block, period = self._copies(k, old)
            block, period = self._new(np.concatenate(found), block, period, m)
            start = block - self._reach(block, block + period, block, -1)
            end = block + period + m
            end += self._reach(block + m, end, self.n - end, 1)
            stretches = np.stack([start, end, period], axis=1)
            found.append(np.unique(stretches[self._kept(stretches)], axis=0))
            k += 1
        self.found = np.unique(np.concatenate(found), axis=0)

    def _name(self, more: np.ndarray) -> None:
        self.names[0] = np.concatenate([self.names[0], more])
        k = 0
        while (m := 1 << k) * 2 <= self.n:
            if k + 1 == len(self.names):
                self.names.append(np.zeros(0, dtype=np.uint64))
            half, done = self.names[k], len(self.names[k + 1])
            new = mix(half[done : len(half) - m] * _LEFT + half[done + m :])
            self.names[k + 1] = np.concatenate([self.names[k + 1], new])
            k += 1

    def _kept(self, found: np.ndarray) -> np.ndarray:
        return (found[:, 1] - found[:, 0] >= 2 * found[:, 2]) | (found[:, 1] == self.n)

    def _copies(self, k: int, old: int):
        """(block, distance) of all copies of completed blocks of 2**k words that the words appended since `old` complete."""
        m = 1 << k
        first = max(0, (old - 5 * m) // m * m)
        names = self.names[k][first:]
        blocks = np.arange(0, len(names), m)
        padded = np.concatenate([names, np.zeros(4 * m, dtype=np.uint64)])
        near = np.lib.stride_tricks.sliding_window_view(padded[2 * m - 1 :], 2 * m)[blocks]
        same = near == names[blocks][:, None]
        same[1:] &= ~same[:-1]  # next to a block that is copied at the same distance, the stretch is the same
        row, place = np.divmod(np.flatnonzero(same), 2 * m)
        block, period = first + row * m, place + 2 * m - 1
        new = (block + period + m > old) & (block + period + m <= self.n)
        return block[new], period[new]

    def _new(self, found: np.ndarray, block: np.ndarray, period: np.ndarray, m: int):
        """Without copies that lie in a stretch whose period divides their distance: they give that stretch again."""
        if not len(found) or not len(block):
            return block, period
        found = found[np.lexsort((-found[:, 1], found[:, 0]))]
        reach = np.maximum.accumulate(found[:, 1])
        best = np.searchsorted(reach, reach)  # of each, the first one that reaches as far as any up to it
        at = np.searchsorted(found[:, 0], block, side="right") - 1
        held = found[best[np.maximum(at, 0)]]
        known = (at >= 0) & (held[:, 1] >= block + period + m) & (period % held[:, 2] == 0)
        return block[~known], period[~known]

    def _reach(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
        """Number of equal words from a and from b on (way 1) or right before both (way -1): steps that double while
        the words agree, then halve."""
        done = np.zeros(len(a), dtype=np.int64)

        def step(which: np.ndarray, k: int) -> np.ndarray:
            which = which[done[which] + (1 << k) <= most[which]]
            at = way * done[which] - (1 << k if way < 0 else 0)
            which = which[self.names[k][a[which] + at] == self.names[k][b[which] + at]]
            done[which] += 1 << k
            return which

        k, live = 0, step(np.arange(len(a)), 0)
        while len(live):
            k += 1
            live = step(live, k) if k < len(self.names) else live[:0]
        for k in range(k - 1, -1, -1):
            step(np.arange(len(a)), k)
        return done

    def runs(self) -> np.ndarray:
        """(start, end, period) of all runs, by start, then period."""
        found = self.found[self.found[:, 1] - self.found[:, 0] >= 2 * self.found[:, 2]]
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        first = np.ones(len(found), dtype=bool)
        first[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)  # of the same stretch, the smallest period
        found = found[first]
        found = found[found[:, 1] - found[:, 0] >= np.maximum(self.min_words, 2 * found[:, 2])]
        return found[np.lexsort((found[:, 2], found[:, 0]))]


def runs_of_texts(names: np.ndarray, counts: np.ndarray, min_words: int, part: int = 1 << 20) -> np.ndarray:
    """Runs of several texts, as places in `names`, the fingerprints of all their words."""
    n = len(counts)
    seps = np.cumsum(counts)  # a word that occurs nowhere else ends each text
    alone = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    stream = np.insert(names, seps, alone)
    catchers = Catchers(min_words)
    longest = int(counts.max(initial=0))
    for at in range(0, len(stream), part):
        catchers.append(stream[at : at + part], longest)
    out = catchers.runs()
    before = np.searchsorted(seps + np.arange(n), out[:, 0])  # separators before a run
    out[:, :2] -= before[:, None]
    return out


def _finder(min_words: int):
    def find(batches):
        for batch in batches:
            names, texts = batch.columns
            for first, offsets, data in text_chunks(texts.to_pylist()):
                n = len(offsets) - 1
                start, end, owner = words(offsets, data)
                counts = np.bincount(owner, minlength=n)
                base = np.concatenate([[0], np.cumsum(counts)])
                runs = runs_of_texts(span_hash(prefix_hash(data), start, end), counts, min_words)
                doc = np.searchsorted(base, runs[:, 0], side="right") - 1
                gone = np.zeros(len(start) + 1, dtype=np.int64)
                np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
                np.add.at(gone, runs[:, 1], -1)
                kept, held = _joined(offsets, data, start, end, owner, np.cumsum(gone)[:-1] == 0)
                values = [runs[:, 0] - base[doc], runs[:, 1] - runs[:, 0], runs[:, 2]]
                structs = pa.StructArray.from_arrays([pa.array(v) for v in values], ["start", "length", "period"])
                cuts = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [names.slice(first, n), pa.array(counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(cuts), structs), _strings(kept, held)],
                    ["id", "n_words", "runs", "collapsed"],
                )

    return find


def _joined(offsets, data, start, end, owner, kept):
    """Bytes of the kept words of each text, joined by one space, and where each text's begin."""
    out = data.copy()
    mark = np.zeros(len(data) + 1, dtype=np.int64)
    np.add.at(mark, start[kept], 1)
    np.add.at(mark, end[kept], -1)
    take = np.cumsum(mark)[:-1] > 0
    whose = owner[kept]
    more = np.flatnonzero(whose[1:] == whose[:-1])  # kept words with another one after them: so is a space
    gaps = end[kept][more]
    out[gaps] = 32
    take[gaps] = True
    sizes = np.concatenate([[0], np.cumsum(take)])
    return out[take], sizes[offsets]


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))


def find_runs(df: DataFrame, min_words: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: `id`, `n_words`, `runs` (start, length, period in words; by start, then period) and `collapsed`:
    its words without those that a run holds after its first period, joined by one space."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(_finder(min_words), f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
