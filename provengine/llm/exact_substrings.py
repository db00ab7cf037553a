"""Exact substring dedup by prefix-free parsing: every byte covered by a string of `length` bytes that also
starts anywhere else.

Triggers cut a text into phrases: the trigger of a string is where the rolling hash of `gram` bytes is
least among its first `span` places (the leftmost on ties). So each string of `length` bytes has one
trigger, found from its own bytes alone, and equal strings have it at the same place inside. A string is
a suffix of the phrase before its trigger, and then what the parse holds from the trigger on; its place in the
corpus order is that of (parse from the trigger, suffix of the phrase). Only the order to depth `length`
matters, and in it only which neighbours are equal, so names (64-bit fingerprints) of phrases, of suffixes of
phrases and of the parse to some depth stand for ranks in the dictionary's and the parse's suffix arrays:

1. The parse's suffixes are sorted over the cluster by the name of what every string of a trigger reaches
   (`length - span + 1` bytes from the trigger on), then by the name of phrase and parse together (all bytes of
   all its strings). Neighbours in that order are read once: where the first name stands alone, no string of the
   trigger repeats; where both names are a neighbour's, all its strings do.
2. What is left are triggers at the edges of repeats, and one of each kind of full repeat beside them: their
   strings are put in the corpus order one by one, by the name of suffix and parse together at depth `length`.

The first order has one row a phrase, not a byte. Rows are placed by ranges of (names, row), so a repeat of any
number of copies is dealt out; a run of names that a range's border cuts is taken for an edge, which step 2
decides exactly. In step 2 strings that repeat inside a batch are decided there and sent on once a batch.
The texts are dealt by key once for both uses.

`passage` asks the same of strings of that many words, a word standing where a byte does: such passages are counted,
and nothing is removed for them: nine of ten strings of 51 words have less than 400 bytes. Both kinds of triggers go through the
two steps together. Words are runs of anything but ASCII white space, told apart by fingerprints; the blanks between them don't count.

Null texts are empty; texts below `length` bytes lose nothing; null or repeated ids are rows of their own
(rows alike in id and text repeat each other); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dealt, mix, prefix_hash, row_key, span_hash, stash, text_chunks, words

PLACE_BITS = np.uint64(28)
MOST_BYTES = 1 << 27  # that triggers are sought in at once


def triggers(offsets: np.ndarray, data: np.ndarray, length: int, span: int, gram: int, prefix: np.ndarray | None = None):
    """(text, first start, last start, trigger) of every trigger; places count from the beginning of `data`."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none, none
    if len(data) > MOST_BYTES:  # one text, by strings that start in each stretch
        parts = []
        for a in range(0, len(data) - length + 1, MOST_BYTES - length):
            piece = data[a : a + MOST_BYTES - 1]
            parts.append([x + (a if k else 0) for k, x in enumerate(triggers(np.array([0, len(piece)]), piece, length, span, gram))])
        return tuple(map(np.concatenate, zip(*parts)))
    prefix = prefix_hash(data) if prefix is None else prefix
    at = np.arange(len(data) - gram + 1)
    keys = (span_hash(prefix, at, at + gram) >> PLACE_BITS << PLACE_BITS) | at.astype(np.uint64)
    reach = 1
    least = keys
    while reach < span:  # least[i] covers keys[i : i + reach]
        step = min(reach, span - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    lengths = np.diff(offsets)
    starts = np.maximum(lengths - length + 1, 0)  # strings that start in each text
    text = np.repeat(np.arange(len(lengths)), starts)
    place = np.arange(len(text)) - np.repeat(np.cumsum(starts) - starts, starts) + offsets[text]
    trigger = (least[place] & np.uint64((1 << 28) - 1)).astype(np.int64)
    if not len(place):
        return none, none, none, none
    new = np.flatnonzero(np.concatenate([[True], (trigger[1:] != trigger[:-1]) | (text[1:] != text[:-1])]))
    last = np.concatenate([new[1:], [len(place)]]) - 1
    return text[new], place[new], place[last], trigger[new]


def _binary(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("row_key"), text.cast("binary").alias("raw"))


def _word_names(offsets: np.ndarray, data: np.ndarray, prefix: np.ndarray):
    """Offsets of the texts in words, and fingerprints of the words."""
    start, end, owner = words(offsets, data)
    return np.searchsorted(owner, np.arange(len(offsets))), span_hash(prefix, start, end)


def _anchors(docs: DataFrame, length: int, span: int, gram: int, passage: int) -> DataFrame:
    """row_key, of_words, lo, hi (first and last start), parse and whole (fingerprints of rounds 1 and 2)."""

    def found(keys, of_words, offsets, data, prefix, length, span, gram):
        text, lo, hi, trigger = triggers(offsets, data, length, span, gram, prefix)
        if len(text):
            parse = span_hash(prefix, trigger, trigger + length - span + 1)
            whole = mix(span_hash(prefix, lo, hi + length) ^ ((trigger - lo) << 32 | (trigger - hi)).astype(np.uint64))
            base = offsets[text]
            yield pa.record_batch(
                [pa.array(keys[text]), pa.array(np.full(len(text), of_words)), pa.array((lo - base).astype(np.int32)), pa.array((hi - base).astype(np.int32)), pa.array(parse.view(np.int64)), pa.array(whole.view(np.int64))],
                names=["row_key", "of_words", "lo", "hi", "parse", "whole"],
            )

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for first, offsets, data in text_chunks(batch.column(1).to_pylist()):
                prefix = prefix_hash(data)
                yield from found(keys[first:], False, offsets, data, prefix, length, span, gram)
                if passage:
                    offsets, names = _word_names(offsets, data, prefix)
                    yield from found(keys[first:], True, offsets, names, prefix_hash(names), passage, passage * 3 // 4, max(1, passage // 12))

    return docs.select("row_key", "raw").mapInArrow(run, "row_key long, of_words boolean, lo int, hi int, parse long, whole long")


def _neighbours(anchors: DataFrame, most: int = 200_000) -> DataFrame:
    """row_key, of_words, lo, hi, full, edge of the sorted triggers that step 1 doesn't drop, each from its neighbours in the order."""

    def judged(table: pa.Table, cut_before: bool, cut_after: bool, same_before: bool):
        """Of rows of whole runs; the first or last run may go on elsewhere."""
        parse, whole = table["parse"].to_numpy(), table["whole"].to_numpy()
        n = len(parse)
        new_run = np.concatenate([[True], parse[1:] != parse[:-1]])
        new_kind = new_run | np.concatenate([[True], whole[1:] != whole[:-1]])
        kind, run = np.cumsum(new_kind) - 1, np.cumsum(new_run) - 1
        full = np.bincount(kind)[kind] > 1
        if same_before:
            full |= kind == 0
        open_ = np.zeros(run[-1] + 1, dtype=bool)
        open_[0], open_[-1] = open_[0] | cut_before, open_[-1] | cut_after
        near = (np.bincount(run)[run] > 1) | open_[run]
        left = np.zeros(run[-1] + 1, dtype=bool)
        left[run[near & ~full]] = True
        edge = (near & ~full) | (full & new_kind & (left | open_)[run])
        keep = np.flatnonzero(full | edge)
        return pa.record_batch([*(table[c].take(pa.array(keep)).combine_chunks() for c in ("row_key", "of_words", "lo", "hi")), pa.array(full[keep]), pa.array(edge[keep])], names=["row_key", "of_words", "lo", "hi", "full", "edge"])

    def run(batches):
        held, last, cut = None, None, True
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held.num_rows < most:
                continue
            parse, whole = held["parse"].to_numpy(), held["whole"].to_numpy()
            ends = np.flatnonzero(parse[1:] != parse[:-1])
            inside = not len(ends)  # a run longer than `most`: by kinds, or, if it is of one kind, as it is
            if inside:
                ends = np.flatnonzero(whole[1:] != whole[:-1])
            end = int(ends[-1]) + 1 if len(ends) else len(parse)
            yield judged(held.slice(0, end), cut, inside, last == (parse[0], whole[0]))
            last, cut = (parse[end - 1], whole[end - 1]), inside
            held = held.slice(end) if end < len(parse) else None
        if held is not None and held.num_rows:
            yield judged(held, cut, True, last == (held["parse"][0].as_py(), held["whole"][0].as_py()))

    return anchors.mapInArrow(run, "row_key long, of_words boolean, lo int, hi int, full boolean, edge boolean")


def _strings(edges: DataFrame, length: int, passage: int) -> DataFrame:
    """string (its name), row_key, of_words, lo, end, sure: of the strings that start in the ranges `edges` of a text, those alone in their
    batch; for others, their ranges (`sure`), and each string once without a row."""

    def rows(name, keys, of_words, lo, end, sure):
        n = len(name)
        lo, end = (pa.nulls(n, pa.int32()) if x is None else pa.array(x.astype(np.int32)) for x in (lo, end))
        return pa.record_batch([pa.array(name.view(np.int64)), pa.nulls(n, pa.int64()) if keys is None else pa.array(keys), pa.array(of_words), lo, end, pa.array(np.full(n, sure))], names=NAMES)

    def run(batches):
        for batch in batches:
            owners, kinds, starts, names = [], [], [], []
            for k in range(batch.num_rows):
                data = np.frombuffer(batch.column(1)[k].as_py(), dtype=np.uint8)
                prefix = prefix_hash(data)
                edge = batch.column(2)[k].values
                kind = edge.field("of_words").to_numpy(zero_copy_only=False)
                for of_words in np.unique(kind):
                    los, his = (edge.field(c).to_numpy()[kind == of_words] for c in ("lo", "hi"))
                    at = prefix_hash(_word_names(np.array([0, len(data)]), data, prefix)[1]) if of_words else prefix
                    size = his - los + 1
                    start = np.unique(np.repeat(los, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)).astype(np.int64)
                    owners.append(np.full(len(start), k))
                    kinds.append(np.full(len(start), of_words))
                    starts.append(start)
                    names.append(span_hash(at, start, start + (passage if of_words else length)))
            if not owners:
                continue
            owner, kind, start, name = map(np.concatenate, (owners, kinds, starts, names))
            end = start + np.where(kind, passage, length)
            keys = batch.column(0).to_numpy()
            once, which, times = np.unique(name, return_inverse=True, return_counts=True)
            many = times[which] > 1
            one = np.flatnonzero(~many)
            yield rows(name[one], keys[owner[one]], kind[one], start[one], end[one], False)
            witness = once[times > 1]
            yield rows(witness, None, np.zeros(len(witness), dtype=bool), None, None, False)
            at = np.flatnonzero(many)
            if len(at):
                new = np.concatenate([[True], (owner[at][1:] != owner[at][:-1]) | (kind[at][1:] != kind[at][:-1]) | (start[at][1:] != start[at][:-1] + 1)])
                first, last = at[new], at[np.append(np.flatnonzero(new)[1:], len(at)) - 1]
                spread = mix(keys[owner[first]].view(np.uint64) ^ start[first].astype(np.uint64))  # any name will do
                yield rows(spread, keys[owner[first]], kind[first], start[first], end[last], True)

    NAMES = ["string", "row_key", "of_words", "lo", "end", "sure"]
    return edges.select("row_key", "raw", "edges", "doc_id").mapInArrow(run, "string long, row_key long, of_words boolean, lo int, end int, sure boolean")


def covered(los: np.ndarray, ends: np.ndarray):
    """Maximal runs (starts, ends) of the union of [lo, end)."""
    order = np.argsort(los, kind="stable")
    los, far = los[order], np.maximum.accumulate(ends[order])
    cut = np.flatnonzero(los[1:] > far[:-1]) + 1
    return los[np.concatenate([[0], cut])], far[np.concatenate([cut - 1, [len(far) - 1]])]


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, repeated_words long, kept binary, spans array<struct<start:long,end:long>>"


def _cut(rows: DataFrame, with_text: bool) -> DataFrame:
    """Take the `ranges` (of_words, lo, end; null: none) of bytes out of each text, and count the words in those of words."""

    def run(batches):
        for batch in batches:
            for from_ in range(0, batch.num_rows, 500):
                out = []
                for doc_id, raw, ranges in zip(*(batch.column(c).slice(from_, 500) for c in range(3))):
                    raw, spans, repeated = raw.as_py(), [], 0
                    kept = raw
                    los, ends, kind = (ranges.values.field(c).to_numpy(zero_copy_only=False) if ranges.is_valid else np.zeros(0, dtype=bool) for c in ("lo", "end", "of_words"))
                    if kind.any():
                        a, b = covered(los[kind], ends[kind])
                        repeated = int((b - a).sum())
                    if not kind.all():
                        a, b = covered(los[~kind], ends[~kind])
                        edges = [0, *np.stack([a, b], axis=1).ravel().tolist(), len(raw)]
                        kept = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2]))
                        spans = [{"start": x, "end": y} for x, y in zip(edges[1:-1:2], edges[2:-1:2])]
                    out.append((doc_id.as_py(), len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), repeated, kept if with_text else None, spans if with_text else None))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "repeated_words", "kept", "spans"]
                yield pa.record_batch([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)

    return rows.select("doc_id", "raw", "ranges").mapInArrow(run, RESULT)


def remove_repeats(
    df: DataFrame, length: int = 400, span: int = 128, gram: int = 12, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text", passage: int = 0
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with `passage` repeated_words, the words covered by a string of
    `passage` words that also starts anywhere else; `with_text` the kept bytes and removed spans."""
    if length < span + gram:
        raise ValueError("length must be at least span + gram")
    if passage < 0 or passage == 1:
        raise ValueError("passage must be 0 or at least 2")
    docs = _binary(df, id_col, text_col)
    order = ["parse", "whole", "row_key", "lo"]
    anchors = _anchors(docs, length, span, gram, passage).repartitionByRange(*order).sortWithinPartitions(*order)
    marked = stash(_neighbours(anchors))

    edges = marked.where("edge").groupBy("row_key").agg(F.collect_list(F.struct("of_words", "lo", "hi")).alias("edges"))
    strings = _strings(docs.join(dealt(edges), "row_key"), length, passage)
    # A string is in as many rows as batches at most.
    strings = strings.withColumn("times", F.count("*").over(Window.partitionBy("string"))).where("row_key IS NOT NULL AND (sure OR times > 1)")
    end = F.col("hi") + F.when(F.col("of_words"), passage).otherwise(length)
    full = marked.where("full").select("row_key", "of_words", "lo", end.alias("end"))
    ranges = full.unionByName(strings.select("row_key", "of_words", "lo", "end")).groupBy("row_key").agg(F.collect_list(F.struct("of_words", "lo", "end")).alias("ranges"))
    out = _cut(docs.join(dealt(ranges), "row_key", "left"), with_text)
    out = out if passage else out.drop("repeated_words")
    return out if with_text else out.drop("kept", "spans")
