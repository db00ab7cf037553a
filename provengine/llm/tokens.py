"""Token-ID output: one compressed wavelet matrix a shard.

Texts are range-partitioned and sorted by id (nulls first), encoded, and packed into shards of about
`shard_tokens` ids that never split a text. A shard's file holds the documents' ids and lengths and the
wavelet matrix of its token ids: for each bit, from the highest, a plane of the bits in the order that the
planes above left (zeros first, each half in order). Beside each plane stands its rank directory (ones before
every 512 bits), and planes are compressed in chunks that can be opened alone. So access, rank, count and
select read the directory and one chunk a plane, from that one file; `decode` opens all. Files are values of
a binary column, which Spark writes to the shared folder, so that any executor can read them.

Null texts are empty (their end id alone); null ids come first; texts with the same id stand side by side
in the order of their bytes; empty tables give no files; other columns are ignored. An id that needs more
than `bits` bits is an error.
"""

from __future__ import annotations

import json
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prefix_hash, raw_bytes, span_hash, stash

MAGIC = b"WVMX2"
RANK_STEP = 512  # bits between two counts of the rank directory
CHUNK = 1 << 17  # bits of a plane that are compressed together


def wavelet_planes(ids: np.ndarray, bits: int):
    """(packed plane, number of zeros) of each bit, from the highest."""
    left = ids
    for bit in range(bits - 1, -1, -1):
        one = (left & np.array(1 << bit, dtype=left.dtype)) != 0
        zeros, ones = np.flatnonzero(~one), np.flatnonzero(one)
        yield np.packbits(one), len(zeros)
        below = np.empty_like(left)
        np.take(left, zeros, out=below[: len(zeros)], mode="clip")
        np.take(left, ones, out=below[len(zeros) :], mode="clip")
        left = below


def pack(doc_ids: list, lengths: list[int], ids: np.ndarray, bits: int = 16) -> bytes:
    """A shard's file."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"a token id needs more than {bits} bits")
    known = np.array([x is not None for x in doc_ids], dtype=np.uint8)
    index = known.tobytes() + np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes() + np.array(lengths, dtype="<i8").tobytes()
    press = zstandard.ZstdCompressor(level=1)
    step, zeros, parts, sizes = RANK_STEP // 8, [], [press.compress(index)], []
    narrow = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    for plane, empty in wavelet_planes(narrow, bits):
        ones = np.bitwise_count(np.pad(plane, (0, -len(plane) % step))).reshape(-1, step).sum(axis=1, dtype=np.int64)
        parts.append(np.concatenate([[0], np.cumsum(ones)]).astype("<u4").tobytes())
        chunks = [press.compress(plane[a : a + CHUNK // 8].tobytes()) for a in range(0, len(plane), CHUNK // 8)]
        zeros.append(empty)
        sizes += map(len, chunks)
        parts += chunks
    head = struct.pack("<5sBQQQ", MAGIC, bits, len(doc_ids), len(ids), len(parts[0]))
    return b"".join((head, np.array([*zeros, *sizes], dtype="<u8").tobytes(), *parts))


class TokenShard:
    """A shard's file: its documents, and its token ids by access, rank, count and select."""

    HEAD = 30

    def __init__(self, data: bytes):
        magic, self.bits, self.docs, self.n, index = struct.unpack_from("<5sBQQQ", data)
        if magic != MAGIC:
            raise ValueError("not a shard file")
        self.data, self.press, self.chunks = data, zstandard.ZstdDecompressor(), -(-self.n // CHUNK)
        numbers = np.frombuffer(data, dtype="<u8", count=self.bits * (1 + self.chunks), offset=self.HEAD).astype(np.int64)
        self.zeros, sizes = numbers[: self.bits].tolist(), numbers[self.bits :].reshape(self.bits, self.chunks)
        steps = -(-self.n // RANK_STEP) + 1
        at = self.HEAD + 8 * len(numbers)
        self.index, at = (at, index), at + index
        self.ones, self.places = [], np.zeros((self.bits, self.chunks + 1), dtype=np.int64)
        for level in range(self.bits):
            self.ones.append(np.frombuffer(data, dtype="<u4", count=steps, offset=at))  # the rank directory
            at += 4 * steps
            self.places[level] = np.concatenate([[at], at + np.cumsum(sizes[level])])
            at = int(self.places[level, -1])
        self.opened: dict[tuple[int, int], np.ndarray] = {}

    def documents(self) -> tuple[list, np.ndarray]:
        """Ids and lengths of the documents, in order."""
        at, size = self.index
        raw = self.press.decompress(self.data[at : at + size]) if self.docs else b""
        known = np.frombuffer(raw, dtype=np.uint8, count=self.docs)
        names, lengths = np.frombuffer(raw, dtype="<i8", offset=self.docs).reshape(2, self.docs)
        return [x if k else None for x, k in zip(names.tolist(), known)], lengths

    def chunk(self, level: int, k: int) -> np.ndarray:
        """The bytes of one chunk of a plane."""
        if (level, k) not in self.opened:
            a, b = self.places[level, k : k + 2].tolist()
            self.opened[level, k] = np.frombuffer(self.press.decompress(self.data[a:b]), dtype=np.uint8)
        return self.opened[level, k]

    def decode(self) -> np.ndarray:
        """All ids: the planes undone from the lowest."""
        out = np.zeros(self.n, dtype=np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            plane = np.concatenate([self.chunk(level, k) for k in range(self.chunks)]) if self.chunks else np.zeros(0, np.uint8)
            one = np.unpackbits(plane, count=self.n).view(bool)
            zeros = self.zeros[level]
            out[zeros:] |= np.array(1 << (self.bits - 1 - level), dtype=out.dtype)
            above = np.empty_like(out)
            above[np.flatnonzero(~one)] = out[:zeros]
            above[np.flatnonzero(one)] = out[zeros:]
            out = above
        return out

    def _ones_before(self, level: int, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits of a plane, for many i: the directory's count, then whole bytes, then bits."""
        block = i // RANK_STEP
        out = self.ones[level][block].astype(np.int64)
        rest = i - block * RANK_STEP
        for k in np.unique(i[rest > 0] // CHUNK).tolist():
            mine = np.flatnonzero((rest > 0) & (i // CHUNK == k))
            plane = self.chunk(level, k)
            first = (block[mine] * RANK_STEP - k * CHUNK) // 8
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(plane), dtype=np.int64)]) if len(mine) > 64 else None
            whole = rest[mine] // 8
            if before is not None:
                out[mine] += before[first + whole] - before[first]
            else:
                out[mine] += [int(np.bitwise_count(plane[a : a + w]).sum()) for a, w in zip(first.tolist(), whole.tolist())]
            part = rest[mine] % 8
            tail = plane[np.minimum(first + whole, len(plane) - 1)] >> (8 - part).astype(np.uint8)
            out[mine] += np.where(part > 0, np.bitwise_count(tail), 0)
        return out

    def access(self, i: int) -> int:
        out = 0
        for level in range(self.bits):
            one = self.chunk(level, i // CHUNK)[i % CHUNK // 8] >> (7 - i % 8) & 1
            ones = int(self._ones_before(level, np.array([i]))[0])
            i = self.zeros[level] + ones if one else i - ones
            out = out << 1 | int(one)
        return out

    def ranks(self, token: int, places: np.ndarray) -> np.ndarray:
        """Occurrences of `token` among the first i ids, for each i of `places`."""
        at = np.concatenate([[0], np.asarray(places, dtype=np.int64)])
        for level in range(self.bits):
            ones = self._ones_before(level, at)
            at = self.zeros[level] + ones if token >> (self.bits - 1 - level) & 1 else at - ones
        return at[1:] - at[0]

    def count(self, token: int) -> int:
        return int(self.ranks(token, np.array([self.n]))[0]) if 0 <= token < 1 << self.bits else 0

    def select(self, token: int, k: int) -> int:
        """Place of occurrence k (from 0) of `token`; -1 if there is none: down to its run of ids, then up by select in each plane."""
        if not 0 <= k < self.count(token):
            return -1
        low = 0
        for level in range(self.bits):
            ones = int(self._ones_before(level, np.array([low]))[0])
            low = self.zeros[level] + ones if token >> (self.bits - 1 - level) & 1 else low - ones
        at = low + k
        for level in range(self.bits - 1, -1, -1):
            one = at >= self.zeros[level]
            at = self._bit(level, one, at - self.zeros[level] if one else at)
        return at

    def _bit(self, level: int, one: bool, k: int) -> int:
        """Place of the bit k (from 0) of a kind in a plane, by the directory and one chunk."""
        ones = self.ones[level].astype(np.int64)
        counts = ones if one else np.arange(len(ones)) * RANK_STEP - ones
        block = int(np.searchsorted(counts[:-1], k, side="right")) - 1
        first = block * RANK_STEP % CHUNK // 8
        bits = np.unpackbits(self.chunk(level, block * RANK_STEP // CHUNK)[first : first + RANK_STEP // 8])
        return block * RANK_STEP + int(np.flatnonzero(bits == one)[k - int(counts[block])])


class _Places:
    """Places by 64-bit key: open addressing in two arrays, many keys at a time."""

    def __init__(self, size: int = 1 << 18):
        self.keys, self.values, self.n = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.int32), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        mask = np.uint64(len(self.keys) - 1)
        slot = keys & mask
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], -1)
        left = np.flatnonzero((held != keys) & (held != 0))
        while len(left):
            slot[left] = (slot[left] + np.uint64(1)) & mask
            held = self.keys[slot[left]]
            hit = held == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (held != 0)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Put in keys that differ and aren't there yet."""
        self.n += len(keys)
        if 2 * self.n > len(self.keys):
            full = np.flatnonzero(self.keys)
            old = self.keys[full], self.values[full]
            size = len(self.keys)
            while 2 * self.n > size:
                size *= 2
            self.keys, self.values = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.int32)
            self._put(*old)
        self._put(keys, values)

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        mask = np.uint64(len(self.keys) - 1)
        slot = keys & mask
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]  # of those that meet in a slot one stays
            mine = free & (self.keys[slot] == keys)
            self.values[slot[mine]] = values[mine]
            keys, values, slot = keys[~mine], values[~mine], (slot[~mine] + np.uint64(1)) & mask


def appended(array: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """`array`, of which `used` values count, with `more` after them: in place while there is room."""
    if used + len(more) > len(array):
        array, old = np.empty(2 * (used + len(more)), dtype=array.dtype), array
        array[:used] = old[:used]
    array[used : used + len(more)] = more
    return array


LETTER, DIGIT, SPACE, OTHER = range(4)


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of each character up to U+2027."""
    import regex

    out = np.full(0x2028, OTHER, dtype=np.uint8)
    for kind, name in ((LETTER, "L"), (DIGIT, "N"), (SPACE, "White_Space")):
        member = regex.compile(rf"\p{{{name}}}").match
        out[[c for c in range(0x2028) if member(chr(c))]] = kind
    return out


@lru_cache(1)
def _byte_letters() -> np.ndarray:
    """The character that stands for each byte in a byte-level vocabulary: itself if it can be seen, or one from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = np.zeros(256, dtype="<u4")
    out[seen] = seen
    hidden = np.setdiff1d(np.arange(256), seen)
    out[hidden] = 256 + np.arange(len(hidden))
    return out


class PieceEncoder:
    """The library's ids, remembered by piece.

    The byte-level tokenizer cuts a text by a fixed pattern before merging, so a text's ids are those of its
    pieces in turn. Pieces are found in numpy in the UTF-8 of many texts at once, from classes of characters, and
    known by a fingerprint; each new piece goes to the library, and a full memory starts anew. Texts with
    characters on which Unicode tables might differ, contractions or added tokens go to the library whole; so do
    all texts if the file names another pre-tokenizer, or a normalizer.
    """

    MOST = 2_500_000

    def __init__(self, path: str, end_id: int):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the cores are Spark's to deal out
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.pieces = Tokenizer.from_file(path), Tokenizer.from_file(path)
        told = json.loads(self.library.to_str())
        cut = told["pre_tokenizer"] or {}
        self.known_form = told["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
        self.added = [t["content"].encode() for t in told["added_tokens"]]
        self.known_form = self.known_form and all(token.isascii() for token in self.added)
        if self.known_form:  # pieces come cut already, in the characters that stand for bytes, which no blank is
            self.letters = _byte_letters()
            self.pieces.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.end_id = end_id
        self.clear()

    def clear(self):
        """Place 0 is the end id."""
        self.place, self.n, self.used = _Places(), 1, 1
        self.flat, self.starts = np.array([self.end_id], dtype=np.uint32), np.array([0, 1], dtype=np.int64)

    def odd(self, offsets: np.ndarray, data: np.ndarray, raw: bytes) -> np.ndarray:
        """Texts that the library must cut: with characters beyond U+04FF but for U+2010 to U+2027, contractions, or added tokens."""
        if not self.known_form:
            return np.arange(len(offsets) - 1)
        at = np.flatnonzero(data >= 0xD4)
        if len(at):
            two, three = (np.append(data, [0, 0])[at + k].astype(int) for k in (1, 2))
            at = at[~((data[at] == 0xE2) & (two == 0x80) & (three >= 0x90) & (three <= 0xA7))]
        quote = np.flatnonzero(data == 39)
        near = [raw[q + 1 : q + 3] for q in quote.tolist()]
        short = [q for q, two in zip(quote.tolist(), near) if two[:1] in (b"s", b"t", b"m", b"d") or two in (b"re", b"ve", b"ll")]
        found = []
        for token in self.added:
            spot = raw.find(token)
            while spot >= 0:
                found.append(spot)
                spot = raw.find(token, spot + 1)
        return np.unique(np.searchsorted(offsets, np.concatenate([at, np.array(short + found, dtype=np.int64)]), side="right") - 1)

    @staticmethod
    def _starts(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Where pieces start: runs of one class, and the last blank of a run of white space goes with what follows."""
        classes = _classes()
        kinds = classes[:256][data]
        high = np.flatnonzero(data >= 0xC0)
        if len(high):  # bytes of one character share its class
            wide = data[high] >= 0xE0
            low = high[~wide]
            kinds[low] = kinds[low + 1] = classes[(data[low].astype(np.int64) & 31) << 6 | data[low + 1] & 63]
            if wide.any():
                top = high[wide]
                kinds[top] = kinds[top + 1] = kinds[top + 2] = classes[0x2000 | data[top + 2].astype(np.int64) & 63]  # U+2010 to U+2027 alone get here
        begins = np.empty(len(data) + 1, dtype=bool)
        begins[0] = begins[-1] = True
        np.not_equal(kinds[1:], kinds[:-1], out=begins[1:-1])
        begins[offsets] = True
        every = np.flatnonzero(begins)
        space = np.flatnonzero(kinds[every[:-1]] == SPACE)
        space, end = every[space], every[space + 1]
        border = np.zeros(len(data) + 1, dtype=bool)
        border[offsets] = True
        inner = np.flatnonzero(~border[end])  # white space before something in the same text
        space, end = space[inner], end[inner]
        size = 1 + (data[end - 1] >= 0x80)  # bytes of its last character: U+0085 and U+00A0 have two
        last = (end - size)[end - space > size]
        goes_on = end[data[end - 1] == 32]
        begins[last] = True
        begins[goes_on] = False
        return np.flatnonzero(begins[:-1])

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> np.ndarray:
        """Encode new pieces and return their places. The library gets many at once, a blank between two, and tells whose an id is."""
        flat, sizes = [], []
        for at in range(0, len(pieces), 2000):
            some = pieces[at : at + 2000]
            letters = self.letters[np.frombuffer(b" ".join(some), dtype=np.uint8)]
            letters[np.cumsum([len(p) + 1 for p in some[:-1]], dtype=np.int64) - 1] = 32
            got = self.pieces.encode(letters.tobytes().decode("utf-32-le"), add_special_tokens=False)
            flat.append(np.array(got.ids, dtype=np.uint32))
            sizes.append(np.bincount(np.array(got.word_ids, dtype=np.int64)))
        ids, ends = np.concatenate(flat), self.used + np.cumsum(np.concatenate(sizes))
        if len(ends) != len(pieces):
            raise ValueError("pieces and ids differ in number")
        places = np.arange(self.n, self.n + len(pieces), dtype=np.int32)
        self.place.add(keys, places)
        self.flat, self.starts = appended(self.flat, self.used, ids), appended(self.starts, self.n + 1, ends)
        self.n, self.used = self.n + len(pieces), self.used + len(ids)
        return places

    def __call__(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with its end id; their number by text) of texts that lie end to end in `data`."""
        raw = data.tobytes()
        strange = self.odd(offsets, data, raw)
        if not len(strange):
            return self._encode(offsets, data, raw)
        parts, sizes, at = [], [], 0
        for k in [*strange.tolist(), len(offsets) - 1]:
            if k > at:
                a, b = int(offsets[at]), int(offsets[k])
                ids, size = self._encode(offsets[at : k + 1] - a, data[a:b], raw[a:b])
                parts.append(ids)
                sizes.append(size)
            if k < len(offsets) - 1:
                text = raw[offsets[k] : offsets[k + 1]].decode("utf-8", "replace")
                parts.append(np.array([*self.library.encode(text, add_special_tokens=False).ids, self.end_id], dtype=np.uint32))
                sizes.append(np.array([len(parts[-1])]))
            at = k + 1
        return np.concatenate(parts), np.concatenate(sizes)

    def _encode(self, offsets: np.ndarray, data: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        start = self._starts(offsets, data) if len(data) else np.zeros(0, dtype=np.int64)
        end = np.append(start[1:], len(data))[: len(start)]
        keys = span_hash(prefix_hash(data), start, end)
        keys[keys == 0] = 1
        place = self.place.find(keys)
        new = np.flatnonzero(place < 0)
        if len(new):
            once, first, which = np.unique(keys[new], return_index=True, return_inverse=True)
            if self.n + len(once) > self.MOST:
                self.clear()
                new = np.arange(len(keys))
                once, first, which = np.unique(keys, return_index=True, return_inverse=True)
            at = new[first]
            place[new] = self._learn(once, [raw[x:y] for x, y in zip(start[at].tolist(), end[at].tolist())])[which]
        cuts = np.searchsorted(start, offsets[1:])
        place = np.insert(place, cuts, 0)  # the end id of each text
        size = self.starts[place + 1] - self.starts[place]
        ends = np.cumsum(size)
        take = np.arange(ends[-1]) + np.repeat(self.starts[place] - (ends - size), size)
        return self.flat[take], np.diff(np.append(0, ends[cuts + np.arange(len(cuts))]))


_ENCODERS: dict[tuple[str, int], PieceEncoder] = {}


def write_shards(df: DataFrame, tokenizer: str, end_id: int, shard_tokens: int = 1_000_000, bits: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, shard, n_tokens, file: shards in ascending id order, written to the shared folder and read back.

    `tokenizer` names a tokenizers file on each executor, or of the public_tokenizers package if it has no folder."""

    def run(batches):
        import os

        path = tokenizer
        if not os.path.dirname(path):
            import public_tokenizers

            path = public_tokenizers.path(tokenizer)
        if (path, end_id) not in _ENCODERS:  # kept while the worker lives
            _ENCODERS[path, end_id] = PieceEncoder(path, end_id)
        encode = _ENCODERS[path, end_id]
        docs, lengths, held, total, shard, part = [], [], [], 0, 0, 0

        def flush():
            file = pack(docs, np.concatenate(lengths), np.concatenate(held), bits)
            return pa.record_batch([pa.array([part]), pa.array([shard]), pa.array([total]), pa.array([file], pa.binary())], names=["part", "shard", "n_tokens", "file"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part, names = batch.column(0)[0].as_py(), batch.column(1).to_pylist()
            for first, offsets, data in raw_bytes(batch.column(2), min(700_000, 2 * shard_tokens)):
                ids, sizes = encode(offsets, data)
                docs += names[first : first + len(sizes)]
                held.append(ids)
                lengths.append(sizes)
                total += len(ids)
                if total >= shard_tokens:
                    yield flush()
                    docs, lengths, held, total, shard = [], [], [], 0, shard + 1
        if docs:
            yield flush()

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = (
        df.select(F.col(id_col).cast("long").alias("doc_id"), text.cast("binary").alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .select(F.spark_partition_id().cast("long").alias("part"), "doc_id", "text")
    )
    return stash(rows.mapInArrow(run, "part long, shard long, n_tokens long, file binary"))


def read_shards(shards: DataFrame, end_id: int) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and end_ids (how often `end_id` stands in it, by rank) of every document, from the files alone."""

    def run(batches):
        for batch in batches:
            for part, shard, file in zip(batch.column(0), batch.column(1), batch.column(2)):
                held = TokenShard(file.as_py())
                docs, lengths = held.documents()
                ends = np.cumsum(lengths)
                starts = ends - lengths
                ids = held.decode().astype("<u4")
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                marks = np.diff(held.ranks(end_id, np.append(0, ends)))
                n = len(docs)
                yield pa.record_batch(
                    [pa.array(np.full(n, part.as_py())), pa.array(np.full(n, shard.as_py())), pa.array(docs, pa.int64()), pa.array(starts), pa.array(lengths.astype(np.int64)), pa.array(sums, pa.int64()), pa.array(marks)],
                    names=["part", "shard", "doc_id", "inside", "n_tokens", "ids_crc32", "end_ids"],
                )

    docs = shards.select("part", "shard", "file").mapInArrow(run, "part long, shard long, doc_id long, inside long, n_tokens long, ids_crc32 long, end_ids long")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))  # one row a partition
    parts = parts.select("part", before(Window.orderBy("part")).alias("part_start"))
    starts = shards.select("part", "shard", before(Window.partitionBy("part").orderBy("shard")).alias("shard_start")).join(parts, "part")
    return docs.join(starts, ["part", "shard"]).select(
        "doc_id", (F.col("part_start") + F.col("shard_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "end_ids"
    )
