"""Media columns: baseline JPEG in numpy, written and read.

A payload is stored without loss as quantised coefficients, one byte a coefficient, in zigzag order, 64 to a
block: bytes that are frequent in text are small numbers (0, 1, -1, 2, ...), which Huffman codes of run and size,
as of any baseline image, hold in few bits. A restart marker follows each block, so DC values stand for themselves
and blocks are decoded side by side. The payload's length is in a comment segment.

`parse` reads the marker segments of any baseline JPEG, `coefficients` Huffman-decodes its scan (with any tables,
components, subsampling and restart interval), and `thumbnail` takes one luminance value from each block's DC
coefficient. `restarted` decodes many images of one kind at once: a step takes the next symbol of every block.
A batch of images is decoded in stretches of a bounded number of bytes, or one longer image; no task holds more
than a batch.

Null payloads count as empty; an empty payload is 64 zero bytes; repeated rows give repeated results; rows
with null ids are kept; an empty table gives no rows; columns beside the two named ones are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw_bytes, stash

BLOCK = 64
MOST_BLOCKS = 65535 // 8  # along a side
EOB, ZRL = 0x00, 0xF0

#: Fixed values of the format: bytes that are frequent in European texts (blank, letters, then marks and the UTF-8 of
#: accented letters), then all others in their order.
FREQUENT = b" enairtosludhcmpgvfbqywzjxk\xc3.,\n\xa9\xa8\xb3\xbc\xa4\xa1\xad\xb1\xb6\x9f\xaa\xa7"
BYTES = np.array([*FREQUENT, *(x for x in range(256) if x not in FREQUENT)], dtype=np.uint8)
#: The coefficient of a byte by its place in BYTES: 0, 1, -1, 2, -2, ...
NUMBERS = np.array([(k + 1) // 2 if k % 2 else -(k // 2) for k in range(256)])
COEFFICIENT = np.empty(256, dtype=np.int16)
COEFFICIENT[BYTES] = NUMBERS
BYTE = np.zeros(512, dtype=np.uint8)
BYTE[NUMBERS + 256] = BYTES
SIZE = np.array([int(k).bit_length() for k in range(1 << 11)], dtype=np.uint8)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def huffman_table(weights: dict[int, float]) -> tuple[bytes, bytes]:
    """(codes of each length from 1 to 16, symbols in the order of their codes) of least length for `weights`; the code of ones alone is left free."""
    heap = [(w, k, [s]) for k, (s, w) in enumerate(sorted(weights.items()))] + [(0.0, -1, [-1])]
    length = dict.fromkeys([*weights, -1], 0)
    heapq.heapify(heap)
    while len(heap) > 1:
        (a, k, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        for s in x + y:
            length[s] += 1
        heapq.heappush(heap, (a + b, k, x + y))
    del length[-1]  # one of the longest codes; in code order it would be the last
    if max(length.values()) > 16:
        raise ValueError("a code is longer than 16 bits")
    counts = bytes(sum(n == k for n in length.values()) for k in range(1, 17))
    return counts, bytes(sorted(length, key=lambda s: (length[s], s)))


#: How often, about, a coefficient of text has each size; runs of zeros fall off by the share of size 0.
SHARES = (0.16, 0.19, 0.22, 0.23, 0.11, 0.04, 0.03, 0.01, 0.01)
DC_TABLE = huffman_table(dict(enumerate(SHARES)))
AC_TABLE = huffman_table({run << 4 | size: max(SHARES[size] * SHARES[0] ** run, 2**-12) for run in range(16) for size in range(1, 9)} | {EOB: 0.01, ZRL: 2**-10})


def codes(table: tuple[bytes, bytes]) -> dict[int, tuple[int, int]]:
    """(length, code) of each symbol."""
    counts, symbols = table
    out, code, at = {}, 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            out[symbols[at]] = length, code
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _by_symbol(table: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    length, code = np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.uint64)
    for symbol, (n, c) in codes(table).items():
        length[symbol], code[symbol] = n, c
    return length, code


def _scans(coefs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends of the blocks) of the scan of blocks (n, 64), each padded, stuffed and with two bytes for a marker."""
    n = len(coefs)
    size = SIZE[np.abs(coefs)].astype(np.int64)
    value = np.where(coefs < 0, coefs + (1 << size) - 1, coefs).astype(np.uint64)
    dc_length, dc_code = _by_symbol(DC_TABLE)
    ac_length, ac_code = _by_symbol(AC_TABLE)
    # One slot a coefficient, one for the end of the block, and one for the ones that fill its last byte; zeros have none.
    length, code = np.zeros((n, BLOCK + 2), dtype=np.int64), np.zeros((n, BLOCK + 2), dtype=np.uint64)
    length[:, 0] = dc_length[size[:, 0]] + size[:, 0]
    code[:, 0] = dc_code[size[:, 0]] << size[:, 0].astype(np.uint64) | value[:, 0]
    some = coefs != 0
    some[:, 0] = True
    row, col = np.nonzero(some)
    run = np.where(col > 0, np.diff(col, prepend=0) - 1, 0)
    ac = col > 0
    row_, col_, run_ = row[ac], col[ac], run[ac]
    symbol, own = (run_ % 16) << 4 | size[row_, col_], size[row_, col_]
    zeros = run_ // 16
    word, bits = ac_code[symbol] << own.astype(np.uint64) | value[row_, col_], ac_length[symbol] + own
    for k in range(1, 4):  # runs of 16 zeros come first
        far = zeros >= k
        word[far] |= ac_code[ZRL] << bits[far].astype(np.uint64)
        bits[far] += ac_length[ZRL]
    code[row_, col_], length[row_, col_] = word, bits
    last = np.ones(n, dtype=bool)
    last[row_[col_ == BLOCK - 1]] = False
    length[last, BLOCK], code[last, BLOCK] = ac_length[EOB], ac_code[EOB]

    total = length.sum(axis=1)
    length[:, -1] = -total % 8
    code[:, -1] = (1 << length[:, -1]) - 1
    block_end = np.cumsum(total + length[:, -1]) // 8
    used = np.flatnonzero(length)
    bits, word = length.ravel()[used], code.ravel()[used]
    place = np.cumsum(bits) - bits
    # Into words of 64 bits: no two codes share a bit, so those that start in a word add up; one at most goes on in the next.
    at, room = place >> 6, 64 - (place & 63)
    over = np.maximum(bits - room, 0)
    here = (word >> over.astype(np.uint64)) << np.maximum(room - bits, 0).astype(np.uint64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    words = np.zeros(int(at[-1]) + 2, dtype=np.uint64)
    words[at[first]] = np.add.reduceat(here, first)
    on = np.flatnonzero(over)
    words[at[on] + 1] += word[on] << (64 - over[on]).astype(np.uint64)
    data = words.byteswap().view(np.uint8)[: int(block_end[-1])]
    stuffed = np.flatnonzero(data == 0xFF)
    extra = np.concatenate([stuffed + 1, np.repeat(block_end, 2)])
    order = np.argsort(extra, kind="stable")
    data = np.insert(data, extra[order], np.concatenate([np.zeros(len(stuffed), np.uint8), np.tile(np.array([0xFF, 0xD0], np.uint8), n)])[order])
    return data, block_end + np.searchsorted(stuffed, block_end) + 2 * np.arange(1, n + 1)


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % BLOCK) if raw else bytes(BLOCK)


def encode_all(payloads: list[bytes]) -> list[bytes]:
    """A JPEG for each payload, whose length is a positive multiple of 64."""
    shapes, filled = [], []
    for payload in payloads:
        blocks = len(payload) // BLOCK
        wide = max(min(blocks, 64), -(-blocks // MOST_BLOCKS))
        high = -(-blocks // wide)
        shapes.append((wide, high))
        filled += [payload, FREQUENT[:1] * ((wide * high - blocks) * BLOCK)]
    data, ends = _scans(COEFFICIENT[np.frombuffer(b"".join(filled), dtype=np.uint8)].reshape(-1, BLOCK))
    last = np.cumsum([w * h for w, h in shapes])
    first = last - [w * h for w, h in shapes]
    data[ends - 1] = 0xD0 + (np.arange(len(ends)) - np.repeat(first, last - first)) % 8
    tables = _segment(0xC4, b"\x00" + DC_TABLE[0] + DC_TABLE[1]) + _segment(0xC4, b"\x10" + AC_TABLE[0] + AC_TABLE[1])
    out, body = [], data.tobytes()
    for payload, (wide, high), a, b in zip(payloads, shapes, first.tolist(), last.tolist()):
        out.append(b"".join((
            b"\xff\xd8",
            _segment(0xFE, struct.pack(">Q", len(payload))),
            _segment(0xDB, b"\x00" + b"\x01" * 64),
            _segment(0xC0, struct.pack(">BHHBBBB", 8, high * 8, wide * 8, 1, 1, 0x11, 0)),
            tables,
            _segment(0xDD, struct.pack(">H", 1)),
            _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
            body[int(ends[a - 1]) if a else 0 : int(ends[b - 1]) - 2],
            b"\xff\xd9",
        )))
    return out


def encode(payload: bytes) -> bytes:
    return encode_all([payload])[0]


def parse(data: bytes) -> dict:
    """The marker segments of a baseline JPEG: sizes, components, tables, restart interval, comment and scan."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    out: dict = {"quant": {}, "huffman": {}, "restart": 0, "comment": b""}
    at = 2
    while True:
        if data[at] != 0xFF:
            raise ValueError("a marker was expected")
        marker, (length,) = data[at + 1], struct.unpack_from(">H", data, at + 2)
        body, at = data[at + 4 : at + 2 + length], at + 2 + length
        if marker == 0xFE:
            out["comment"] = body
        elif marker == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                out["quant"][body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], dtype=">u2" if wide == 2 else "u1").astype(int)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                counts, n = body[1:17], sum(body[1:17])
                out["huffman"][body[0]] = (counts, body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC0:
            _, high, wide, n = struct.unpack_from(">BHHB", body)
            out |= {"height": high, "width": wide, "parts": [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]}
        elif 0xC1 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not a baseline image")
        elif marker == 0xDD:
            (out["restart"],) = struct.unpack(">H", body)
        elif marker == 0xDA:
            out["tables"] = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])}
            end = data.rfind(b"\xff\xd9")
            out["scan"] = data[at : end if end >= at else len(data)]
            return out


def _lookup(table: tuple[bytes, bytes]) -> dict[tuple[int, int], int]:
    """(length, code) to symbol."""
    return {key: symbol for symbol, key in codes(table).items()}


def _by_code(table: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(length, symbol) for each 16 bits that begin with a code; length 0: none does."""
    length, symbol = np.zeros(1 << 16, dtype=np.uint8), np.zeros(1 << 16, dtype=np.uint8)
    for s, (n, c) in codes(table).items():
        length[c << (16 - n) : (c + 1) << (16 - n)] = n
        symbol[c << (16 - n) : (c + 1) << (16 - n)] = s
    return length, symbol


def kind_of(image: dict) -> tuple | None:
    """What images that `restarted` decodes together have in common; None if it can't."""
    if len(image["parts"]) > 1 or image["restart"] != 1:
        return None
    dc, ac = image["tables"][image["parts"][0][0]]
    return image["huffman"][dc], image["huffman"][16 | ac]


def restarted(images: list[dict]) -> list[np.ndarray]:
    """Quantised coefficients (rows, columns, 64) of images of one component and one kind, with a restart marker after each block."""
    dc, ac = (_by_code(t) for t in kind_of(images[0]))
    shapes = [(-(-i["height"] // 8), -(-i["width"] // 8)) for i in images]
    # A marker after each scan too, and bytes to look ahead into.
    data = np.frombuffer(b"".join([*(i["scan"] + b"\xff\xd0" for i in images), bytes(8)]), dtype=np.uint8)
    mark = np.flatnonzero(data[:-8] == 0xFF)
    after = data[mark + 1]
    keep = np.ones(len(data), dtype=bool)
    keep[mark[after == 0] + 1] = False  # stuffing
    ends = mark[(after >= 0xD0) & (after <= 0xD7)]
    keep[ends] = keep[ends + 1] = False
    ends = ends - np.searchsorted(np.flatnonzero(~keep), ends)
    flat = data[keep]
    n = len(ends)
    if n != sum(h * w for h, w in shapes):
        raise ValueError("blocks are missing")
    wide = np.zeros(len(flat) - 7, dtype=np.uint64)
    for k in range(8):
        wide |= flat[k : len(flat) - 7 + k].astype(np.uint64) << np.uint64(56 - 8 * k)
    out = np.zeros((n, BLOCK), dtype=np.int32)
    live, place, col = np.arange(n), 8 * np.concatenate([[0], ends[:-1]]), np.zeros(n, dtype=np.int64)
    table = dc
    while len(live):
        ahead = wide[place >> 3] << (place & 7).astype(np.uint64)
        top = (ahead >> np.uint64(48)).astype(np.int64)
        length, symbol = table[0][top].astype(np.int64), table[1][top].astype(np.int64)
        if not length.all():
            raise ValueError("no such code")
        size = symbol & 15
        v = ((ahead << length.astype(np.uint64)) >> (64 - np.maximum(size, 1)).astype(np.uint64)).astype(np.int64)
        v = np.where(size == 0, 0, np.where(v >> np.maximum(size - 1, 0), v, v - (1 << size) + 1))
        place = place + length + size
        if table is dc:
            out[:, 0] = v
            col += 1
            table = ac
        else:
            col = col + (symbol >> 4)
            if (col > BLOCK - 1).any():
                raise ValueError("a run leaves its block")
            out[live, col] = v
            col = np.where(symbol == EOB, BLOCK, col + 1)
        more = col < BLOCK
        if not more.all():
            live, place, col = live[more], place[more], col[more]
    cuts = np.cumsum([h * w for h, w in shapes])[:-1]
    return [x.reshape(h, w, BLOCK) for x, (h, w) in zip(np.split(out, cuts), shapes)]


class _Bits:
    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, dtype=np.uint8)).tolist(), 0

    def symbol(self, table: dict) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.bits[self.at]
            self.at += 1
            if (length, code) in table:
                return table[length, code]
        raise ValueError("no such code")

    def value(self, size: int) -> int:
        if not size:
            return 0
        v = 0
        for b in self.bits[self.at : self.at + size]:
            v = v << 1 | b
        self.at += size
        return v if v >> (size - 1) else v - (1 << size) + 1


def _parts_of_scan(scan: bytes) -> list[bytes]:
    """The scan's stretches between restart markers, with stuffing taken out."""
    out, from_ = [], 0
    at = scan.find(b"\xff")
    while at >= 0:
        if at + 1 < len(scan) and 0xD0 <= scan[at + 1] <= 0xD7:
            out.append(scan[from_:at])
            from_ = at + 2
        at = scan.find(b"\xff", at + 2)
    return [x.replace(b"\xff\x00", b"\xff") for x in [*out, scan[from_:]]]


def coefficients(image: dict) -> np.ndarray:
    """Quantised coefficients of the first component's blocks, (rows, columns, 64), in zigzag order."""
    if kind_of(image):
        return restarted([image])[0]
    parts = image["parts"]
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    own_h, own_v = (1, 1) if len(parts) == 1 else parts[0][1:3]
    unit_h, unit_v = (8, 8) if len(parts) == 1 else (8 * most_h, 8 * most_v)
    across, down = -(-image["width"] // unit_h), -(-image["height"] // unit_v)
    tables = {k: _lookup(t) for k, t in image["huffman"].items()}
    shape = [(1, 1)] if len(parts) == 1 else [p[1:3] for p in parts]
    out = np.zeros((down * own_v, across * own_h, BLOCK), dtype=np.int32)
    stretches = iter(_parts_of_scan(image["scan"]))
    bits, last = _Bits(next(stretches)), [0] * len(parts)
    for unit in range(across * down):
        if image["restart"] and unit and unit % image["restart"] == 0:
            bits, last = _Bits(next(stretches)), [0] * len(parts)
        for k, (h, v) in enumerate(shape):
            d, a = image["tables"][parts[k][0]]
            for y in range(v):
                for x in range(h):
                    block = np.zeros(BLOCK, dtype=np.int32)
                    last[k] += bits.value(bits.symbol(tables[d]))
                    block[0], at = last[k], 1
                    while at < BLOCK:
                        s = bits.symbol(tables[16 | a])
                        if s == 0:
                            break
                        at += s >> 4
                        if s & 15:
                            block[at] = bits.value(s & 15)
                        at += 1
                    if k == 0:
                        out[unit // across * own_v + y, unit % across * own_h + x] = block
    return out


def thumbnail(image: dict, coefs: np.ndarray) -> np.ndarray:
    """One luminance value (0 to 255) from each block's DC coefficient."""
    dc = coefs[:, :, 0] * int(image["quant"][image["parts"][0][3]][0])
    return np.clip((dc + 4) // 8 + 128, 0, 255).astype(np.uint8)


def payload_of(image: dict, coefs: np.ndarray) -> bytes:
    (length,) = struct.unpack(">Q", image["comment"])
    return BYTE[coefs.reshape(-1)[:length] + 256].tobytes()


def feature(image: dict, thumb: np.ndarray) -> str:
    """Width x height, an 8 x 8 average hash of the thumbnail, and the thumbnail's checksum."""
    small = thumb[np.arange(8) * thumb.shape[0] // 8][:, np.arange(8) * thumb.shape[1] // 8].astype(int)
    bits = np.packbits(small.ravel() * small.size > small.sum()).tobytes().hex()
    return f"{image['width']}x{image['height']}:{bits}:{zlib.crc32(thumb.tobytes()):08x}"


STORED = "doc_id long, n_bytes long, media binary"
DESCRIBED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width int, height int, feature string"


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's bytes as a JPEG."""

    def run(batches):
        for batch in batches:
            for first, offsets, data in raw_bytes(batch.column(1), 500_000):
                raw = [data[a:b].tobytes() for a, b in zip(offsets, offsets[1:])]
                yield pa.record_batch([batch.column(0).slice(first, len(raw)), pa.array([len(x) for x in raw], pa.int64()), pa.array(encode_all([padded(x) for x in raw]), pa.binary())], names=["doc_id", "n_bytes", "media"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text.cast("binary").alias("raw")).mapInArrow(run, STORED)


def describe(stored: DataFrame) -> DataFrame:
    """Reads stored images: payload and media digests, dimensions and thumbnail hashes."""

    def described(data, image, coefs):
        payload = payload_of(image, coefs)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), image["width"], image["height"], feature(image, thumbnail(image, coefs))

    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string())
    names = [x.split()[0] for x in DESCRIBED.split(", ")]

    def run(batches):
        for batch in batches:
            for first, offsets, data in raw_bytes(batch.column(2), 500_000):
                files = [data[a:b].tobytes() for a, b in zip(offsets, offsets[1:])]
                images = [parse(x) for x in files]
                alike: dict = {}
                for k, image in enumerate(images):
                    alike.setdefault(kind_of(image), []).append(k)
                rows: list = [None] * len(files)
                for kind, own in alike.items():
                    coefs = restarted([images[k] for k in own]) if kind else [coefficients(images[k]) for k in own]
                    for k, c in zip(own, coefs):
                        rows[k] = described(files[k], images[k], c)
                parts = [batch.column(c).slice(first, len(files)) for c in (0, 1)]
                yield pa.record_batch([*parts, *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]], names=names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, DESCRIBED)


def media_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as an image in a table of the shared folder, then describe what is read back from it."""
    return describe(stash(store(df, id_col, text_col), compression="zstd"))
