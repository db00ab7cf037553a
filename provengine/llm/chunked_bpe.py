"""Byte-level BPE of texts of any length: overlapping chunks, stitched where their pieces fall in step again.

A text of over `chunk_chars` characters is cut into chunks of that length, each with `overlap` characters of
the next. The chunks are dealt out and split into pieces (pre-tokens) each from its own start. A piece depends
on nothing before it and on two characters after it at most, so as soon as two chunks share one boundary in
their overlap, they share all that follow: each chunk hands over to the next at the first boundary that both
have. What lies between a chunk's two hand-overs is encoded piece by piece, and the ids of a text are put
together in order of its chunks. A text where two chunks share no boundary (one piece is longer than the overlap)
is split into pieces as a whole. Shorter texts are one chunk and need no stitching.

Each piece is encoded by the ranks alone, no special tokens; decoding joins the bytes that ids stand for.
Null texts are empty and have no ids; null and repeated ids of documents are kept, a row each; an empty table
gives none; other columns are ignored. The pattern must match every character and look at most two
characters beyond a match's end, as the pattern of byte-level vocabularies does.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, stash

#: Characters after a piece's end that decide whether it ends there.
LOOKAHEAD = 2


@lru_cache(2)
def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines of base64 and number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class _Merged(dict):
    """Ids of pieces that were met; a new piece is merged by the ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = 400_000):
        super().__init__()
        self.merges = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.most = most

    def __missing__(self, piece: str) -> list[int]:
        if len(self) >= self.most:  # met again, a piece is merged again
            self.clear()
        out = self.merges._encode_single_piece(piece)
        if len(piece) <= 64:
            self[piece] = out
        return out


@lru_cache(2)
def _merged(path: str, pattern: str) -> _Merged:
    return _Merged(read_ranks(path), pattern)


def encode_pieces(pieces: list[str], path: str, pattern: str) -> np.ndarray:
    return np.fromiter(chain.from_iterable(map(_merged(path, pattern).__getitem__, pieces)), dtype=np.int32)


def _id_lists(lists: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(lists) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*lists, np.zeros(0, np.int32)])))


def _row_encoder(path: str, pattern: str):
    """Texts as a whole: (id, text) to (id, ids)."""

    def encode(batches):
        split = regex.compile(pattern).findall
        for batch in batches:
            names, texts = batch.columns
            for at in range(0, len(texts), 256):
                part = texts.slice(at, 256).to_pylist()
                lists = [encode_pieces(split(t or ""), path, pattern) for t in part]
                yield pa.RecordBatch.from_arrays([names.slice(at, 256), _id_lists(lists)], ["id", "ids"])

    return encode


def _cutter(chunk: int, overlap: int):
    """(row, id, text) to chunks of the text, each with the start of the next."""

    def cut(batches):
        for batch in batches:
            rows, names, texts = batch.columns
            for k in range(len(texts)):
                text = texts[k].as_py()
                for at in range(0, len(text), 16 * chunk):
                    own = range(at, min(at + 16 * chunk, len(text)), chunk)
                    here = np.full(len(own), k)
                    parts = [rows.take(pa.array(here)), names.take(pa.array(here)), pa.array([s // chunk for s in own], pa.int64())]
                    bodies = pa.array([text[s : s + chunk + overlap] for s in own])
                    yield pa.RecordBatch.from_arrays([*parts, bodies, pa.array([s + chunk >= len(text) for s in own])], ["row", "id", "chunk", "body", "last"])

    return cut


def _splitter(pattern: str, chunk: int, overlap: int):
    """Chunks to their pieces' ends, and the boundaries (places in the text) where they may take over and hand over."""

    def split(batches):
        find = regex.compile(pattern).findall
        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in ("chunk", "body", "last")}
            ends, head, tail = [], [], []
            for k, body, last in zip(columns["chunk"], columns["body"], columns["last"]):
                own = np.cumsum([len(p) for p in find(body)], dtype=np.int64)
                sure = own if last else own[own + LOOKAHEAD <= len(body)]
                start = k * chunk
                ends.append(own.astype(np.int32))
                head.append(np.concatenate([[start], start + sure[sure <= overlap]]))
                tail.append(start + sure[sure >= chunk])
            lists = [pa.array(x, pa.list_(t)) for x, t in ((ends, pa.int32()), (head, pa.int64()), (tail, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], [*batch.schema.names, "ends", "head", "tail"])

    return split


def _piece_encoder(path: str, pattern: str, chunk: int):
    """Chunks with the places where they take over (`begin`) and hand over (`until`) to the ids between."""

    def encode(batches):
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("chunk", "body", "begin", "until")]
            lists = []
            for k, (number, body, begin, until) in enumerate(zip(*columns)):
                ends = batch.column("ends")[k].values.to_numpy()
                begin = begin - number * chunk
                until = len(body) if until is None else until - number * chunk
                own = [begin, *ends[(ends > begin) & (ends <= until)].tolist()]
                lists.append(encode_pieces([body[a:b] for a, b in zip(own, own[1:])], path, pattern))
            keys = [batch.column(n) for n in ("row", "id", "chunk")]
            yield pa.RecordBatch.from_arrays([*keys, _id_lists(lists)], ["row", "id", "chunk", "ids"])

    return encode


def encode(df: DataFrame, ranks_path: str, pattern: str, chunk_chars: int = 1 << 15, overlap: int = 1 << 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: `id` and `ids`, the ids of its text in order."""
    if not 0 < overlap < chunk_chars:
        raise ValueError("chunks must be longer than their overlap")
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    whole, whole_type = _row_encoder(ranks_path, pattern), f"id {kind}, ids array<int>"
    short = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= chunk_chars).mapInArrow(whole, whole_type)

    long = stash(docs.where(F.length("text") > chunk_chars).select(F.monotonically_increasing_id().alias("row"), "id", "text"), "zstd")
    if long.isEmpty():
        return short
    cut = long.mapInArrow(_cutter(chunk_chars, overlap), f"row long, id {kind}, chunk long, body string, last boolean").repartition("row", "chunk")
    split = stash(cut.mapInArrow(_splitter(pattern, chunk_chars, overlap), f"{_ddl(cut)}, ends array<int>, head array<long>, tail array<long>"), "zstd")

    before = split.where("not last").select("row", (F.col("chunk") + 1).alias("chunk"), "tail")
    meet = F.array_min(F.array_intersect("head", "tail")).alias("begin")
    met = stash(split.where("chunk > 0").select("row", "chunk", "head").join(before, ["row", "chunk"]).select("row", "chunk", meet))
    apart = met.where("begin is null").select("row").distinct()
    ranges = met.unionByName(split.where("chunk = 0").select("row", "chunk", F.lit(0).cast("long").alias("begin")))
    ranges = ranges.join(met.select("row", (F.col("chunk") - 1).alias("chunk"), F.col("begin").alias("until")), ["row", "chunk"], "left")
    ready = split.select("row", "id", "chunk", "body", "ends").join(dealt(ranges), ["row", "chunk"]).join(apart, "row", "left_anti")
    parts = ready.select("row", "id", "chunk", "body", "ends", "begin", "until").mapInArrow(
        _piece_encoder(ranks_path, pattern, chunk_chars), f"row long, id {kind}, chunk long, ids array<int>"
    )
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"]))
    stitched = parts.groupBy("row", "id").agg(joined.alias("ids")).select("id", "ids")
    rest = long.join(apart, "row", "left_semi").select("id", "text").mapInArrow(whole, whole_type)
    return short.unionByName(stitched).unionByName(rest)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """`df` with `decoded`, the bytes that its ids stand for, joined. Null where there are no ids; an id without a token is an error."""

    def join(batches):
        tokens = {rank: token for token, rank in read_ranks(ranks_path).items()}
        for batch in batches:
            lists = batch.column(ids_col)
            out = []
            for k in range(len(lists)):
                ids = lists[k].values
                out.append(None if ids is None else b"".join(map(tokens.__getitem__, ids.to_pylist())))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    return df.mapInArrow(join, f"{_ddl(df)}, decoded binary")
