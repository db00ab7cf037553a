"""What the operators of this subpackage share: scratch tables, prefix sums, byte-level word splitting."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of the word-counting contracts: runs of anything but ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. Where that is unset a local session, as in tests,
    gets one of its own; a cluster without it is an error, since no machine's own folder will do."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-checkpoint-"))
        at = context.getCheckpointDir()
    return at


_TABLES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def stash(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write `df` to a table in the shared folder and read it back: its lineage is cut, and what a
    later job reads is a fact even if executors are lost."""
    path = f"{scratch_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _TABLES[out] = path
    return out


def unstash(*tables: DataFrame) -> None:
    """Delete stashed tables. Only for those of which all that was derived is itself stashed, so that no retry reads them."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(_TABLES.pop(table))
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def dealt(table: DataFrame) -> DataFrame:
    """A side that grows with the corpus, in a join with whole texts: both sides are dealt by key, whatever their size,
    so what is measured on a small corpus is the plan of a large one."""
    return table.hint("merge")


def prefix_sums(df: DataFrame, order: list[str], size: str) -> DataFrame:
    """Add `before` (sum of `size` over all rows that come earlier in `order`) and `index` (their number).

    The rows are range-partitioned and sorted; each partition's total goes through a window over one
    row a partition, and a second window runs inside each partition. No task holds more than one range.
    The sorted rows are stashed first, so that both windows see the same partitions on any retry.
    Rows alike in all of `order` are interchangeable. Pass narrow rows: they are written once.
    """
    placed = stash(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumns({"part": F.spark_partition_id(), "pos": F.monotonically_increasing_id()})
    )
    totals = placed.groupBy("part").agg(F.sum(size).alias("part_size"), F.count("*").alias("part_rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "part",
        F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("part_before"),
        F.coalesce(F.sum("part_rows").over(earlier), F.lit(0)).alias("part_index"),
    )
    inside = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumns(
            {"in_before": F.coalesce(F.sum(size).over(inside), F.lit(0)), "in_index": F.row_number().over(Window.partitionBy("part").orderBy("pos")) - 1}
        )
        .join(F.broadcast(totals), "part")  # one row a partition: bounded by the number of shuffle partitions
        .withColumns({"before": F.col("part_before") + F.col("in_before"), "index": F.col("part_index") + F.col("in_index")})
        .drop("part", "pos", "part_before", "part_index", "in_before", "in_index")
    )


def row_key(id_col: str, text_col: str) -> Column:
    """64 bits that tell rows apart by id and text, whatever their types; a null text counts as empty."""
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


# --- numpy helpers that run inside tasks -------------------------------------------------------

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**0 .. BASE**(n-1) modulo 2**64, or those of its inverse."""
    key = "inv" if inverse else "pow"
    if key not in _POWERS or len(_POWERS[key]) < n:
        out = np.full(max(n, 1 << 16), np.uint64(_BASE_INV if inverse else _BASE), dtype=np.uint64)
        out[0] = 1
        _POWERS[key] = np.multiply.accumulate(out)
    return _POWERS[key][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of (byte + 1) * BASE**k over i <= k < j; length len(data) + 1."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Scrambled polynomial hashes of the spans [start, end), the same wherever a span stands."""
    inv = powers(len(prefix), inverse=True)
    return mix(((prefix[end] - prefix[start]) * inv[start]) ^ ((end - start).astype(np.uint64) * _MULT))


def text_chunks(texts: list, most: int = 2_000_000):
    """(first row, offsets, bytes) of runs of texts of about `most` bytes; a longer text is a run of its own. Null: empty."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t for t in texts]
    first, held = 0, 0
    for i, t in enumerate(raw):
        if held and held + len(t) > most:
            yield first, *_joined(raw[first:i])
            first, held = i, 0
        held += len(t)
    if first < len(raw):
        yield first, *_joined(raw[first:])


def raw_bytes(column: pa.Array, most: int = 2_000_000):
    """The same for a column of binary values without nulls, out of its own memory."""
    n = len(column)
    if not n:
        return
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=wide)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, offsets[at : to + 1] - offsets[at], data[offsets[at] : offsets[to]]
        at = to


def _joined(raw: list[bytes]):
    offsets = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in raw], out=offsets[1:])
    return offsets, np.frombuffer(b"".join(raw), dtype=np.uint8)


def words(offsets: np.ndarray, data: np.ndarray):
    """(start, end, owning text) of every word; words never cross texts."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    black = ~((data == 32) | ((data >= 9) & (data <= 13)))
    prev = np.empty_like(black)
    prev[0], prev[1:] = False, black[:-1]
    cuts = offsets[1:-1][offsets[1:-1] < len(data)]
    prev[cuts] = False
    start = np.flatnonzero(black & ~prev)
    nxt = np.empty_like(black)
    nxt[-1], nxt[:-1] = False, black[1:]
    nxt[cuts[cuts > 0] - 1] = False
    end = np.flatnonzero(black & ~nxt) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def lowered(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def grouped(key: str, columns: list[str]):
    """Turn the batches of a partition sorted by `key` into (key, {column: rows}) of each run."""

    def groups(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            keys = held[key].to_numpy()
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            if len(cuts):
                done, held = held.slice(0, cuts[-1]), held.slice(cuts[-1])
                keys, at = keys[: cuts[-1]], 0
                rows = {c: done[c].to_pylist() if pa.types.is_binary(done[c].type) else done[c].to_numpy() for c in columns}
                for cut in cuts:
                    yield keys[at], {c: v[at:cut] for c, v in rows.items()}
                    at = cut
        if held is not None and held.num_rows:
            yield held[key][0].as_py(), {c: held[c].to_pylist() if pa.types.is_binary(held[c].type) else held[c].to_numpy() for c in columns}

    return groups
