"""N-gram Jaccard join over count vectors in R-trees.

A document's set holds its distinct runs of `k` words (fingerprints of 64 bits); with fewer words, the whole
sequence as one. Documents link when |A and B| * 100 >= threshold * |A or B|. The steps:

1. One pass gives each document its set's digest, size and count vector: tokens hashed into `groups`
   groups, and the number in each group is a coordinate. Equal sets become one node. Each task also counts its tokens
   in 2**22 buckets; added up in a tree and told by their logarithm, they are 4 MB whatever the corpus.
2. Blocks. Ordered by how full a token's bucket is, rarest first, then by fingerprint, two linked sets share a token among
   the first n - ceil(t * n) + 1 of either. So passages that many texts share come last, and make no blocks. Tokens that one node alone has are dropped; equal lists of nodes become one block. A block
   whose sets are too large together is dealt into pairs of tiles, so a task holds two tiles at most.
3. In each block the points go into an R-tree (packed by size and coordinates, boxes over sums of
   coordinates); it is joined with itself from the root down. Of two boxes, the sum of the coordinate minima of their upper corners bounds any
   overlap inside, and a pair of boxes is opened only if the bound reaches what the threshold asks of
   their smallest sizes. All nodes that surviving pairs connect, in any block, form a candidate group.
4. Only nodes of candidate groups have their sets built again and sent, once, to their group (a group too
   large for a task: to pairs of tiles of it). There each pair of nodes whose sizes allow a link is intersected
   exactly, so every link is found, and found once: pairs inside a tile are left to the tile's meeting with itself.
   Written are each node's number of links and, for the components, an edge from the first node it is connected to.
5. These edges become components by least labels with pointer jumping, through written tables.
6. A document's links are those of its node to other nodes, each as often as the other has copies, and those to
   its own node's other copies.

One R-tree over the whole corpus can't be dealt out without comparing all boxes: random count vectors lie
about equally far apart, so the boxes of unrelated sets overlap. Step 2 is exact and loses no link.

Null or empty texts, and texts without words, have empty sets, and are their own components. Rows that
repeat an id are rows of their own; the component's id is the least id in it, null only if all are null.
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, grouped, lowered, mix, prefix_hash, row_key, span_hash, stash, text_chunks, unstash, words


def shingle_sets(texts: list, k: int = 5):
    """For each text in turn, the sorted array of its set's fingerprints."""
    for _, offsets, data in text_chunks(texts):
        low = lowered(data)
        start, end, owner = words(offsets, low)
        hashes = span_hash(prefix_hash(low), start, end) if len(start) else np.zeros(0, dtype=np.uint64)
        ends = np.searchsorted(owner, np.arange(len(offsets) - 1), side="right")
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        if len(hashes) >= k:
            runs = hashes[: len(hashes) - k + 1].copy()
            for j in range(1, k):
                runs = mix(runs) ^ hashes[j : len(hashes) - k + 1 + j]
            runs = mix(runs)
        for a, b in zip(begins, ends):
            if b - a >= k:
                yield np.unique(runs[a : b - k + 1])
            elif b > a:
                one = np.uint64(b - a)
                for h in hashes[a:b]:
                    one = mix(np.array([one ^ h]))[0]
                yield np.array([one], dtype=np.uint64)
            else:
                yield np.zeros(0, dtype=np.uint64)


def _nodes(df: DataFrame, k: int, groups: int) -> DataFrame:
    """doc_id, row_key, n, node (64 bits of the set's digest; null without a set), point (group counts); and one row a task with the
    `counts` of its tokens by bucket, n = -1."""

    def run(batches):
        names = ["doc_id", "row_key", "n", "node", "point", "counts"]
        counts = np.zeros(1 << BUCKET_BITS, dtype=np.uint32)
        for batch in batches:
            for from_ in range(0, batch.num_rows, 1000):
                part = batch.slice(from_, 1000)
                sizes, nodes, points = [], [], []
                for tokens in shingle_sets(part.column(1).to_pylist(), k):
                    sizes.append(len(tokens))
                    nodes.append(_node(tokens))
                    points.append(_point(tokens, groups) if len(tokens) else None)
                    np.add.at(counts, bucket_of(tokens), 1)
                yield pa.record_batch([part.column(0), part.column(2), pa.array(sizes, pa.int32()), pa.array(nodes, pa.int64()), pa.array(points, pa.binary()), pa.nulls(len(sizes), pa.binary())], names=names)
        none = pa.nulls(1, pa.int64())
        yield pa.record_batch([none, none, pa.array([-1], pa.int32()), none, pa.nulls(1, pa.binary()), pa.array([zstandard.compress(counts.tobytes(), 1)])], names=names)

    return df.mapInArrow(run, "doc_id long, row_key long, n int, node long, point binary, counts binary")


#: Buckets in which tokens are counted: a byte each when told to all tasks.
BUCKET_BITS = 22


def bucket_of(tokens: np.ndarray) -> np.ndarray:
    return ((tokens * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _fullness(counted: DataFrame, fan: int = 32) -> np.ndarray:
    """Of each bucket, four times the logarithm of its tokens: the tasks' counts, added up `fan` at a time."""

    def add(batches):
        total = np.zeros(1 << BUCKET_BITS, dtype=np.uint32)
        for batch in batches:
            for one in batch.column(0):
                more = np.frombuffer(zstandard.decompress(one.as_py()), dtype=np.uint32)
                total = np.where(total > ~more, ~np.uint32(0), total + more)
        yield pa.record_batch([pa.array([zstandard.compress(total.tobytes(), 1)])], names=["counts"])

    left = counted.count()
    while left > 1:
        left = -(-left // fan)
        counted = counted.repartition(left).mapInArrow(add, "counts binary")
    rows = counted.collect()  # one
    total = np.frombuffer(zstandard.decompress(rows[0]["counts"]), dtype=np.uint32) if rows else np.zeros(1 << BUCKET_BITS, dtype=np.uint32)
    return np.rint(4 * np.log2(total + 1.0)).astype(np.uint8)


def _node(tokens: np.ndarray) -> int | None:
    return int.from_bytes(hashlib.md5(tokens.tobytes()).digest()[:8], "little", signed=True) if len(tokens) else None


def _point(tokens: np.ndarray, groups: int) -> bytes:
    """Compressed counts by group; the group comes of other bits than the order of step 2."""
    counts = np.bincount(((tokens * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)).astype(np.int64) % groups, minlength=groups)
    kind = next(k for k in "BHI" if counts.max() <= np.iinfo(k).max)
    return kind.encode() + zstandard.compress(counts.astype(kind).tobytes(), 1)


def _counts(point: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(point[1:]), dtype=chr(point[0]))


def _prefixes(df: DataFrame, k: int, threshold: int, fullness: np.ndarray) -> DataFrame:
    """token, node: the tokens that a linked set must share, once for each node of a batch."""
    sent = df.sparkSession.sparkContext.broadcast(fullness)  # 4 MB

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for from_ in range(0, batch.num_rows, 1000):
                tokens, nodes = [], []
                for got in shingle_sets(batch.column(0).slice(from_, 1000).to_pylist(), k):
                    node = _node(got)
                    if node is None or node in seen:
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(node)
                    first = rarest_first(got, sent.value)[: len(got) - -(-threshold * len(got) // 100) + 1]
                    tokens.append(first)
                    nodes.append(np.full(len(first), node, dtype=np.int64))
                if tokens:
                    yield pa.record_batch([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(nodes))], names=["token", "node"])

    return df.select("text").mapInArrow(run, "token long, node long")


def rarest_first(tokens: np.ndarray, fullness: np.ndarray) -> np.ndarray:
    """Sorted tokens in the order of their buckets' fullness, then their own: the same for any two sets."""
    return tokens[np.argsort(fullness[bucket_of(tokens)], kind="stable")]


def _needed(a, b, threshold: int):
    """The least overlap that links sets of sizes a and b."""
    return -(-threshold * (a + b) // (100 + threshold))


class RTree:
    """Points packed by size, then by coordinates; `boxes[level]` holds upper corners, level 0 the points.

    Boxes are kept for coordinates summed up to `coarse` of them, which bounds overlap as well, if less
    tightly; points that pass there are bounded by all their coordinates."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, fan: int = 8, coarse: int = 64):
        few = points.reshape(len(points), coarse, -1).sum(axis=2, dtype=np.int32) if points.shape[1] % coarse == 0 else points
        order = np.lexsort((few[:, 1], few[:, 0], sizes))
        self.order, self.fan, self.fine = order, fan, points[order]
        self.boxes, self.low, self.high = [few[order]], [sizes[order].astype(np.int64)], [sizes[order].astype(np.int64)]
        while len(self.boxes[-1]) > 1:
            at = np.arange(0, len(self.boxes[-1]), fan)
            self.boxes.append(np.maximum.reduceat(self.boxes[-1], at, axis=0))
            self.low.append(np.minimum.reduceat(self.low[-1], at))
            self.high.append(np.maximum.reduceat(self.high[-1], at))

    @staticmethod
    def _bounded(boxes: np.ndarray, i: np.ndarray, j: np.ndarray, least: np.ndarray, step: int = 10_000):
        """The pairs whose summed minima reach `least`."""
        keep = [np.minimum(boxes[i[a : a + step]], boxes[j[a : a + step]]).sum(axis=1, dtype=np.int64) >= least[a : a + step] for a in range(0, len(i), step)]
        keep = np.concatenate(keep) if keep else np.zeros(0, dtype=bool)
        return i[keep], j[keep], least[keep]

    def self_join(self, threshold: int, most: int = 20_000):
        """Yield arrays (i, j), i before j, of points whose bound allows a link."""
        waiting = [(len(self.boxes) - 1, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
        while waiting:
            level, i, j = waiting.pop()
            if len(i) > most:
                waiting += [(level, i[most:], j[most:]), (level, i[:most], j[:most])]
                continue
            if level == 0:
                i, j = i[i < j], j[i < j]
            low, high = self.low[level], self.high[level]
            fits = (100 * high[i] >= threshold * low[j]) & (100 * high[j] >= threshold * low[i])
            i, j = i[fits], j[fits]
            i, j, least = self._bounded(self.boxes[level], i, j, _needed(low[i], low[j], threshold))  # no pair inside may do with less
            if level == 0:
                i, j, _ = self._bounded(self.fine, i, j, least, 2_000)
                yield self.order[i], self.order[j]
            elif len(i):
                size = len(self.boxes[level - 1])
                a, b = np.divmod(np.arange(self.fan * self.fan), self.fan)
                ci, cj = (i[:, None] * self.fan + a).ravel(), (j[:, None] * self.fan + b).ravel()
                real = (ci < size) & (cj < size) & (ci <= cj)
                waiting.append((level - 1, ci[real], cj[real]))


class _Sets:
    """Union-find by array."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Least labels with pointer jumping, until nothing changes."""
        while True:
            a, b = self.up[i], self.up[j]
            differ = a != b
            if not differ.any():
                return
            np.minimum.at(self.up, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
            while True:
                further = self.up[self.up]
                if (further == self.up).all():
                    break
                self.up = further


def _candidates(blocks: DataFrame, threshold: int) -> DataFrame:
    """a, b: from the least node of each group that surviving pairs of an R-tree connect to the others."""

    def run(batches):
        first, other = [], []

        def flush():
            return pa.record_batch([pa.array(np.concatenate(first)), pa.array(np.concatenate(other))], names=["a", "b"])

        for _, rows in grouped("block", ["node", "n", "point"])(batches):
            nodes = rows["node"]
            if len(nodes) < 2:
                continue
            points = np.stack([_counts(p) for p in rows["point"]])
            sets = _Sets(len(nodes))
            for i, j in RTree(points, rows["n"]).self_join(threshold):
                sets.join(i, j)
            linked = np.flatnonzero(sets.up != np.arange(len(nodes)))
            if len(linked):
                first.append(nodes[sets.up[linked]])
                other.append(nodes[linked])
            if sum(map(len, other)) > 50_000:
                yield flush()
                first, other = [], []
        if other:
            yield flush()

    return blocks.select("block", "node", "n", "point").mapInArrow(run, "a long, b long")


def _tiles(members: DataFrame, block: str, tile_tokens: int) -> DataFrame:
    """node, tile, own, `block`: blocks whose sets are too large together become pairs of tiles; a tile meets each tile, itself included (`own`)."""
    weights = stash(members.groupBy(block).agg(F.ceil(F.sum("n") / tile_tokens).alias("tiles")))  # written: a large block's rows can then be split in the join
    dealt = members.join(weights, block).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")))
    pair = lambda t: F.struct(F.xxhash64(F.col(block), F.least(t, F.col("tile")), F.greatest(t, F.col("tile"))).alias("pair"), (t == F.col("tile")).alias("own"))
    met = dealt.select("node", "tile", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), pair)).alias("met"))
    return met.select("node", "tile", F.col("met.own").alias("own"), F.col("met.pair").alias(block))


def _linked(tokens: np.ndarray, begins: np.ndarray, sizes: np.ndarray, first: int, threshold: int):
    """Yield (i, array of j) of all linked pairs of sets: of any two if `first` is 0, else of those before `first` with the others.

    tokens: all sets' tokens end to end, as small integers, set i from begins[i]; sets ordered by size before and from `first`."""
    n = len(sizes)
    inside = np.zeros(int(tokens.max()) + 1 if len(tokens) else 1, dtype=bool)
    least = first + np.searchsorted(sizes[first:], -(-threshold * sizes // 100), side="left")
    most = first + np.searchsorted(sizes[first:], 100 * sizes // threshold, side="right")
    for i in range(first or n):
        low, high = max(i + 1, int(least[i])), int(most[i])
        if low >= high:
            continue
        own = tokens[begins[i] : begins[i + 1]]
        inside[own] = True
        total = np.concatenate([[0], np.cumsum(inside[tokens[begins[low] : begins[high]]])])
        inside[own] = False
        at = begins[low : high + 1] - begins[low]
        hit = np.flatnonzero(total[at[1:]] - total[at[:-1]] >= _needed(sizes[i], sizes[low:high], threshold))
        if len(hit):
            yield i, low + hit


def _links(groups: DataFrame, threshold: int) -> DataFrame:
    """a, b, links: of each linked node b, the first node a of its group that it is connected to (may be b), and the number
    of copies of nodes that it links to. Rows of b from several groups add up."""

    def run(batches):
        for _, rows in grouped("grp", ["node", "tokens", "copies", "tile", "own"])(batches):
            sizes = np.array([len(x) // 8 for x in rows["tokens"]], dtype=np.int64)
            own = bool(rows["own"][0])
            order = np.lexsort((sizes, np.zeros(len(sizes)) if own else rows["tile"]))
            nodes, copies, sizes = rows["node"][order], rows["copies"][order], sizes[order]
            first = 0 if own else int((rows["tile"] == rows["tile"].min()).sum())
            if first == len(nodes):  # the other tile is empty
                continue
            _, codes, counts = np.unique(np.frombuffer(b"".join([rows["tokens"][i] for i in order]), dtype=np.uint64), return_inverse=True, return_counts=True)
            shared = counts[codes] > 1
            begins = np.searchsorted(np.repeat(np.arange(len(nodes)), sizes)[shared], np.arange(len(nodes) + 1))
            sets, links, held, left, right = _Sets(len(nodes)), np.zeros(len(nodes), dtype=np.int64), 0, [], []

            def flush():
                if left:
                    sets.join(np.concatenate(left), np.concatenate(right))

            for i, j in _linked(codes[shared], begins, sizes, first, threshold):
                links[i] += copies[j].sum()
                links[j] += copies[i]
                left.append(np.full(len(j), i))
                right.append(j)
                held += len(j)
                if held > 1_000_000:
                    flush()
                    held, left, right = 0, [], []
            flush()
            some = np.flatnonzero(links)
            if len(some):
                yield pa.record_batch([pa.array(nodes[sets.up[some]]), pa.array(nodes[some]), pa.array(links[some])], names=["a", "b", "links"])

    return groups.select("grp", "node", "tokens", "copies", "tile", "own").mapInArrow(run, "a long, b long, links long")


def connected_components(links: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for each node that `links` (a, b) names.

    Each round hands every node the least label next to it, then takes the label of that label; the
    labels are written each round, and the rounds end when none has changed."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("next")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("next")))
    both = stash(both.where("node <> next").distinct())
    labels = stash(both.groupBy("node").agg(F.least(F.col("node"), F.min("next")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("next"), "label"), "next").groupBy("node").agg(F.min("label").alias("near"))
        lower = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = stash(lower.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")))
        changed = new.where("old <> label").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


def _members(postings: DataFrame, nodes: DataFrame) -> DataFrame:
    """block, node, n: nodes that share a token of their prefixes; equal lists of nodes are one block."""
    # Counts are written, so that the join with them is one of two plain exchanges, in which a frequent token's rows can be split.
    shared = stash(postings.groupBy("token").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("token"))
    # Lists of nodes: a token's list is known by its length and the combined hash of its nodes.
    lists = stash(postings.join(shared, "token").select("token", "node").distinct())
    named = stash(lists.groupBy("token").agg(F.xxhash64(F.count("*"), F.bit_xor(F.xxhash64("node")), F.min("node"), F.max("node")).alias("block")))
    members = stash(lists.join(named, "token").select("block", "node").distinct().join(nodes.select("node", "n"), "node"))
    unstash(shared, named, lists)
    return members


def near_duplicates(df: DataFrame, k: int = 5, threshold: int = 80, groups: int = 1024, tile_tokens: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, component (null without a set), row_key, n_links (rows of `df` it links to): one row a row of `df`."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), row_key(id_col, text_col).alias("row_key"))
    counted = stash(_nodes(docs, k, groups))
    rows = counted.where("n >= 0").drop("counts")
    nodes = stash(rows.where("node IS NOT NULL").groupBy("node").agg(F.first("n").alias("n"), F.first("point").alias("point"), F.count("*").alias("copies")))

    members = _members(_prefixes(docs, k, threshold, _fullness(counted.where("n < 0").select("counts"))), nodes)
    blocks = _tiles(members, "block", tile_tokens).join(nodes, "node").repartition("block").sortWithinPartitions("block")
    # A node may be in many blocks; its set is sent once, to the group of all that surviving pairs connect.
    pairs = stash(_candidates(blocks, threshold).distinct())
    unstash(members)
    candidates = stash(connected_components(pairs).join(nodes.select("node", "n", "copies"), "node"))

    wanted = rows.join(candidates.select("node"), "node").groupBy("node").agg(F.min("row_key").alias("row_key")).select("row_key").distinct()
    texts = docs.select("row_key", "text").join(dealt(wanted), "row_key", "left_semi").select("text")

    def sets(batches):
        for batch in batches:
            for from_ in range(0, batch.num_rows, 1000):
                got = list(shingle_sets(batch.column(0).slice(from_, 1000).to_pylist(), k))
                yield pa.record_batch([pa.array([_node(t) for t in got], pa.int64()), pa.array([t.tobytes() for t in got], pa.binary())], names=["node", "tokens"])

    built = texts.mapInArrow(sets, "node long, tokens binary").dropDuplicates(["node"])
    brought = _tiles(candidates.withColumnRenamed("label", "grp"), "grp", tile_tokens).join(candidates.select("node", "copies"), "node").join(built, "node").repartition("grp").sortWithinPartitions("grp")
    links = stash(_links(brought, threshold))
    labels = connected_components(links.select("a", "b"))

    labelled = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    linked = nodes.select("node", "copies").join(links.groupBy(F.col("b").alias("node")).agg(F.sum("links").alias("links")), "node", "left")
    labelled = labelled.join(linked.select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "node", "left")
    least = labelled.where("node IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    out = labelled.select("doc_id", "row_key", "n", "label", "n_links").join(least, "label", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.col("label").alias("component"), "row_key", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
