"""Benchmark decontamination: prefix-filtered join of word shingles. DataFrame functions only.

Words are lower-cased (A-Z) runs of ASCII letters, digits and anything beyond ASCII. Every run of
`window` words of an item is a window; a shorter item with words is one window of its own. A window has
shingles of `shingle` words (a shorter window is one shingle). All places of the corpus that hold a
shingle of the benchmark are found in one pass; counted, they give each shingle's rarity. A text that
holds a window must hold each of its shingles, so the rarest one is a prefix that suffices: its places
give candidate windows, bounded by the text's length and the shingle's place in the window, and a
candidate is verified by finding each other shingle of the window at its own place.

Null texts have no words, and are in no result but with zeroes; null and repeated ids are kept row by
row (rows alike in id and text share one verdict); empty tables give no rows or no hits; columns beside
those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, row_key, stash

GAP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"  # of texts in either case


def _lowered(word: Column) -> Column:
    """A-Z in lower case: by lower() where there is nothing else for it to change."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(ascii_lower(word))


def item_words(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(text, GAP), ""), _lowered)


def _codes(text: Column) -> Column:
    """Fingerprints of the words, in place order."""
    return F.transform(F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), GAP), ""), lambda w: F.xxhash64(_lowered(w)))


def _token(codes: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(codes, at + k) for k in range(size)])


def _shingles(codes: Column, size: int) -> Column:
    """Fingerprints of each run of `size` words, in place order."""
    at = F.sequence(F.lit(0), F.size(codes) - size)
    return F.when(F.size(codes) >= size, F.transform(at, lambda i: _token(codes, i, size)))


def _places(codes: Column, sizes: list[int]) -> Column:
    """(place, token) of each run of each size, and before them a row of place -1, which every text has."""
    out = [F.array(F.struct(F.lit(-1).alias("place"), F.lit(None).cast("long").alias("token")))]
    for k in sizes:
        at = F.when(F.size(codes) >= k, F.sequence(F.lit(0), F.size(codes) - k)).otherwise(F.array().cast("array<int>"))
        out.append(F.transform(at, _placed(codes, k)))
    return F.concat(*out)


def _placed(codes: Column, size: int):
    return lambda i: F.struct(i.alias("place"), _token(codes, i, size).alias("token"))


def benchmark_windows(items: DataFrame, window: int, shingle: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(windows: window_id, length, shingle size, shingles), (members: window_id, item_id); a window is there once."""
    words = items.select(F.col(id_col).alias("item_id"), F.explode(F.array(item_words(F.col(text_col)))).alias("words")).where(F.size("words") > 0)
    spread = words.withColumn("length", F.least(F.size("words"), F.lit(window))).withColumn(
        "start", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("length")))
    )
    each = spread.select(
        "item_id", "length", F.explode(F.array(F.slice("words", F.col("start") + 1, F.col("length")))).alias("words")
    ).withColumn("window_id", F.sha2(F.array_join("words", " "), 256))
    members = stash(each.select("window_id", "item_id").distinct())
    codes = F.transform("words", lambda w: F.xxhash64(w))
    ladder = None
    for k in range(1, shingle + 1):  # a window shorter than a shingle is one shingle
        fits = (F.col("length") == k) if k < shingle else (F.col("length") >= k)
        ladder = F.when(fits, _shingles(F.col("codes"), k)) if ladder is None else ladder.when(fits, _shingles(F.col("codes"), k))
    windows = stash(
        each.dropDuplicates(["window_id"]).select("window_id", "length", F.explode(F.array(codes)).alias("codes")).select("window_id", "length", F.least("length", F.lit(shingle)).alias("size"), ladder.alias("shingles"))
    )
    return windows, members


def find_contamination(
    docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 4,
    id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted as strings), contaminated, row_key: one row a row of `docs`."""
    windows, members = benchmark_windows(items, window, shingle, item_id_col, item_text_col)
    own = windows.select("window_id", "length", "size", F.posexplode("shingles").alias("offset", "token"))
    tokens = stash(own.select("token").distinct())
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most `shingle` numbers

    keyed = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    # The one pass over the texts. explode() of one array keeps the fingerprints as a column, where they would be made anew for each shingle.
    read = keyed.select("doc_id", "row_key", F.explode(F.array(_codes(F.col("text")))).alias("codes"))
    read = read.select("doc_id", "row_key", F.size("codes").alias("n_words"), F.inline(_places(F.col("codes"), sizes)))
    # The benchmark's tokens are written, so their size is known: sent along only if small, else both sides are dealt by token;
    # so the row of a document itself, which has none, gets a number of its own.
    read = read.withColumn("token", F.coalesce("token", "row_key"))
    kept = stash(read.join(tokens.withColumn("there", F.lit(True)), "token", "left").where("there OR place = -1").drop("there"))
    places = kept.where("place >= 0")

    rarity = places.groupBy("token").count()
    prefix = (
        own.join(rarity, "token")
        .groupBy("window_id")
        .agg(F.min(F.struct("count", "token", "offset")).alias("rarest"), F.first("length").alias("length"), F.count("*").alias("seen"), F.first("size").alias("size"))
        .where(F.col("seen") == F.col("length") - F.col("size") + 1)  # a shingle that is nowhere: the window is nowhere
        .select("window_id", "length", "size", F.col("rarest.token").alias("token"), F.col("rarest.offset").alias("offset"))
    )
    prefix = stash(prefix)
    candidates = (
        places.join(prefix, "token")
        .withColumn("start", F.col("place") - F.col("offset"))
        .where((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n_words")))
        .select("doc_id", "row_key", "start", "window_id", "length", "size")
        .distinct()
    )
    wanted = candidates.join(own.select("window_id", "offset", "token"), "window_id").withColumn("place", F.col("start") + F.col("offset"))
    there = places.select("row_key", F.col("doc_id").alias("there_id"), "place", "token").distinct()
    hits = (
        wanted.join(there, (wanted["row_key"] == there["row_key"]) & (wanted["place"] == there["place"]) & (wanted["token"] == there["token"]) & wanted["doc_id"].eqNullSafe(there["there_id"]))
        .groupBy(wanted["row_key"], "doc_id", "start", "window_id", "length", "size")
        .count()
        .where(F.col("count") == F.col("length") - F.col("size") + 1)
    )
    hits = stash(hits.select("row_key", "doc_id", "start", "length", "window_id"))
    covered = (
        hits.select("row_key", "doc_id", "start", "length").distinct()
        .select("row_key", "doc_id", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("place"))
        .distinct().groupBy("row_key", "doc_id").agg(F.count("*").alias("n_hit"))
    )
    by_item = (
        hits.select("row_key", "doc_id", "window_id").distinct().join(members, "window_id")
        .select("row_key", "doc_id", F.col("item_id").cast("string").alias("item_id")).distinct()
        .groupBy("row_key", "doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    )
    verdict = stash(
        covered.join(by_item, (covered["row_key"] == by_item["row_key"]) & covered["doc_id"].eqNullSafe(by_item["doc_id"]))
        .select(covered["row_key"], covered["doc_id"].alias("hit_id"), "n_hit", "items")
    )
    counts = kept.where("place = -1").select("doc_id", "row_key", F.col("n_words").cast("long").alias("n_words"))
    return counts.join(verdict, (counts["row_key"] == verdict["row_key"]) & counts["doc_id"].eqNullSafe(verdict["hit_id"]), "left").select(
        "doc_id", "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        counts["row_key"],
    )
