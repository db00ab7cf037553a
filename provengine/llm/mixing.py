"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks. DataFrame functions only.

A text's size is its number of words. Sources in code-point order (null last) weigh 1, 2, 3, repeating,
unless weights are given by position. A source's target is its weighted share of all words, stopped at
`most` times its own size; what is over is shared again by weight. Seats of equal blocks of words go to the sources by
highest quotients target / (2 * seats + 1), a source having `most` seats for each of its blocks at most: what a full source
can't take goes to the next quotients. This is done for each cumulative number of output shards (the method is
monotone in the number of seats, so differences are the integer quotas of each shard). A block is the least source's words by
`blocks_in_least`, so every source comes within a few words of its target whatever the corpus holds beside it.

A source lays its texts end to end in a seeded order and is cut into pieces, at most `most_pieces` of them and none smaller
than a block; the pieces are laid end to end in a seeded order of their own, and again when all are taken, and the shards take
their quotas' words from that line one after the other, cutting pieces where a quota ends. So each shard has its own seeded
choice, a text is taken by the words of it that stand in them, and the number of pieces doesn't grow with the corpus.

Null or empty texts have size 0 and none taken; repeated rows are texts of their own; a source without
words has target 0; an empty table gives none. Columns beside the three named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prefix_sums, row_key, stash, word_count


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """One row a source: source_rank, source, source_size, weight, target. Windows run over sources, not rows."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    per = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("source_rank", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(cycle, F.col("source_rank") % len(weights) + F.when(F.col("source_rank") % len(weights) == 0, len(weights)).otherwise(0)).cast("long"))
        .withColumn("cap", F.col("source_size") * most)
    )
    # Water filling: with the k sources of least cap / weight stopped, the level is what is left by weight;
    # the first k at which the next source stays below its cap is the answer.
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "source_rank")
    per = (
        per.withColumn("left", F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("fits", F.col("left") * F.col("weight") <= F.col("cap") * F.col("open"))
        .withColumn("place", F.row_number().over(fill))
    )
    first = F.min(F.when(F.col("fits"), F.struct("place", "left", "open"))).over(Window.partitionBy())
    level = per.withColumn("at", first)
    return level.select(
        "source_rank", "source", "source_size", "weight",
        F.when(F.col("at").isNull() | (F.col("place") < F.col("at.place")), F.col("cap").cast("double"))
        .otherwise(F.col("at.left").cast("double") * F.col("weight") / F.col("at.open"))
        .alias("target"),
    )


def sainte_lague(targets: DataFrame, blocks: str, shards: int) -> DataFrame:
    """Quotas: one row for each source and shard, with `seats` of the first (shard + 1) / shards of all blocks,
    and `quota`, this shard's own; no source has more seats than its `most_seats`. Exact: rounding at the common level
    gives all but a few seats; the rest go to the highest of the next quotients, or leave from the lowest of the last ones."""
    house = targets.select("source_rank", "target", "most_seats", F.col(blocks).alias("all_blocks"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    by_shard = Window.partitionBy("shard")
    house = (
        house.withColumn("seats_all", F.expr(f"all_blocks * (shard + 1) div {int(shards)}"))
        .withColumn("whole", F.sum(F.floor(F.col("target"))).over(by_shard) + F.lit(0.0))
        .withColumn("near", F.when(F.col("whole") > 0, F.least(F.col("most_seats").cast("double"), F.floor(F.col("target") * F.col("seats_all") / F.col("whole") + 0.5))).otherwise(0))
        .withColumn("miss", F.col("seats_all") - F.sum("near").over(by_shard))
    )
    # Rounding is off by half a seat a source, so none is off by more than its share of twice as many seats as there are sources.
    far = F.ceil(2 * F.count("*").over(by_shard) * F.col("target") / F.greatest("whole", F.lit(1.0))) + 3
    house = house.withColumn("far", F.least(F.abs("miss"), far).cast("long"))
    steps = house.withColumn("step", F.explode(F.when(F.col("miss") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(1).cast("long"), F.col("far"))))).withColumn(
        "quotient",
        F.when((F.col("miss") > 0) & (F.col("near") + F.col("step") <= F.col("most_seats")), F.col("target") / (2 * (F.col("near") + F.col("step")) - 1))
        .when((F.col("miss") < 0) & (F.col("near") >= F.col("step")), -F.col("target") / (2 * (F.col("near") - F.col("step")) + 1)),
    )
    order = Window.partitionBy("shard").orderBy(F.col("quotient").desc_nulls_last(), F.when(F.col("miss") > 0, F.col("source_rank")).otherwise(-F.col("source_rank")), "step")
    steps = steps.withColumn("won", (F.col("miss") != 0) & F.col("quotient").isNotNull() & (F.row_number().over(order) <= F.abs("miss")))
    seats = steps.groupBy("source_rank", "shard").agg(
        (F.first("near") + F.signum(F.first("miss")) * F.count_if("won")).cast("long").alias("seats")
    )
    before = Window.partitionBy("source_rank").orderBy("shard")
    return seats.withColumn("quota", F.col("seats") - F.coalesce(F.lag("seats").over(before), F.lit(0)))


def taken_ranges(plan: DataFrame, most: int, seed: int) -> DataFrame:
    """source_rank, piece (its place in the source, from 0), shard, low, high: what a shard takes of a piece, as places in the source."""
    pieces = plan.where("source_size > 0").select("source_rank", "source", "wide", "source_size", F.explode(F.expr("sequence(0L, (source_size - 1) div wide)")).alias("piece"))
    length = F.least(F.col("wide"), F.col("source_size") - F.col("piece") * F.col("wide"))
    drawn = pieces.select("source_rank", "piece", length.alias("length"), F.md5(F.concat_ws("\x1f", F.lit(str(seed)), F.coalesce("source", F.lit("")), F.col("piece").cast("string"))).alias("drawn"))
    line = prefix_sums(drawn, ["source_rank", "drawn", "piece"], "length").join(plan.select("source_rank", "base", "source_size", "wide", "cuts"), "source_rank")
    again = line.select("*", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("time")).withColumn("at", F.col("before") - F.col("base") + F.col("time") * F.col("source_size"))

    def of_shard(cut, k):
        low = F.greatest(F.col("at"), F.when(k > 0, F.get("cuts", k - 1)).otherwise(0))
        return F.struct(k.alias("shard"), low.alias("low"), F.least(F.col("at") + F.col("length"), cut).alias("high"))

    shares = again.where(F.col("at") < F.element_at("cuts", -1)).withColumn("share", F.explode(F.filter(F.transform("cuts", of_shard), lambda x: x["low"] < x["high"])))
    move = F.col("piece") * F.col("wide") - F.col("at")
    return shares.select("source_rank", "piece", "share.shard", (F.col("share.low") + move).alias("low"), (F.col("share.high") + move).alias("high"))


def _seeded(seed: int, *cols):
    return F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))


def mix_sources(
    df: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, shards: int = 16, blocks_in_least: int = 1024, most_pieces: int = 4096, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted), quota (blocks of its source), shard_quotas (by
    shard), shard_taken (words by shard), row_key."""
    narrow = stash(
        df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), row_key(id_col, text_col).alias("row_key"), word_count(F.col(text_col)).alias("size"))
    )
    targets = source_targets(narrow, weights, most)
    every = Window.partitionBy()
    before = Window.orderBy("source_rank").rowsBetween(Window.unboundedPreceding, -1)
    targets = stash(
        targets.withColumn("grand", F.sum("source_size").over(every))
        .withColumn("block", F.greatest(F.lit(1), F.expr(f"min(CASE WHEN source_size > 0 THEN source_size END) OVER () div {int(blocks_in_least)}")))
        .withColumn("all_blocks", F.expr("grand div block"))
        .withColumn("base", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("own_blocks", F.expr("(source_size + block - 1) div block"))
        .withColumn("most_seats", F.col("own_blocks") * most)
        .withColumn("wide", F.greatest("block", F.expr(f"(source_size + {int(most_pieces) - 1}) div {int(most_pieces)}")))
    )
    quotas = stash(sainte_lague(targets, "all_blocks", shards))
    listed = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("shard", c))), lambda q: q[c])
    sums = quotas.groupBy("source_rank").agg(F.sum("quota").alias("quota"), listed("quota").alias("shard_quotas"), listed("seats").alias("seats"))
    plan = targets.join(sums, "source_rank").withColumn("cuts", F.transform("seats", lambda n: F.least(n * F.col("block"), F.col("source_size") * most)))
    plan = stash(plan.select("source_rank", "source", "source_size", "target", "wide", "base", "quota", "shard_quotas", "cuts"))
    # The table of sources is written, so its size is known: the planner sends it along only if it is small.
    ranked = narrow.join(plan.select("source", "source_rank"), narrow["source"].eqNullSafe(plan["source"])).select(
        "source_rank", "doc_id", "row_key", "size", _seeded(seed, F.col("doc_id"), F.col("size")).alias("seeded")
    )
    placed = prefix_sums(ranked, ["source_rank", "seeded", "doc_id", "size"], "size").join(plan.select("source_rank", "wide", "base"), "source_rank")
    placed = stash(placed.select("source_rank", "doc_id", "row_key", "size", "index", "wide", (F.col("before") - F.col("base")).alias("at")))
    parts = placed.where("size > 0").select("source_rank", "index", "at", "size", F.explode(F.expr("sequence(at div wide, (at + size - 1) div wide)")).alias("piece"))
    words = F.expr("least(at + size, high) - greatest(at, low)")
    taken = parts.join(taken_ranges(plan, most, seed), ["source_rank", "piece"]).where(words > 0).groupBy("index", "shard").agg(F.sum(words).alias("words"))
    taken = taken.groupBy("index").agg(F.sum("words").alias("taken"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("shard", "words")))).alias("shard_taken"))
    return placed.drop("wide").join(taken, "index", "left").join(plan.select("source_rank", "source", "source_size", "target", "quota", "shard_quotas"), "source_rank").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "quota", "shard_quotas", "shard_taken", "row_key"
    )
