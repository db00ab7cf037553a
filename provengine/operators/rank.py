"""Ranking full-text candidates and walking them until one succeeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Orders of preference, and hosts that answer machines with a challenge.
SOURCE_ORDER = ("openalex", "europe_pmc", "unpaywall")
HOST_ORDER = ("publisher", "repository")
VERSION_ORDER = ("publishedversion", "acceptedversion", "submittedversion")
CHALLENGED_HOSTS = ("pmc.ncbi.nlm.nih.gov", "www.ncbi.nlm.nih.gov")


def _place(value: Column, order: tuple[str, ...]) -> Column:
    out = F.when(F.lit(False), 0)
    for k, name in enumerate(order):
        out = out.when(value == name, k)
    return out.otherwise(len(order))


def is_challenged(url) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    host, path = F.lower(F.try_parse_url(url, F.lit("HOST"))), F.try_parse_url(url, F.lit("PATH"))
    return F.coalesce(host.isin(*CHALLENGED_HOSTS) & path.contains("/pdf"), F.lit(False))


def by_document(rows: DataFrame, most: int = 1 << 19) -> DataFrame:
    """Rows dealt by document into so many partitions, by their count, that one holds about `most` rows at most. The sorts of
    a task hold a partition each, and adaptive execution joins partitions only where their number is left to it."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // most))
    return rows.repartition(parts, "document_id")


def rank_candidates(candidates: DataFrame, dealt: bool = False) -> DataFrame:
    """Candidates of each (document, kind) in the order to try them, each url once, with `rank` from 1; `dealt` says that
    they come from `by_document`."""
    keyed = (candidates if dealt else by_document(candidates)).withColumns({"challenged": is_challenged("url").cast("int"), "priority": _place(F.col("source"), SOURCE_ORDER)})
    order = ["challenged", "priority", "offered_index", "url"]
    best = keyed.withColumn("again", F.row_number().over(Window.partitionBy("document_id", "kind", "url").orderBy(*order))).where("again = 1")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("document_id", "kind").orderBy(*order)).cast("long")).drop("again")


def rank_oa_locations(locations: DataFrame) -> DataFrame:
    """The best location first, the others by host type, version and url; repeats of (pdf_url, url) dropped."""
    clean = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    keyed = by_document(locations).withColumns(
        {
            "later": (~F.col("is_best")).cast("int"), "host_rank": F.when(F.col("is_best"), 0).otherwise(_place(clean("host_type"), HOST_ORDER)),
            "version_rank": F.when(F.col("is_best"), 0).otherwise(_place(clean("version"), VERSION_ORDER)), "name": F.coalesce("pdf_url", "url", F.lit("")),
        }
    )
    order = ["later", "host_rank", "version_rank", "name", "offered_index"]
    best = keyed.withColumn("again", F.row_number().over(Window.partitionBy("document_id", "pdf_url", "url").orderBy(*order))).where("again = 1")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("document_id").orderBy(*order)).cast("long")).drop("again", "later", "name")


def fallback_outcome(ranked: DataFrame, stage: Column) -> DataFrame:
    """Walk each document's ranked candidates, stage by stage, to the first that `succeeds`: which won, how many
    were tried, and the last error before it. A url that an earlier stage tried isn't tried again."""
    staged = ranked.withColumn("stage", stage)
    order = Window.partitionBy("document_id").orderBy("stage", "rank", "url")
    once = staged.withColumn("seen", F.row_number().over(Window.partitionBy("document_id", "url").orderBy("stage", "rank"))).where("seen = 1")
    won_at = F.min(F.when(F.col("succeeds"), F.col("step"))).over(Window.partitionBy("document_id"))
    walk = once.withColumn("step", F.row_number().over(order).cast("long")).withColumn("at", won_at)
    won, failed = F.col("step") == F.col("at"), F.col("at").isNull() | (F.col("step") < F.col("at"))
    out = walk.groupBy("document_id").agg(
        F.min_by("url", F.when(won, F.col("step"))).alias("url"), F.min_by("stage", F.when(won, F.col("step"))).alias("stage"),
        F.coalesce(F.first("at"), F.max("step")).alias("tried"), F.max_by("url", F.when(failed, F.col("step"))).alias("last_error_url"),
    )
    return out.select("document_id", "url", "stage", "tried", "last_error_url")
