"""The training-data pipeline: classify, drop near duplicates, decontaminate, mix, shard.

Each stage takes (spark, docs, sf_dir), works on every row of `docs`, and returns a DataFrame that is
written as Parquet and read again for the next one. All but the last return the columns of documents.
Rows are told apart by a fingerprint of id and text, so that null and repeated ids do no harm.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provengine.llm import decontamination, jaccard, mixing, quality, sharding
from provengine.llm.common import dealt, row_key, stash


def _key(docs: DataFrame) -> str:
    """A name that none of the columns begins with."""
    name = "__row_key"
    while any(c.lower().startswith(name) for c in docs.columns):
        name = f"_{name}"
    return name


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(_key(docs), row_key("doc_id", "text"))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """`docs` without the rows whose keys are in `gone` (row_key)."""
    gone = gone.select(F.col("row_key").alias(_key(docs))).distinct()
    return _keyed(docs).join(dealt(gone), _key(docs), "left_anti").select(docs.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among `docs`, rejects go. If none of them is labelled, it
    says so and all stay."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if model is None:
        warnings.warn("no document is labelled, so none is rejected for its quality", stacklevel=2)
    score = _key(docs)
    return quality.score_quality(docs, model, score_col=score).where(F.col(score) >= 0.5).select(docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the row of least id stays; of rows alike in id and text, one."""
    rows = stash(jaccard.near_duplicates(docs).where("n_shingles > 0"))
    chosen = rows.groupBy("component").agg(F.min_by("row_key", F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("kept"))
    rest = _without(docs, rows.join(chosen, "component").where("row_key <> kept"))
    again = stash(rows.groupBy("row_key").count().where("count > 1").select(F.col("row_key").alias(_key(docs))))
    if again.isEmpty():
        return rest
    twice = _keyed(rest).join(dealt(again), _key(docs), "left_semi").dropDuplicates([_key(docs)])
    return _without(rest, again.withColumnRenamed(_key(docs), "row_key")).unionByName(twice.select(docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontamination.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where("contaminated"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, whole: the words taken by its size, rounded."""
    key = _key(docs)
    taken = mixing.mix_sources(docs).where("size > 0")
    copies = taken.select("row_key", F.floor(F.col("taken") / F.col("size") + 0.5).alias("copies"))
    copies = stash(copies.groupBy(F.col("row_key").alias(key)).agg(F.sum("copies").cast("int").alias(f"{key}copies"), F.count("*").alias(f"{key}alike")))
    joined = _keyed(docs).join(dealt(copies.where(F.col(f"{key}copies") > 0)), key)
    once = joined.where(F.col(f"{key}alike") == 1)
    if not copies.where(F.col(f"{key}alike") > 1).isEmpty():  # rows alike are repeated together
        once = once.unionByName(joined.where(F.col(f"{key}alike") > 1).dropDuplicates([key]))
    times = F.sequence(F.lit(1), F.col(f"{key}copies"))
    return once.withColumn(f"{key}time", F.explode(times)).select(docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contiguous shards of near-equal bytes."""
    return sharding.shard_by_bytes(docs)


STAGES = [
    ("quality", keep_good),
    ("near duplicates", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("sharding", shard),
]

#: A trained classifier and a similarity join are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
