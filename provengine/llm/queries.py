"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat,
    chunked_bpe,
    decontamination,
    exact_substrings,
    fuzzy_substrings,
    jaccard,
    media,
    mixing,
    oracles,
    periodic_runs,
    quality,
    sharding,
    tokens,
    whitening,
)
from .common import WORD


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"))
    return out.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], rows.schema)
    out = chat.read_back(chat.format_reply_trees(chat.turns_as_tree(rows.unionByName(extra))))
    turns = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("texts").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.5).cast("int").alias("predicted"),
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_shard = F.array_join(F.transform("shard_quotas", lambda q: q.cast("string")), ",").alias("shard_quotas")
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "quota", by_shard)


def op6_exact_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last column counts words in repeated passages of more than 50 words, which may have less than 400 bytes."""
    out = exact_substrings.remove_repeats(_table(spark, sf_dir, "documents"), passage=51)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("repeats"), "repeated_words")


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read_shards(tokens.write_shards(_table(spark, sf_dir, "documents"), "byte_bpe_50k.json", end_id=2), end_id=2)


def op8_fuzzy_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_substrings.both_ways(fuzzy_substrings.shared_passages(_table(spark, sf_dir, "documents")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(_table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = whitening.on_grid(_table(spark, sf_dir, "embeddings"), "embedding", "vec_id")
    return whitening.whiten(grid, whitening.fit_whitening(grid)).withColumnRenamed("id", "vec_id")


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth document by the checksum of its id is given a run first: from word a on, p words repeat."""
    check = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(check % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})")))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.floor(check / 10).alias("g"), words.alias("words"))
    n, g, a, p = F.size("words"), F.col("g"), F.col("a"), F.col("p")
    docs = docs.withColumn("a", F.when(n > 0, g % n)).withColumn("p", 1 + F.floor((n - a) / (3 + g % 8)))
    cycle = F.slice("words", (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(cycle, F.ceil((n - a) / p).cast("int"))), 1, (n - a).cast("int"))
    planted = F.array_join(F.concat(F.slice("words", 1, a.cast("int")), tail), " ")
    runs = periodic_runs.find_runs(docs.select("doc_id", F.when(n > 0, planted).otherwise(F.col("text")).alias("text")))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("often"))))
    return runs.withColumn("best", best).select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.back")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.often")).alias("period"),
        F.floor(F.col("best.length") * 1000 / -F.col("best.often")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = chunked_bpe.encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return chunked_bpe.decode(encoded, ranks).select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_jaccard": op2_jaccard,
    "op3_chat": op3_chat,
    "op4_quality": op4_quality,
    "op5_mixing": op5_mixing,
    "op6_exact_substrings": op6_exact_substrings,
    "op7_tokens": op7_tokens,
    "op8_fuzzy_substrings": op8_fuzzy_substrings,
    "op9_decontamination": op9_decontamination,
    "op10_media": op10_media,
    "op11_whitening": op11_whitening,
    "op12_runs": op12_runs,
    "op13_chunked_bpe": op13_chunked_bpe,
}

ORACLES = {"op2_jaccard": oracles.JACCARD, "op3_chat": oracles.CHAT, "op5_mixing": oracles.MIXING, "op9_decontamination": oracles.DECONTAMINATION}
