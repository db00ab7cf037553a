"""Reading provider pages, ledger tables and corpus files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One page a line: `raw`."""
    return spark.read.text(path).withColumnRenamed("value", "raw")


def split_pages(pages: DataFrame, id_path: str = "$.id") -> tuple[DataFrame, DataFrame]:
    """(records: page columns, place, record; rejects: page columns, reason). A page must be an object whose
    `results` is a list; a record must be an object with an id."""
    v = F.try_parse_json("raw")
    results = F.try_variant_get(v, "$.results", "variant")
    kind = lambda n: F.coalesce(F.schema_of_variant(n), F.lit(""))
    reason = F.when(~kind(v).startswith("OBJECT"), "page is no object").when(~kind(results).startswith("ARRAY"), "results is no list")
    seen = pages.withColumn("reason", reason)
    keep = [c for c in pages.columns if c != "raw"]
    good = seen.where("reason IS NULL").select(*keep, F.posexplode(F.try_variant_get(v, "$.results", "array<variant>")).alias("place", "node"))
    known = kind(F.col("node")).startswith("OBJECT") & (F.coalesce(F.try_variant_get("node", id_path, "string"), F.lit("")) != "")
    return good.where(known).select(*keep, "place", F.to_json("node").alias("record")), seen.where("reason IS NOT NULL").select(*keep, "reason")


def usable_records(raw: str, id_path: str = "$.id") -> Column:
    """The records of a page that are objects with an id, as an array of (place, record); NULL if the page has no list of results."""
    nodes = F.try_variant_get(F.try_parse_json(raw), "$.results", "array<variant>")
    known = lambda n: F.coalesce(F.schema_of_variant(n).startswith("OBJECT"), F.lit(False)) & (F.coalesce(F.try_variant_get(n, id_path, "string"), F.lit("")) != "")
    placed = F.transform(nodes, lambda n, k: F.struct(k.alias("place"), n.alias("node")))
    return F.transform(F.filter(placed, lambda x: known(x["node"])), lambda x: F.struct(x["place"].alias("place"), F.to_json(x["node"]).alias("record")))


def read_ledger(spark: SparkSession, root: str, table: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{root}/{table}.parquet")
    return df.select(*columns) if columns else df


def write_ledger(df: DataFrame, root: str, table: str, key: str = "document_id", buckets: int = 64, bloom: tuple[str, ...] = ("document_id", "doi")) -> DataFrame:
    """A ledger table laid out for joins and lookups, below `root` and in the session's catalog as `table`: bucketed and sorted by
    `key`, so that tables with as many buckets join without a shuffle and a lookup reads one bucket, with Bloom filters on
    columns that are looked up, so that row groups without the value are skipped. Give about a bucket for each GB."""
    out = df.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", f"{root}/{table}").option("parquet.bloom.filter.adaptive.enabled", "true")
    for column in (c for c in bloom if c in df.columns):
        out = out.option(f"parquet.bloom.filter.enabled#{column}", "true")
    out.mode("errorifexists").saveAsTable(table)
    return df.sparkSession.table(table)


KINDS = ("pdf", "xml", "json")


def scan_corpus(spark: SparkSession, root: str) -> DataFrame:
    """document_id, kind, size_bytes, path, partial: the corpus folder's files, without reading them. Suffixes are known
    in either case; files with others are none of the corpus's. Empty files aren't listed: Spark's file source leaves them out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(root)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    kind = F.lower(F.regexp_extract(name, "\\.([^.]+)$", 1))
    return files.where(kind.isin(*KINDS, "part")).select(
        F.regexp_extract(name, "^(.*)\\.[^.]+$", 1).alias("document_id"), kind.alias("kind"), F.col("length").alias("size_bytes"), "path", (kind == "part").alias("partial")
    )


def digest_files(spark: SparkSession, root: str, most_bytes: int = 1 << 30) -> DataFrame:
    """document_id, kind, sha256 of files up to `most_bytes` (a file is one value; larger ones are kept back at the source)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{[pP][dD][fF],[xX][mM][lL],[jJ][sS][oO][nN]}").load(root).where(F.col("length") <= most_bytes)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    return files.select(F.regexp_extract(name, "^(.*)\\.[^.]+$", 1).alias("document_id"), F.lower(F.regexp_extract(name, "\\.([^.]+)$", 1)).alias("kind"), F.sha2("content", 256).alias("sha256"))
