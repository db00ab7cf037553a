"""Golden records kept current in all merged fields, as versions of a table of facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from ..operators.ledger import FIRST_WINS, MERGE_FIELDS, UNIONS, filled
from ..sources.versions import current, drop_unused, publish

#: Array fields of records: what makes two of them the same.
KEYED = {"candidates": ("url", "kind"), "topics": ("id",), "cross_checks": ("source",)}
#: Of these the latest counts, of all others the first.
LATEST = ("cross_checks",)
FACTS = "document_id string, field string, key string, rank long, place int, value string"


def _fact(field: str, key: Column, place: Column, value: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), key.alias("key"), place.cast("int").alias("place"), value.alias("value"))


def _offered(obs: DataFrame, field: str) -> Column:
    """What each observation offers a field, as an array of facts."""
    if field in FIRST_WINS:
        return F.when(filled(obs, field), F.array(_fact(field, F.lit(""), F.lit(0), F.col(field).cast("string"))))
    if field in UNIONS:
        return F.transform(field, lambda v, k: _fact(field, v, k, v))
    if field == "identifiers":
        return F.transform(F.map_entries(field), lambda e: _fact(field, e["key"], F.lit(0), e["value"]))
    key = lambda v: F.concat_ws("\x1f", *[F.coalesce(v[k].cast("string"), F.lit("")) for k in KEYED[field]])
    return F.transform(field, lambda v, k: _fact(field, key(v), k, F.to_json(v)))


def facts_of(obs: DataFrame) -> DataFrame:
    """One row for each value that an observation offers a merged field: FACTS. Of equal (document, field, key) the least
    (rank, place) counts; a rank is the observation's seq, negative where the latest counts."""
    none = F.array().cast("array<struct<field: string, key: string, place: int, value: string>>")
    lists = [F.coalesce(_offered(obs, f), none) for f in MERGE_FIELDS if f in obs.columns]
    there = F.array(_fact("", F.lit(""), F.lit(0), F.lit("")))  # a document without any value is one
    each = obs.select("document_id", "seq", F.explode(F.concat(there, *lists)).alias("x")).where("x.value IS NOT NULL AND x.key IS NOT NULL")
    rank = F.when(F.col("x.field").isin(*LATEST), -F.col("seq")).otherwise(F.col("seq"))
    return each.select(F.col("document_id").cast("string").alias("document_id"), "x.field", "x.key", rank.alias("rank"), "x.place", "x.value")


def fold(facts: DataFrame) -> DataFrame:
    """The fact that counts of each (document, field, key); combines before the shuffle, and in any order."""
    least = F.min(F.struct("rank", "place", "value")).alias("f")
    return facts.groupBy("document_id", "field", "key").agg(least).select("document_id", "field", "key", "f.*")


def _record_field(name: str, kind: DataType) -> Column:
    """A field of a golden record from the facts of its document."""
    mine = lambda value: F.when(F.col("field") == name, value)
    if name in FIRST_WINS:
        return F.max(mine(F.col("value"))).cast(kind)
    if name == "identifiers":
        return F.map_from_entries(F.sort_array(F.collect_list(mine(F.struct("key", "value")))))
    values = F.transform(F.sort_array(F.collect_list(mine(F.struct("rank", "place", "value")))), lambda x: x["value"])
    return values if name in UNIONS else F.transform(values, lambda v: F.from_json(v, kind.elementType))


def records_of(facts: DataFrame, schema: StructType) -> DataFrame:
    """One golden record a document, in the types that the observations have."""
    return facts.groupBy("document_id").agg(*[_record_field(f, schema[f].dataType).alias(f) for f in MERGE_FIELDS if f in schema.names])


class Golden:
    """The table: parts of facts below root/parts, versions of the list of parts below root/versions.

    Each batch folds what it brings and writes that as one part, without a look at the parts before: the least fact counts, so
    facts fold in any order and twice as well as once, and readers fold the parts of a version. A batch that is
    replayed starts from the version before it. After `most_parts` parts all are folded into one; parts that no
    recent version names are deleted."""

    def __init__(self, root: str, most_parts: int = 8):
        self.root, self.most_parts = root, most_parts

    def take(self, obs: DataFrame, number: int) -> None:
        spark = obs.sparkSession
        _, parts = current(spark, f"{self.root}/versions", number)
        parts = [*parts, self._write(fold(facts_of(obs)), f"b{number}")]
        if len(parts) > self.most_parts:
            parts = [self._write(self._folded(spark, parts), f"all{number}")]
        publish(spark, f"{self.root}/versions", number, parts)
        drop_unused(spark, f"{self.root}/versions", f"{self.root}/parts")

    def _write(self, facts: DataFrame, name: str) -> str:
        facts.repartition("document_id").sortWithinPartitions("document_id").write.mode("overwrite").parquet(f"{self.root}/parts/{name}")
        return name

    def _folded(self, spark, parts: list[str]) -> DataFrame:
        """The facts that count in these parts. They are dealt by document once: a part holds a fact of each key at most."""
        every = spark.read.schema(FACTS).parquet(*[f"{self.root}/parts/{p}" for p in parts])
        return fold(every.repartition("document_id")) if len(parts) > 1 else every

    def read(self, spark, schema: StructType) -> DataFrame:
        """The records of the newest version."""
        _, parts = current(spark, f"{self.root}/versions")
        return records_of(self._folded(spark, parts), schema)


def stream_merge(stream: DataFrame, root: str, most_parts: int = 8) -> DataFrame:
    """Golden records of all observations that have arrived: the first filled value of each scalar by seq, ordered unions,
    the first value of each identifier, candidate and topic, and the latest cross-check of each source."""
    table = Golden(root, most_parts)
    query = stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(table.take).start()
    query.awaitTermination()
    return table.read(stream.sparkSession, stream.schema)
