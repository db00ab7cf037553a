"""Discovery by cursor: pages land in any order, and each run's chain of cursors is followed as state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .stream import rocksdb_state

# The first cursor, and why a run's discovery ends.
FIRST = "*"
LIMIT, NO_CURSOR, EMPTY, REPEATED = "limit reached", "no next cursor", "empty page", "cursor repeated"

_PAGE = "raw string, next string, records long, raw_count long"
STEPS = "run_id string, page long, cursor string, next_cursor string, taken long, seen long, stopped string, raw string"
AT = "run_id string, page long, next_cursor string, seen long, stopped string"


class FollowCursors(StatefulProcessor):
    """One run: where it stands, the cursors it has read, and pages that landed before their turn."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "cursor string, page long, seen long, stopped string")
        self.read = handle.getMapState("read", "cursor string", "page long")
        self.early = handle.getMapState("early", "cursor string", _PAGE)

    def handleInputRows(self, key, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        cursor, page, seen, stopped = self.at.get() if self.at.exists() else (FIRST, 0, 0, None)
        for row in rows:
            if stopped or row["cursor"] is None or self.read.containsKey((row["cursor"],)):
                continue  # a page that is read again brings nothing new
            if row["cursor"] != cursor:
                self.early.updateValue((row["cursor"],), (row["raw"], row["next_cursor"], row["records"], row["raw_count"]))
                continue
            body = (row["raw"], row["next_cursor"], row["records"], row["raw_count"])
            while body:
                raw, following, records, raw_count = body
                taken = records if row["most"] is None else max(0, min(records, row["most"] - seen))
                page, seen = page + 1, seen + taken
                self.read.updateValue((cursor,), (page,))
                if row["most"] is not None and seen >= row["most"]:
                    stopped = LIMIT
                elif not following:
                    stopped = NO_CURSOR
                elif not raw_count:
                    stopped = EMPTY
                elif self.read.containsKey((following,)):
                    stopped = REPEATED
                following = None if stopped else following
                yield Row(run_id=key[0], page=page, cursor=cursor, next_cursor=following, taken=taken, seen=seen, stopped=stopped, raw=raw)
                body, cursor = None, following
                if not stopped and self.early.containsKey((cursor,)):
                    body = tuple(self.early.getValue((cursor,)))
                    self.early.removeKey((cursor,))
            self.at.update((cursor, page, seen, stopped))
        if stopped:
            self.early.clear()

    def close(self) -> None:
        pass


def follow(pages: DataFrame, split: Callable, next_path: str = "$.meta.next_cursor") -> DataFrame:
    """The pages (run_id, cursor, most, raw) of each run in the order of their cursors, as far as they have landed: STEPS.
    A page without a list of results can't be followed: its run waits until the page is read again."""
    body = F.try_parse_json("raw")
    count = F.size(F.try_variant_get(body, "$.results", "array<variant>")).cast("long")
    whole = pages.withColumns({"raw_count": count, "next_cursor": F.try_variant_get(body, next_path, "string")}).where("raw_count >= 0")
    whole = whole.withColumn("records", F.size(split("raw")).cast("long"))
    keyed = whole.select(F.col("run_id").cast("string"), "cursor", F.col("most").cast("long"), "raw", "next_cursor", "records", "raw_count")
    return keyed.groupBy("run_id").transformWithState(FollowCursors(), STEPS, "append", "none")


def stream_discover(pages: DataFrame, root: str, split: Callable, landed: Callable[[int], None] = lambda number: None) -> tuple[DataFrame, DataFrame]:
    """(records: run_id, page, place, record; where each run stands: AT).

    `split` gives the usable records of a page as an array of (place, record). A batch's steps are written, then
    their records, then the runs' new places, each over what an interrupted try left; only then does the stream's
    checkpoint move. So a crash reads at most that batch's pages again and skips none. `landed` is called
    between records and places."""
    spark = pages.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/steps/batch_id={number}")
        steps = spark.read.schema(STEPS).parquet(f"{root}/steps/batch_id={number}")
        each = steps.where("taken > 0").select("run_id", "page", F.explode(F.slice(split("raw"), 1, F.col("taken").cast("int"))).alias("r"))
        each.select("run_id", "page", "r.*").write.mode("overwrite").parquet(f"{root}/records/batch_id={number}")
        landed(number)
        last = steps.groupBy("run_id").agg(F.max_by(F.struct("page", "next_cursor", "seen", "stopped"), "page").alias("a"))
        last.select("run_id", "a.*").write.mode("overwrite").parquet(f"{root}/at/batch_id={number}")

    with rocksdb_state(spark):
        steps = follow(pages, split)
        steps.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    places = spark.read.schema(AT).parquet(f"{root}/at")
    at = places.groupBy("run_id").agg(F.max_by(F.struct("page", "next_cursor", "seen", "stopped"), "page").alias("a")).select("run_id", "a.*")
    return spark.read.schema("run_id string, page long, place int, record string").parquet(f"{root}/records"), at

