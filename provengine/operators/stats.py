"""Joins, aggregates, facets and run summaries over documents, artifacts, attempts and failures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch

# Document states, and their groups as reports use them.
STATUSES = ("DISCOVERED", "NORMALIZED", "QUEUED", "ACQUIRING", "VALIDATING", "COMPLETED", "FAILED_RETRYABLE", "FAILED_PERMANENT", "SKIPPED")
MOVING = ("DISCOVERED", "NORMALIZED", "QUEUED", "ACQUIRING", "VALIDATING")
PENDING = ("DISCOVERED", "NORMALIZED", "QUEUED", "FAILED_RETRYABLE")
IN_FLIGHT = ("ACQUIRING", "VALIDATING")
FAILED = ("FAILED_PERMANENT", "FAILED_RETRYABLE")
SETTLED = ("COMPLETED", "FAILED_PERMANENT", "FAILED_RETRYABLE", "SKIPPED")
OUTCOMES = ("HIT", "NO_HIT", "TIMEOUT", "ERROR")
BUCKETS = ("full_text_available", "partial_full_text", "unavailable", "retryable", "in_progress")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# --- joins ------------------------------------------------------------------------------------


def requests_with_outcomes(requests: DataFrame, outcomes: DataFrame, key: str = "request_id") -> DataFrame:
    """Every request with its outcome as a struct, NULL where the process died before one was written."""
    facts = [c for c in outcomes.columns if c != key]
    packed = outcomes.select(key, F.struct(*facts).alias("outcome"))
    return requests.join(packed, key, "left")


def rows_of_publications(publications: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Observations, decisions or acquisitions of the given publications, in append order by `seq`."""
    return rows.join(publications.select(key).distinct(), key, "left_semi")


def acquisitions(acquired: DataFrame, publications: DataFrame, files: DataFrame) -> DataFrame:
    return acquired.join(publications, "publication_id").join(files, "file_id")


def pending_for_run(run_documents: DataFrame, documents: DataFrame, statuses: tuple[str, ...] = (*MOVING, "FAILED_RETRYABLE", "COMPLETED")) -> DataFrame:
    return run_documents.join(documents.where(F.col("status").isin(*statuses)), "document_id")


def with_artifact(documents: DataFrame, artifacts: DataFrame, kind: str, wanted: bool = True) -> DataFrame:
    return documents.join(artifacts.where(F.col("kind") == kind).select("document_id"), "document_id", "left_semi" if wanted else "left_anti")


def artifact_flags(documents: DataFrame, artifacts: DataFrame) -> DataFrame:
    """has_pdf, has_xml, size_bytes by one conditional aggregate and one join."""
    facts = artifacts.groupBy("document_id").agg(
        F.bool_or(F.col("kind") == "pdf").alias("has_pdf"), F.bool_or(F.col("kind") == "xml").alias("has_xml"), F.sum("size_bytes").alias("size_bytes")
    )
    return documents.join(facts, "document_id", "left").withColumns(
        {"has_pdf": F.coalesce("has_pdf", F.lit(False)), "has_xml": F.coalesce("has_xml", F.lit(False)), "size_bytes": F.coalesce("size_bytes", F.lit(0)).cast("long")}
    )


def document_detail(documents: DataFrame, artifacts: DataFrame, attempts: DataFrame, failures: DataFrame, last: int = 50) -> DataFrame:
    """Each document with its artifacts, and its latest attempts and failures, as nested arrays."""

    def latest(rows: DataFrame, name: str) -> DataFrame:
        newest = Window.partitionBy("document_id").orderBy(F.col("id").desc())
        kept = rows.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= last)
        facts = [c for c in rows.columns if c not in ("document_id", "id")]
        return kept.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("id", *facts)), asc=False).alias(name))

    files = artifacts.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("kind", "size_bytes"))).alias("artifacts"))
    return documents.join(files, "document_id", "left").join(latest(attempts, "attempts_log"), "document_id", "left").join(latest(failures, "failures_log"), "document_id", "left")


def similar_runs(runs: DataFrame, request: DataFrame, now: Column, scan: int = 200, days: int = 14) -> DataFrame:
    """Runs among the latest `scan`, not dry and within `days`, with the request's fingerprint; what differs is listed."""
    recent = runs.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(scan)
    recent = recent.where(~F.col("dry_run") & (F.col("started_at") >= now - F.make_interval(days=F.lit(days))))
    wanted = request.select("fingerprint", *[F.col(c).alias(f"asked_{c}") for c in ("record_limit", "xml_policy")])
    differences = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"asked_{c}")), F.lit(c)) for c in ("record_limit", "xml_policy")]))
    return recent.join(wanted, "fingerprint").select("run_id", "started_at", "fingerprint", differences.alias("differences"))


# --- aggregates -------------------------------------------------------------------------------


def status_counts(documents: DataFrame, run_documents: DataFrame | None = None) -> DataFrame:
    if run_documents is None:
        return documents.groupBy("status").agg(F.count("*").alias("n"))
    return run_documents.select("run_id", "document_id").join(documents.select("document_id", "status"), "document_id").groupBy("run_id", "status").agg(F.count("*").alias("n"))


def acquisition_bucket() -> Column:
    """What full text is in hand; documents still moving come before their files."""
    return (
        F.when(F.col("status").isin(*MOVING), "in_progress").when(F.col("status") == "FAILED_RETRYABLE", "retryable")
        .when(F.col("has_pdf"), "full_text_available").when(F.col("has_xml"), "partial_full_text").otherwise("unavailable")
    )


def acquisition_states(documents: DataFrame, artifacts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Five exclusive buckets with zeroes, and their total."""
    flagged = artifact_flags(documents, artifacts).withColumn("bucket", acquisition_bucket())
    return flagged.groupBy(*by).agg(*[F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS], F.count("*").alias("total"))


def artifact_counts(artifacts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return artifacts.groupBy(*by).agg(
        F.count_if(F.col("kind") == "pdf").alias("pdf"), F.count_if(F.col("kind") == "xml").alias("xml"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes")
    )


def failure_groups(failures: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return (
        failures.where(F.col("document_id").isNotNull()).groupBy(*by, "category")
        .agg(F.count("*").alias("occurrences"), F.count_distinct("document_id").alias("documents"), F.max("ts").alias("last_seen"), F.count_if("retryable").alias("retryable_occurrences"))
    )


def retry_counts(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("run_id").agg(F.count_if(F.col("attempt_no") > 1).alias("retries"))


def last_activity(attempts: DataFrame, documents: DataFrame, run_documents: DataFrame) -> DataFrame:
    moved = run_documents.select("run_id", "document_id").join(documents.select("document_id", F.col("updated_at").alias("ts")), "document_id")
    each = _union([attempts.groupBy("run_id").agg(F.max("ts").alias("ts")), moved.groupBy("run_id").agg(F.max("ts").alias("ts"))])
    return each.groupBy("run_id").agg(F.max("ts").alias("last_activity_at"))


def facets(documents: DataFrame, journals: int = 200) -> DataFrame:
    """(facet, place, value): values present, years from the latest, journals by count."""

    def ranked(name: str, rows: DataFrame, *order: Column) -> DataFrame:
        place = F.row_number().over(Window.orderBy(*order))  # over distinct values
        return rows.select(F.lit(name).alias("facet"), place.cast("long").alias("place"), F.col("value").cast("string").alias("value"))

    value = lambda c: documents.where(F.col(c).isNotNull() & (F.col(c).cast("string") != "")).select(F.col(c).alias("value")).distinct()
    counted = documents.where(F.col("journal").isNotNull() & (F.col("journal") != "")).groupBy(F.col("journal").alias("value")).count()
    top = counted.orderBy(F.col("count").desc(), "value").limit(journals)
    return _union([
        ranked("oa_status", value("oa_status"), F.col("value")), ranked("year", value("publication_year"), F.col("value").desc()),
        ranked("journal", top, F.col("count").desc(), F.col("value")), ranked("status", value("status"), F.col("value")),
    ])


def _status_sums(**groups: tuple[str, ...]) -> list[Column]:
    return [F.count_if(F.col("status").isin(*states)).alias(name) for name, states in groups.items()]


def run_summaries(documents: DataFrame, artifacts: DataFrame, resumable: tuple[str, ...] = ("SUSPENDED", "INTERRUPTED", "RUNNING", "FAILED")) -> DataFrame:
    """Per run (documents carry run_id): counts, failures, files, what full text is in hand, and whether it can go on."""
    flagged = artifact_flags(documents, artifacts).withColumn("bucket", acquisition_bucket())
    per_kind = documents.select("document_id", "run_id").join(artifacts, "document_id").groupBy("run_id").agg(F.count_if(F.col("kind") == "pdf").alias("pdfs"), F.count_if(F.col("kind") == "xml").alias("xmls"))
    out = flagged.groupBy("run_id").agg(
        F.count("*").alias("documents"), *_status_sums(completed=("COMPLETED",), failed=FAILED), *[F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS],
        F.sum("size_bytes").alias("bytes"), run_state().alias("run_status"),
    )
    out = out.join(per_kind, "run_id", "left").fillna(0, ["pdfs", "xmls"])
    return out.withColumn("resumable", F.col("run_status").isin(*resumable))


def run_state() -> Column:
    """A run's state from its documents, where no run table says it."""
    return F.when(F.bool_or(F.col("status").isin(*IN_FLIGHT)), "RUNNING").when(F.bool_or(F.col("status").isin(*MOVING)), "SUSPENDED").otherwise("COMPLETED")


def live_progress(documents: DataFrame) -> DataFrame:
    out = documents.groupBy("run_id").agg(F.count("*").alias("total"), *_status_sums(settled=SETTLED, in_flight=IN_FLIGHT, pending=PENDING))
    share = 100 * F.col("settled") / F.col("total")
    return out.withColumn("percent", F.when(F.col("total") > 0, F.bround(share)).otherwise(0).cast("long"))


def dashboard(documents: DataFrame, artifacts: DataFrame) -> DataFrame:
    """One row of corpus cards: three aggregates of one row each, put side by side."""
    cards = documents.agg(F.count("*").alias("documents"), *_status_sums(completed=("COMPLETED",), failed=FAILED))
    states = acquisition_states(documents, artifacts).select("full_text_available", "partial_full_text")
    return cards.crossJoin(states).crossJoin(artifact_counts(artifacts).select(F.col("pdf").alias("pdfs"), F.col("xml").alias("xmls"), "bytes"))


def run_stats(attempts: DataFrame, failures: DataFrame) -> DataFrame:
    """Counters of a run, derived from its log rows."""
    tried = attempts.groupBy("run_id").agg(
        F.count_distinct("document_id").alias("attempted"), F.count_if(F.col("ok")).alias("succeeded"), F.count_if((F.col("operation") == "purchase") & F.col("ok")).alias("downloaded"),
        F.count_if(F.col("attempt_no") > 1).alias("retry_count"), F.min("ts").alias("started_at"), F.max("ts").alias("finished_at"),
    )
    failed = failures.groupBy("run_id").agg(
        F.count("*").alias("failure_count"), F.count_if("retryable").alias("failed_retryable"), F.count_if(~F.col("retryable")).alias("failed_permanent")
    )
    out = tried.join(failed, "run_id", "left").fillna(0, ["failure_count", "failed_retryable", "failed_permanent"])
    return out.withColumn("duration_seconds", F.unix_timestamp(F.col("finished_at").cast("timestamp")) - F.unix_timestamp(F.col("started_at").cast("timestamp")))


def outcome_stats(requests: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcomes by provider and operation; a request without one counts as missing."""
    return (
        requests.join(outcomes.select("request_id", F.col("status").alias("outcome")), "request_id", "left").groupBy("provider", "operation")
        .agg(*[F.count_if(F.col("outcome") == o).alias(o.lower()) for o in OUTCOMES], F.count_if(F.col("outcome").isNull()).alias("missing"))
    )


def exit_class(run_status: Column, failed: Column) -> Column:
    return F.when(run_status == "SUSPENDED", 4).when(run_status == "INTERRUPTED", 130).when(run_status == "FAILED", 1).when(failed > 0, 3).otherwise(0)


def run_detail(documents: DataFrame, artifacts: DataFrame, failures: DataFrame, first: int = 500) -> DataFrame:
    """Per run: its summary, failure groups, providers used and its first documents with their files."""
    flagged = artifact_flags(documents, artifacts)
    order = Window.partitionBy("run_id").orderBy("document_id")
    listed = flagged.withColumn("place", F.row_number().over(order)).where(F.col("place") <= first).groupBy("run_id").agg(
        F.sort_array(F.collect_list(F.struct("document_id", "status", "has_pdf", "has_xml", "size_bytes"))).alias("first_documents")
    )
    groups = failure_groups(failures, ("run_id",)).groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("category", "occurrences"))).alias("failure_groups"))
    used = failures.groupBy("run_id").agg(F.sort_array(F.collect_set("source")).alias("providers"))
    return run_summaries(documents, artifacts).join(listed, "run_id", "left").join(groups, "run_id", "left").join(used, "run_id", "left")


def search_provenance(runs: DataFrame) -> DataFrame:
    """How each run's query came about; only an assisted run has a question and a generated query."""
    assisted, generated = F.col("search_mode") == "assisted", F.col("generated_query")
    return runs.select(
        "run_id", "search_mode", "effective_search_query",
        F.when(assisted, F.col("research_question")).alias("research_question"), F.when(assisted, generated).alias("generated_query"),
        F.when(assisted, (F.coalesce(generated, F.lit("")) != "") & ~generated.eqNullSafe(F.col("effective_search_query"))).alias("query_edited"),
    )


def failure_log(failures: DataFrame, last: int | None = None) -> DataFrame:
    """Failures in append order; with `last`, the latest few of each document, newest first (place from 1)."""
    if last is None:
        return failures
    newest = Window.partitionBy("document_id").orderBy(F.col("id").desc())
    return failures.withColumn("place", F.row_number().over(newest).cast("long")).where(F.col("place") <= last)


# --- top-k, latest, sets ----------------------------------------------------------------------


def latest_runs(runs: DataFrame, k: int, statuses: tuple[str, ...] = ()) -> DataFrame:
    chosen = runs.where(F.col("run_status").isin(*statuses)) if statuses else runs
    return chosen.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(k)


def latest_failure(documents: DataFrame, failures: DataFrame, first: int = 300) -> DataFrame:
    """Failed and skipped documents with their latest failure."""
    facts = [c for c in failures.columns if c != "document_id"]
    last = failures.groupBy("document_id").agg(F.max_by(F.struct(*facts), "id").alias("failure"))
    stopped = documents.where(F.col("status").isin(*FAILED, "SKIPPED"))
    return stopped.join(last, "document_id", "left").orderBy("document_id").limit(first)


def documents_by_failure(documents: DataFrame, failures: DataFrame, category: str, first: int = 500) -> DataFrame:
    """Failed documents that ever had a failure of this category."""
    hit = failures.where(F.col("category") == category).select("document_id").distinct()
    return documents.where(F.col("status").isin(*FAILED)).join(hit, "document_id", "left_semi").select("document_id").orderBy("document_id").limit(first)


def running_credits(responses: DataFrame, provider: str = "source", credits: str = "credits", seq: str = "id", segment_rows: int = 1 << 18) -> DataFrame:
    """`spent`: the running credits of each provider in response order.

    A provider is one hot key, so rows are dealt out by rank of (provider, seq), about `segment_rows` to a segment however
    they are spread, and written; sums are made by segment and provider first, then inside a segment."""
    segments = max(1, -(-responses.count() // segment_rows))
    dealt = responses.repartitionByRange(segments, provider, seq).sortWithinPartitions(provider, seq).withColumn("segment", F.spark_partition_id())
    at = scratch(responses.sparkSession)
    dealt.write.parquet(at)
    rows = responses.sparkSession.read.schema(dealt.schema).parquet(at)
    totals = rows.groupBy(provider, "segment").agg(F.sum(credits).alias("sum"))
    before = Window.partitionBy(provider).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col(provider).alias("p"), F.col("segment").alias("s"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy(provider, "segment").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    # one row a provider and segment
    run = rows.join(totals, rows[provider].eqNullSafe(totals["p"]) & (rows["segment"] == totals["s"])).withColumn("spent", F.col("base") + F.sum(credits).over(inside))
    return run.drop("p", "s", "segment", "base")


def budget(responses: DataFrame, ceiling: int, provider: str = "source", credits: str = "credits", seq: str = "id", remaining: str = "remaining", segment_rows: int = 1 << 18) -> DataFrame:
    """Running credits of each provider in response order; the first response at the ceiling, or with none
    remaining, suspends it, and later ones are refused."""
    run = running_credits(responses, provider, credits, seq, segment_rows)
    crossed = (F.col("spent") >= ceiling) | (F.coalesce(F.col(remaining), F.lit(1)) <= 0)
    first = run.where(crossed).groupBy(F.col(provider).alias("q")).agg(F.min(seq).alias("suspended_at"))
    out = run.join(first, run[provider].eqNullSafe(first["q"]), "left")
    return out.select(
        seq, provider, "spent", F.coalesce(F.col(seq) == F.col("suspended_at"), F.lit(False)).alias("suspends"), F.coalesce(F.col(seq) > F.col("suspended_at"), F.lit(False)).alias("refused")
    )


def providers_for_run(*tables: DataFrame) -> DataFrame:
    return _union([t.select("run_id", "source") for t in tables]).where(F.col("source").isNotNull()).distinct()
