"""Status, failure and retry logic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Classes of HTTP statuses, categories that no retry mends, and words that name a spent budget.
RETRYABLE_HTTP = (408, 425, 429, 500, 502, 503, 504)
PERMANENT_HTTP = (400, 401, 403, 404, 405, 406, 410, 414, 422, 451)
PERMANENT = (
    "CONFIGURATION_ERROR", "AUTHENTICATION_ERROR", "NOT_FOUND", "INVALID_METADATA", "INVALID_PDF", "INVALID_XML",
    "BOT_CHALLENGE", "CHECKSUM_ERROR", "SIZE_LIMIT_EXCEEDED", "UNSAFE_URL", "NO_OA_LOCATION",
)
BUDGET_BODY = (
    "(?i)(?:daily|credit|quota|budget|allowance)\\w*\\s*(?:limit|exceeded|exhaust|out of|spent|reached)"
    "|(?:exceeded|exhaust\\w*|out of|no more|insufficient)\\s*\\w*\\s*(?:daily|credit|quota|budget)"
)


def classify_response(status: Column, remaining: Column, body: Column) -> Column:
    """struct(category, retryable) of a response; NULL below 400."""
    spent = F.coalesce(body.rlike(BUDGET_BODY), F.lit(False)) | F.coalesce(remaining <= 0, F.lit(False))
    category = (
        F.when(status.isNull() | (status < 400), None).when(status.isin(429, 409, 402, 403) & spent, "BUDGET_EXHAUSTED").when(status == 429, "RATE_LIMITED").when(status.isin(401, 403), "AUTHENTICATION_ERROR")
        .when(status == 404, "NOT_FOUND").when(status.isin(*PERMANENT_HTTP), "HTTP_ERROR").when(status.isin(*RETRYABLE_HTTP) | status.between(500, 599), "PROVIDER_ERROR").otherwise("HTTP_ERROR")
    )
    return F.struct(category.alias("category"), F.coalesce(category.isin("RATE_LIMITED", "PROVIDER_ERROR"), F.lit(False)).alias("retryable"))


def is_permanent(category: Column) -> Column:
    return F.coalesce(category.isin(*PERMANENT), F.lit(False))


def retry_after(header: Column, now: Column, cap: float) -> Column:
    """Seconds to wait by a Retry-After header (seconds or an HTTP date), within [0, cap]; NULL if it says nothing."""
    seconds = F.trim(header).try_cast("double")
    date = F.try_to_timestamp(F.substring(F.trim(header), 6, 40), F.lit("dd MMM yyyy HH:mm:ss zzz"))
    wait = F.coalesce(seconds, (F.unix_timestamp(date) - F.unix_timestamp(now)).cast("double"))
    return F.when(wait.isNotNull(), F.least(F.greatest(wait, F.lit(0.0)), F.lit(float(cap))))


def backoff(attempt_no: Column, initial: float, factor: float, cap: float, asked: Column | None = None, jitter: float = 0.0) -> Column:
    """struct(low, high): the bounds of the wait before the next attempt; a wait that was asked for wins."""
    base = F.least(F.lit(float(cap)), initial * F.pow(F.lit(float(factor)), F.greatest(attempt_no - 1, F.lit(0))))
    wait = base if asked is None else F.coalesce(asked, base)
    spread = F.lit(0.0) if asked is None and not jitter else F.when(asked.isNull() if asked is not None else F.lit(True), base * jitter).otherwise(0.0)
    return F.struct((wait - spread).alias("low"), (wait + spread).alias("high"))


def failure_target(retryable: Column, attempts: Column, most: int) -> Column:
    return F.when(retryable & (F.coalesce(attempts, F.lit(0)) + 1 < most), "FAILED_RETRYABLE").otherwise("FAILED_PERMANENT")


def document_outcome(has_pdf: Column, has_xml: Column, retryable: Column, attempts: Column, most: int, xml_policy: str = "preferred") -> Column:
    """struct(status, partial_fulltext, error): a PDF is required, an XML only by policy."""
    lacks_xml = ~has_xml & F.lit(xml_policy == "required")
    status = F.when(has_pdf & ~lacks_xml, "COMPLETED").when(has_pdf, "FAILED_PERMANENT").otherwise(failure_target(retryable, attempts, most))
    error = F.when(has_pdf & ~lacks_xml, None).when(has_pdf, "NOT_FOUND").otherwise("NO_OA_LOCATION")
    return F.struct(status.alias("status"), (has_xml & ~has_pdf).alias("partial_fulltext"), error.alias("error"))


def requeue(documents: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Failed, skipped and stale documents go back to the queue, unclaimed; `requeued` marks them."""
    chosen = F.col("status").isin("FAILED_RETRYABLE", "FAILED_PERMANENT", "SKIPPED", "ACQUIRING", "VALIDATING")
    out = documents
    if ids is not None:
        out = out.join(ids.select("document_id").distinct().withColumn("asked", F.lit(True)), "document_id", "left")
        chosen = chosen & F.coalesce("asked", F.lit(False))
    out = out.withColumn("requeued", chosen)
    return out.withColumns({"status": F.when(F.col("requeued"), "QUEUED").otherwise(F.col("status")), "claimed": F.when(F.col("requeued"), False).otherwise(F.col("claimed"))}).drop("asked")


def claimable(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("status").isin("DISCOVERED", "NORMALIZED", "QUEUED", "FAILED_RETRYABLE") & ~F.coalesce("claimed", F.lit(False)))


