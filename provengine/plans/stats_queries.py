"""Queries over the join, aggregate and ranking operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rank as R
from ..operators import stats as X
from .fixtures import view
from .registry import query

MOVING = "('DISCOVERED','NORMALIZED','QUEUED','ACQUIRING','VALIDATING')"
#: One current artifact a (document, kind): the last by (seq, retrieved_at, content_key).
ARTIFACTS = """(SELECT document_id, kind, arg_max(size_bytes, (seq, retrieved_at, content_key)) AS size_bytes, arg_max(content_key, (seq, retrieved_at, content_key)) AS content_key, arg_max(source, (seq, retrieved_at, content_key)) AS source FROM {ART} a0 GROUP BY document_id, kind)"""
FLAGS = f"(SELECT document_id, bool_or(kind = 'pdf') AS has_pdf, bool_or(kind = 'xml') AS has_xml, CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM {ARTIFACTS} a1 GROUP BY document_id)"
FLAGGED = f"(SELECT d.*, coalesce(has_pdf, false) AS has_pdf, coalesce(has_xml, false) AS has_xml, coalesce(size_bytes, 0) AS size_bytes, CASE WHEN status IN {MOVING} THEN 'in_progress' WHEN status = 'FAILED_RETRYABLE' THEN 'retryable' WHEN has_pdf THEN 'full_text_available' WHEN has_xml THEN 'partial_full_text' ELSE 'unavailable' END AS bucket FROM {{DOC}} d LEFT JOIN {FLAGS} f ON f.document_id = d.document_id)"
BUCKETS = ", ".join(f"count(*) FILTER (bucket = '{b}') AS {b}" for b in X.BUCKETS)
RUN_STATUS = f"CASE WHEN bool_or(status IN ('ACQUIRING','VALIDATING')) THEN 'RUNNING' WHEN bool_or(status IN {MOVING}) THEN 'SUSPENDED' ELSE 'COMPLETED' END"
RUNS = f"(SELECT run_id, min(updated_at) AS started_at, max(updated_at) AS finished_at, {RUN_STATUS} AS run_status, count(*) FILTER (status IN ('FAILED_PERMANENT','FAILED_RETRYABLE')) AS failed, count(*) AS n FROM {{DOC}} d GROUP BY run_id)"
FAILS = "(SELECT * FROM {EVT} e0 WHERE NOT ok)"


def docs(spark, sf_dir):
    return view(spark, sf_dir, "DOC")


def artifacts(spark, sf_dir):
    """One current artifact a (document, kind)."""
    last = F.struct("seq", "retrieved_at", "content_key")
    return view(spark, sf_dir, "ART").groupBy("document_id", "kind").agg(*[F.max_by(c, last).alias(c) for c in ("size_bytes", "content_key", "source")])


def failures(spark, sf_dir):
    return view(spark, sf_dir, "EVT").where("NOT ok")


def runs(spark, sf_dir):
    d = docs(spark, sf_dir)
    return d.groupBy("run_id").agg(F.min("updated_at").alias("started_at"), F.max("updated_at").alias("finished_at"), X.run_state().alias("run_status"), F.count_if(F.col("status").isin(*X.FAILED)).alias("failed"), F.count("*").alias("n"))


def _requests(spark, sf_dir):
    e = view(spark, sf_dir, "EVT")
    return e.select(F.col("id").alias("request_id"), F.col("source").alias("provider"), "operation")


def _outcomes(spark, sf_dir):
    e = view(spark, sf_dir, "EVT").where("id % 7 <> 0")
    status = F.when(F.col("ok"), F.when(F.col("attempt_no") == 1, "HIT").otherwise("NO_HIT")).when(F.col("category") == "TIMEOUT", "TIMEOUT").otherwise("ERROR")
    return e.select(F.col("id").alias("request_id"), status.alias("status"), "http_status")


_OUTCOMES = "(SELECT id AS request_id, CASE WHEN ok THEN CASE WHEN attempt_no = 1 THEN 'HIT' ELSE 'NO_HIT' END WHEN category = 'TIMEOUT' THEN 'TIMEOUT' ELSE 'ERROR' END AS status, http_status FROM {EVT} e1 WHERE id % 7 <> 0)"


@query("requests_with_outcomes", f"SELECT e.id AS request_id, e.source AS provider, e.operation, o.status AS outcome_status, o.http_status AS outcome_http FROM {{EVT}} e LEFT JOIN {_OUTCOMES} o ON o.request_id = e.id")
def requests_with_outcomes(spark, sf_dir):
    out = X.requests_with_outcomes(_requests(spark, sf_dir), _outcomes(spark, sf_dir))
    return out.select("request_id", "provider", "operation", F.col("outcome.status").alias("outcome_status"), F.col("outcome.http_status").alias("outcome_http"))


@query("observations_for_doc", "SELECT seq, pub_no, provider, title FROM {OBS} o WHERE pub_no % 3 = 0")
def observations_for_doc(spark, sf_dir):
    obs = view(spark, sf_dir, "OBS")
    wanted = obs.select("pub_no").distinct().where("pub_no % 3 = 0")
    return X.rows_of_publications(wanted, obs, "pub_no").select("seq", "pub_no", "provider", "title")


@query(
    "acquisitions_for_doc",
    "SELECT a.document_id, a.kind, a.seq, a.content_key, f.size_bytes, d.status FROM {ART} a JOIN (SELECT content_key, min(size_bytes) AS size_bytes FROM {ART} a2 GROUP BY content_key) f ON f.content_key = a.content_key JOIN {DOC} d ON d.document_id = a.document_id",
)
def acquisitions_for_doc(spark, sf_dir):
    art = view(spark, sf_dir, "ART")
    files = art.groupBy("content_key").agg(F.min("size_bytes").alias("size_bytes")).withColumnRenamed("content_key", "file_id")
    acquired = art.select(F.col("document_id").alias("publication_id"), "kind", "seq", F.col("content_key").alias("file_id"))
    pubs = docs(spark, sf_dir).select(F.col("document_id").alias("publication_id"), "status")
    return X.acquisitions(acquired, pubs, files).select(F.col("publication_id").alias("document_id"), "kind", "seq", F.col("file_id").alias("content_key"), "size_bytes", "status")


@query("pending_for_run", f"SELECT run_id, document_id, status FROM {{DOC}} d WHERE status IN {MOVING} OR status IN ('FAILED_RETRYABLE', 'COMPLETED')")
def pending_for_run(spark, sf_dir):
    d = docs(spark, sf_dir)
    return X.pending_for_run(d.select("run_id", "document_id"), d.select("document_id", "status"))


@query("has_artifact_semi", "SELECT document_id FROM {DOC} d WHERE EXISTS (SELECT 1 FROM {ART} a WHERE a.document_id = d.document_id AND a.kind = 'pdf')")
def has_artifact_semi(spark, sf_dir):
    return X.with_artifact(docs(spark, sf_dir), view(spark, sf_dir, "ART"), "pdf").select("document_id")


@query("lacks_artifact_anti", "SELECT document_id FROM {DOC} d WHERE NOT EXISTS (SELECT 1 FROM {ART} a WHERE a.document_id = d.document_id AND a.kind = 'xml')")
def lacks_artifact_anti(spark, sf_dir):
    return X.with_artifact(docs(spark, sf_dir), view(spark, sf_dir, "ART"), "xml", wanted=False).select("document_id")


@query("existence_flags", f"SELECT document_id, has_pdf, has_xml, size_bytes FROM {FLAGGED} f")
def existence_flags(spark, sf_dir):
    return X.artifact_flags(docs(spark, sf_dir), artifacts(spark, sf_dir)).select("document_id", "has_pdf", "has_xml", "size_bytes")


@query(
    "similar_runs",
    f"SELECT run_id, started_at, record_limit, CASE WHEN record_limit <> 5 THEN 'record_limit' ELSE '' END AS differences FROM (SELECT run_id, started_at, n % 3 AS fingerprint, n % 10 AS record_limit, n % 4 = 0 AS dry_run FROM {RUNS} r ORDER BY started_at DESC, run_id DESC LIMIT 200) WHERE NOT dry_run AND fingerprint = 1 AND started_at >= (SELECT max(started_at) - INTERVAL 2000 DAY FROM {RUNS} r2)",
)
def similar_runs(spark, sf_dir):
    r = runs(spark, sf_dir).select("run_id", "started_at", (F.col("n") % 3).alias("fingerprint"), (F.col("n") % 10).alias("record_limit"), F.lit("preferred").alias("xml_policy"), (F.col("n") % 4 == 0).alias("dry_run"))
    request = spark.range(1).select(F.lit(1).cast("long").alias("fingerprint"), F.lit(5).cast("long").alias("record_limit"), F.lit("preferred").alias("xml_policy"))
    latest = r.agg(F.max("started_at").alias("now"))
    out = X.similar_runs(r.crossJoin(F.broadcast(latest)), request, F.col("now"), days=2000)
    return out.join(r.select("run_id", "record_limit"), "run_id").select("run_id", "started_at", "record_limit", F.array_join("differences", ",").alias("differences"))


@query(
    "document_detail",
    f"""SELECT d.document_id, d.status, coalesce(a.kinds, '') AS kinds, coalesce(t.ids, '') AS attempt_ids, coalesce(f.ids, '') AS failure_ids FROM {{DOC}} d
    LEFT JOIN (SELECT document_id, string_agg(kind, ',' ORDER BY kind) AS kinds FROM {ARTIFACTS} x GROUP BY document_id) a ON a.document_id = d.document_id
    LEFT JOIN (SELECT document_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id DESC) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY id DESC) AS rn FROM {{EVT}} e) WHERE rn <= 50 GROUP BY document_id) t ON t.document_id = d.document_id
    LEFT JOIN (SELECT document_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id DESC) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY id DESC) AS rn FROM {FAILS} e) WHERE rn <= 50 GROUP BY document_id) f ON f.document_id = d.document_id""",
)
def document_detail(spark, sf_dir):
    e = view(spark, sf_dir, "EVT").select("document_id", "id", "operation", "ok", "category")
    out = X.document_detail(docs(spark, sf_dir).select("document_id", "status"), artifacts(spark, sf_dir), e, e.where("NOT ok"))
    ids = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x["id"].cast("string")), ","), F.lit(""))
    return out.select("document_id", "status", F.coalesce(F.array_join("artifacts.kind", ","), F.lit("")).alias("kinds"), ids("attempts_log").alias("attempt_ids"), ids("failures_log").alias("failure_ids"))


@query("status_counts", "SELECT run_id, status, count(*) AS n FROM {DOC} d GROUP BY run_id, status UNION ALL SELECT 'all', status, count(*) FROM {DOC} d2 GROUP BY status")
def status_counts(spark, sf_dir):
    d = docs(spark, sf_dir)
    return X.status_counts(d, d.select("run_id", "document_id")).unionByName(X.status_counts(d).withColumn("run_id", F.lit("all")))


@query("acquisition_state_counts", f"SELECT run_id, {BUCKETS}, count(*) AS total FROM {FLAGGED} f GROUP BY run_id")
def acquisition_state_counts(spark, sf_dir):
    return X.acquisition_states(docs(spark, sf_dir), artifacts(spark, sf_dir), ("run_id",))


@query("artifact_counts", f"SELECT source, count(*) FILTER (kind = 'pdf') AS pdf, count(*) FILTER (kind = 'xml') AS xml, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM {ARTIFACTS} a GROUP BY source")
def artifact_counts(spark, sf_dir):
    return X.artifact_counts(artifacts(spark, sf_dir), ("source",))


@query("failure_groups", f"SELECT run_id, category, count(*) AS occurrences, count(DISTINCT document_id) AS documents, max(ts) AS last_seen, count(*) FILTER (retryable) AS retryable_occurrences FROM {FAILS} f WHERE document_id IS NOT NULL GROUP BY run_id, category")
def failure_groups(spark, sf_dir):
    return X.failure_groups(failures(spark, sf_dir), ("run_id",))


@query("retry_count", "SELECT run_id, count(*) FILTER (attempt_no > 1) AS retries FROM {EVT} e GROUP BY run_id")
def retry_count(spark, sf_dir):
    return X.retry_counts(view(spark, sf_dir, "EVT"))


@query(
    "last_activity",
    "SELECT run_id, max(ts) AS last_activity_at FROM (SELECT run_id, ts FROM {EVT} e UNION ALL SELECT 'run-' || (document_id % 6), updated_at::TIMESTAMP FROM {DOC} d) GROUP BY run_id",
)
def last_activity(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))
    members = d.select(F.concat(F.lit("run-"), (F.col("document_id") % 6).cast("string")).alias("run_id"), "document_id")
    return X.last_activity(view(spark, sf_dir, "EVT"), d, members)


@query(
    "corpus_facets",
    """SELECT 'oa_status' AS facet, row_number() OVER (ORDER BY value) AS place, value FROM (SELECT DISTINCT oa_status AS value FROM {DOC} d WHERE oa_status <> '')
    UNION ALL SELECT 'year', row_number() OVER (ORDER BY value DESC), CAST(value AS VARCHAR) FROM (SELECT DISTINCT publication_year AS value FROM {DOC} d WHERE publication_year IS NOT NULL)
    UNION ALL SELECT 'journal', row_number() OVER (ORDER BY n DESC, value), value FROM (SELECT journal AS value, count(*) AS n FROM {DOC} d WHERE journal <> '' GROUP BY journal ORDER BY n DESC, value LIMIT 200)
    UNION ALL SELECT 'status', row_number() OVER (ORDER BY value), value FROM (SELECT DISTINCT status AS value FROM {DOC} d)""",
)
def corpus_facets(spark, sf_dir):
    return X.facets(docs(spark, sf_dir))


_SUMMARY = f"SELECT run_id, count(*) AS documents, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status IN ('FAILED_PERMANENT','FAILED_RETRYABLE')) AS failed, {BUCKETS}, CAST(sum(size_bytes) AS BIGINT) AS bytes, {RUN_STATUS} AS run_status, CAST(sum(has_pdf::INT) AS BIGINT) AS pdfs, CAST(sum(has_xml::INT) AS BIGINT) AS xmls, {RUN_STATUS} IN ('SUSPENDED','INTERRUPTED','RUNNING','FAILED') AS resumable FROM {FLAGGED} f GROUP BY run_id"


@query("run_summary", _SUMMARY)
def run_summary(spark, sf_dir):
    return X.run_summaries(docs(spark, sf_dir), artifacts(spark, sf_dir))


@query(
    "live_progress",
    "SELECT run_id, count(*) AS total, count(*) FILTER (status IN ('COMPLETED','FAILED_PERMANENT','FAILED_RETRYABLE','SKIPPED')) AS settled, count(*) FILTER (status IN ('ACQUIRING','VALIDATING')) AS in_flight, count(*) FILTER (status IN ('DISCOVERED','NORMALIZED','QUEUED','FAILED_RETRYABLE')) AS pending, CAST(round_even(100 * count(*) FILTER (status IN ('COMPLETED','FAILED_PERMANENT','FAILED_RETRYABLE','SKIPPED')) / count(*), 0) AS BIGINT) AS percent FROM {DOC} d GROUP BY run_id",
)
def live_progress(spark, sf_dir):
    return X.live_progress(docs(spark, sf_dir))


@query(
    "dashboard",
    f"SELECT count(*) AS documents, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status IN ('FAILED_PERMANENT','FAILED_RETRYABLE')) AS failed, count(*) FILTER (bucket = 'full_text_available') AS full_text_available, count(*) FILTER (bucket = 'partial_full_text') AS partial_full_text, (SELECT count(*) FROM {ARTIFACTS} a WHERE kind = 'pdf') AS pdfs, (SELECT count(*) FROM {ARTIFACTS} a WHERE kind = 'xml') AS xmls, (SELECT CAST(sum(size_bytes) AS BIGINT) FROM {ARTIFACTS} a) AS bytes FROM {FLAGGED} f",
)
def dashboard(spark, sf_dir):
    return X.dashboard(docs(spark, sf_dir), artifacts(spark, sf_dir))


@query(
    "run_stats",
    "SELECT run_id, count(DISTINCT document_id) AS attempted, count(*) FILTER (ok) AS succeeded, count(*) FILTER (operation = 'purchase' AND ok) AS downloaded, count(*) FILTER (attempt_no > 1) AS retry_count, min(ts) AS started_at, max(ts) AS finished_at, count(*) FILTER (NOT ok) AS failure_count, count(*) FILTER (NOT ok AND retryable) AS failed_retryable, count(*) FILTER (NOT ok AND NOT retryable) AS failed_permanent, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS duration_seconds FROM {EVT} e GROUP BY run_id",
)
def run_stats(spark, sf_dir):
    return X.run_stats(view(spark, sf_dir, "EVT"), failures(spark, sf_dir))


@query(
    "provider_outcome_stats",
    f"SELECT e.source AS provider, e.operation, count(*) FILTER (o.status = 'HIT') AS hit, count(*) FILTER (o.status = 'NO_HIT') AS no_hit, count(*) FILTER (o.status = 'TIMEOUT') AS timeout, count(*) FILTER (o.status = 'ERROR') AS error, count(*) FILTER (o.status IS NULL) AS missing FROM {{EVT}} e LEFT JOIN {_OUTCOMES} o ON o.request_id = e.id GROUP BY ALL",
)
def provider_outcome_stats(spark, sf_dir):
    return X.outcome_stats(_requests(spark, sf_dir), _outcomes(spark, sf_dir))


@query("exit_class", f"SELECT run_id, CASE WHEN run_status = 'SUSPENDED' THEN 4 WHEN run_status = 'INTERRUPTED' THEN 130 WHEN run_status = 'FAILED' THEN 1 WHEN failed > 0 THEN 3 ELSE 0 END AS exit_class FROM {RUNS} r")
def exit_class(spark, sf_dir):
    return runs(spark, sf_dir).select("run_id", X.exit_class(F.col("run_status"), F.col("failed")).alias("exit_class"))


@query(
    "run_detail",
    f"""SELECT s.*, l.listed, coalesce(g.groups, '') AS groups, coalesce(g.providers, '') AS providers FROM ({_SUMMARY}) s
    LEFT JOIN (SELECT run_id, string_agg(document_id || ':' || status || ':' || size_bytes, ',' ORDER BY document_id) AS listed FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY document_id) AS rn FROM {FLAGGED} f) WHERE rn <= 500 GROUP BY run_id) l ON l.run_id = s.run_id
    LEFT JOIN (SELECT run_id, string_agg(category || '=' || n, ',' ORDER BY category) AS groups, max(providers) AS providers FROM (SELECT 'run-19980' || (1 + document_id % 9) AS run_id, category, count(*) AS n FROM {FAILS} e GROUP BY ALL) JOIN (SELECT 'run-19980' || (1 + document_id % 9) AS run_id, string_agg(DISTINCT source, ',' ORDER BY source) AS providers FROM {FAILS} e GROUP BY ALL) USING (run_id) GROUP BY run_id) g ON g.run_id = s.run_id""",
)
def run_detail(spark, sf_dir):
    f = failures(spark, sf_dir).withColumn("run_id", F.concat(F.lit("run-19980"), (1 + F.col("document_id") % 9).cast("string")))
    out = X.run_detail(docs(spark, sf_dir), artifacts(spark, sf_dir), f)
    listed = F.array_join(F.transform("first_documents", lambda x: F.concat_ws(":", x["document_id"].cast("string"), x["status"], x["size_bytes"].cast("string"))), ",")
    groups = F.array_join(F.transform("failure_groups", lambda x: F.concat_ws("=", x["category"], x["occurrences"].cast("string"))), ",")
    return out.withColumns({"listed": listed, "groups": F.coalesce(groups, F.lit("")), "providers": F.coalesce(F.array_join("providers", ","), F.lit(""))}).drop("first_documents", "failure_groups")


_PROVENANCE = "(SELECT run_id, CASE WHEN n % 2 = 0 THEN 'assisted' ELSE 'conventional' END AS search_mode, 'query ' || (n % 5) AS effective_search_query, 'why ' || run_id AS research_question, CASE WHEN n % 6 = 0 THEN '' ELSE 'query ' || (n % 4) END AS generated_query FROM " + RUNS + " r)"


@query("search_provenance", f"SELECT run_id, search_mode, effective_search_query, CASE WHEN search_mode = 'assisted' THEN research_question END AS research_question, CASE WHEN search_mode = 'assisted' THEN generated_query END AS generated_query, CASE WHEN search_mode = 'assisted' THEN generated_query <> '' AND generated_query <> effective_search_query END AS query_edited FROM {_PROVENANCE} p")
def search_provenance(spark, sf_dir):
    n = F.col("n")
    r = runs(spark, sf_dir).select(
        "run_id", F.when(n % 2 == 0, "assisted").otherwise("conventional").alias("search_mode"), F.concat(F.lit("query "), (n % 5).cast("string")).alias("effective_search_query"),
        F.concat(F.lit("why "), F.col("run_id")).alias("research_question"), F.when(n % 6 == 0, "").otherwise(F.concat(F.lit("query "), (n % 4).cast("string"))).alias("generated_query"),
    )
    return X.search_provenance(r)


@query("failure_log", f"SELECT document_id, id, category, place FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY id DESC) AS place FROM {FAILS} f) WHERE place <= 3")
def failure_log(spark, sf_dir):
    return X.failure_log(failures(spark, sf_dir), 3).select("document_id", "id", "category", "place")


@query("latest_runs", f"SELECT run_id, started_at, run_status FROM {RUNS} r WHERE run_status IN ('RUNNING', 'SUSPENDED', 'COMPLETED') ORDER BY started_at DESC, run_id DESC LIMIT 20")
def latest_runs(spark, sf_dir):
    return X.latest_runs(runs(spark, sf_dir), 20, ("RUNNING", "SUSPENDED", "COMPLETED")).select("run_id", "started_at", "run_status")


@query(
    "latest_failure",
    f"SELECT d.document_id, d.status, f.category, f.id AS failure_id FROM {{DOC}} d LEFT JOIN (SELECT document_id, arg_max(category, id) AS category, max(id) AS id FROM {FAILS} x GROUP BY document_id) f ON f.document_id = d.document_id WHERE d.status IN ('FAILED_PERMANENT','FAILED_RETRYABLE','SKIPPED') ORDER BY d.document_id LIMIT 300",
)
def latest_failure(spark, sf_dir):
    out = X.latest_failure(docs(spark, sf_dir).select("document_id", "status"), failures(spark, sf_dir).select("document_id", "id", "category"))
    return out.select("document_id", "status", F.col("failure.category").alias("category"), F.col("failure.id").alias("failure_id"))


@query("by_failure_category", f"SELECT document_id FROM {{DOC}} d WHERE status IN ('FAILED_PERMANENT','FAILED_RETRYABLE') AND document_id IN (SELECT document_id FROM {FAILS} f WHERE category = 'TIMEOUT') ORDER BY document_id LIMIT 500")
def by_failure_category(spark, sf_dir):
    return X.documents_by_failure(docs(spark, sf_dir), failures(spark, sf_dir), "TIMEOUT")


_BUDGET = "(SELECT *, CAST(sum(attempt_no) OVER (PARTITION BY source ORDER BY id) AS BIGINT) AS spent FROM {EVT} e)"


@query(
    "budget_suspension",
    f"SELECT b.id, b.source, b.spent, coalesce(b.id = f.at, false) AS suspends, coalesce(b.id > f.at, false) AS refused FROM {_BUDGET} b LEFT JOIN (SELECT source, min(id) AS at FROM {_BUDGET} c WHERE spent >= 400 OR coalesce(remaining, 1) <= 0 AND id > 60 GROUP BY source) f ON f.source = b.source",
)
def budget_suspension(spark, sf_dir):
    e = view(spark, sf_dir, "EVT").withColumn("remaining", F.when(F.col("id") > 60, F.col("remaining")))
    return X.budget(e.withColumn("credits", F.col("attempt_no")), 400)


@query("providers_for_run", "SELECT DISTINCT run_id, source FROM {EVT} e UNION SELECT run_id, provider FROM {OBS} o")
def providers_for_run(spark, sf_dir):
    e = view(spark, sf_dir, "EVT")
    return X.providers_for_run(view(spark, sf_dir, "OBS").withColumnRenamed("provider", "source"), e, e.where("NOT ok"))


_RANKED = """(SELECT *, row_number() OVER (PARTITION BY document_id, kind ORDER BY challenged, priority, offered_index, url) AS rank FROM
  (SELECT *, row_number() OVER (PARTITION BY document_id, kind, url ORDER BY challenged, priority, offered_index, url) AS again FROM
    (SELECT *, (url LIKE 'https://pmc.ncbi.nlm.nih.gov/%/pdf%')::INT AS challenged, CASE source WHEN 'openalex' THEN 0 WHEN 'europe_pmc' THEN 1 ELSE 2 END AS priority FROM {CAND} c0)) WHERE again = 1)"""


@query("rank_candidates", f"SELECT document_id, kind, url, source, challenged, rank FROM {_RANKED} r")
def rank_candidates(spark, sf_dir):
    return R.rank_candidates(view(spark, sf_dir, "CAND")).select("document_id", "kind", "url", "source", "challenged", "rank")


_LOC = "(SELECT *, offered_index = 1 AS is_best, CASE WHEN kind = 'pdf' THEN url END AS pdf_url FROM {CAND} c0)"


@query(
    "rank_oa_locations",
    f"""SELECT document_id, url, row_number() OVER (PARTITION BY document_id ORDER BY later, h, v, name, offered_index) AS rank FROM
    (SELECT *, row_number() OVER (PARTITION BY document_id, pdf_url, url ORDER BY later, h, v, name, offered_index) AS again FROM
     (SELECT *, (NOT is_best)::INT AS later, CASE WHEN is_best THEN 0 ELSE CASE host_type WHEN 'publisher' THEN 0 WHEN 'repository' THEN 1 ELSE 2 END END AS h, CASE WHEN is_best THEN 0 ELSE CASE version WHEN 'publishedVersion' THEN 0 WHEN 'acceptedVersion' THEN 1 WHEN 'submittedVersion' THEN 2 ELSE 3 END END AS v, coalesce(pdf_url, url, '') AS name FROM {_LOC} l)) WHERE again = 1""",
)
def rank_oa_locations(spark, sf_dir):
    loc = view(spark, sf_dir, "CAND").withColumns({"is_best": F.col("offered_index") == 1, "pdf_url": F.when(F.col("kind") == "pdf", F.col("url"))})
    return R.rank_oa_locations(loc).select("document_id", "url", "rank")


#: A url offered twice at one place succeeds if either does.
_ONCE = "(SELECT document_id, kind, url, source, offered_index, bool_or(succeeds) AS succeeds FROM {CAND} c0 GROUP BY ALL)"
_WALK = f"(SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY priority, rank, url) AS step FROM (SELECT *, row_number() OVER (PARTITION BY document_id, url ORDER BY priority, rank) AS seen FROM {_RANKED.replace('{CAND} c0', _ONCE + ' c1')} r WHERE kind = 'pdf') WHERE seen = 1)"


@query(
    "fallback_pick",
    f"""SELECT w.document_id, w.url, w.stage, coalesce(w.at, w.steps) AS tried, e.last_error_url FROM
    (SELECT document_id, arg_min(url, step) FILTER (succeeds) AS url, arg_min(priority, step) FILTER (succeeds) AS stage, min(step) FILTER (succeeds) AS at, max(step) AS steps FROM {_WALK} w0 GROUP BY document_id) w
    LEFT JOIN (SELECT x.document_id, arg_max(x.url, x.step) AS last_error_url FROM {_WALK} x JOIN (SELECT document_id, min(step) FILTER (succeeds) AS at FROM {_WALK} y GROUP BY document_id) z ON z.document_id = x.document_id WHERE z.at IS NULL OR x.step < z.at GROUP BY x.document_id) e ON e.document_id = w.document_id""",
)
def fallback_pick(spark, sf_dir):
    offered = R.by_document(view(spark, sf_dir, "CAND"))
    once = offered.groupBy("document_id", "kind", "url", "source", "offered_index").agg(F.bool_or("succeeds").alias("succeeds"))
    ranked = R.rank_candidates(once, dealt=True).where("kind = 'pdf'")
    return R.fallback_outcome(ranked, F.col("priority"))
