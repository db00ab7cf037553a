"""Queries over audits, payload checks and status logic."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import payload as P
from ..functions import status as T
from ..operators import audit as A
from .fixtures import table, view
from .registry import query
from .stats_queries import ARTIFACTS, FLAGGED, artifacts, docs


def files(spark, sf_dir):
    """Corpus files: those of most artifacts (some changed, some gone), sidecars, and strays."""
    a = artifacts(spark, sf_dir)
    own = a.where("size_bytes % 11 <> 0").select("document_id", "kind", F.sha2(F.when(F.col("size_bytes") % 13 == 0, "changed").otherwise(F.col("content_key")), 256).alias("sha256"))
    side = docs(spark, sf_dir).where("status = 'COMPLETED' AND document_id % 9 <> 0").select("document_id", F.lit("json").alias("kind"), F.sha2(F.col("document_id").cast("string"), 256).alias("sha256"))
    stray = docs(spark, sf_dir).where("document_id % 50 = 1").select((-F.col("document_id")).alias("document_id"), F.lit("pdf").alias("kind"), F.lit("x").alias("sha256"))
    return own.unionByName(side).unionByName(stray)


FILES = f"""(SELECT document_id, kind, sha256(CASE WHEN size_bytes % 13 = 0 THEN 'changed' ELSE content_key END) AS sha256 FROM {ARTIFACTS} a WHERE size_bytes % 11 <> 0
  UNION ALL SELECT document_id, 'json', sha256(CAST(document_id AS VARCHAR)) FROM {{DOC}} d WHERE status = 'COMPLETED' AND document_id % 9 <> 0
  UNION ALL SELECT -document_id, 'pdf', 'x' FROM {{DOC}} d2 WHERE document_id % 50 = 1)"""


def recorded(spark, sf_dir):
    return artifacts(spark, sf_dir).withColumn("sha256", F.sha2("content_key", 256))


@query("orphan_files", f"SELECT document_id, kind FROM {FILES} f WHERE document_id NOT IN (SELECT document_id FROM {{DOC}} d)")
def orphan_files(spark, sf_dir):
    return A.orphans(files(spark, sf_dir), docs(spark, sf_dir)).select("document_id", "kind")


@query("missing_artifacts", f"SELECT document_id, kind FROM {ARTIFACTS} a WHERE NOT EXISTS (SELECT 1 FROM {FILES} f WHERE f.document_id = a.document_id AND f.kind = a.kind)")
def missing_artifacts(spark, sf_dir):
    return A.missing(artifacts(spark, sf_dir), files(spark, sf_dir)).select("document_id", "kind")


_ROWS = "(SELECT sha256(concat_ws(chr(31), CAST(seq AS VARCHAR), provider, coalesce(title, chr(0)))) AS r FROM {OBS} o)"


@query(
    "ledger_digest",
    f"SELECT CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(d, ',' ORDER BY b)) AS digest FROM (SELECT b, sha256(string_agg(r, ',' ORDER BY r)) AS d, count(*) AS n FROM (SELECT r, ('0x' || left(r, 8))::BIGINT % 256 AS b FROM {_ROWS} x) GROUP BY b)",
)
def ledger_digest(spark, sf_dir):
    return A.ledger_digest(view(spark, sf_dir, "OBS"), ["seq", "provider", "title"])


@query("audit_columns", "SELECT 'documents' AS name, (SELECT count(*) FROM documents) AS found, CAST(-1 AS BIGINT) AS n, '' AS problems")
def audit_columns(spark, sf_dir):
    tables = {"documents": table(spark, sf_dir, "documents"), "labels": table(spark, sf_dir, "labels")}
    expected = {"documents": ["doc_id", "text", "lang", "source", "n_chars"], "labels": ["doc_id", "quality", "toxic"]}
    manifest = tables["labels"].agg(F.count("*").alias("n")).withColumn("name", F.lit("labels")).unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("n"), F.lit("documents").alias("name")))
    return A.audit_counts(tables, manifest).withColumn("problems", F.lit(";".join(A.audit_columns(tables, expected))))


_BAD_JSON = ("", "null", "[1]", '"text"', "7", "{", '{"a":}', "{'a':1}", '{"a":1}}', "[1,", "nul", "\ufeff{}")
_JSON_KINDS = {"OBJECT": "k = 12", "ARRAY": "k = 2", "": "k IN (1, 2, 3, 4, 12)"}


@query("audit_json", f"SELECT event_id, {', '.join(f'coalesce({rule}, {nullable})::BOOLEAN AS {name}' for name, rule, nullable in (('is_object', _JSON_KINDS['OBJECT'], 'false'), ('is_array', _JSON_KINDS['ARRAY'], 'false'), ('is_json', _JSON_KINDS[''], 'true')))} FROM (SELECT event_id, CASE WHEN event_id % 14 < 13 THEN event_id % 14 END AS k FROM events)")
def audit_json(spark, sf_dir):
    """Texts of every kind: empty, of other roots, cut short, with too much, in other quotes, NULL, and good objects (place 12)."""
    k = F.col("event_id") % 14
    bad = F.get(F.array(*[F.lit(t) for t in _BAD_JSON]), k.cast("int"))
    ev = table(spark, sf_dir, "events").withColumn("raw", F.when(k < 12, bad).when(k == 12, F.col("props")))
    return ev.select("event_id", A.audit_json(ev, "raw", "OBJECT").alias("is_object"), A.audit_json(ev, "raw", "ARRAY").alias("is_array"), A.audit_json(ev, "raw", "", nullable=True).alias("is_json"))


@query("audit_raw_sha", "SELECT seq, CASE WHEN title IS NULL AND seq % 2 = 0 THEN 'digest without raw text' WHEN title IS NULL THEN NULL WHEN seq % 2 = 1 THEN 'raw text without digest' WHEN seq % 4 = 0 THEN 'digest mismatch' END AS problem FROM {OBS} o")
def audit_raw_sha(spark, sf_dir):
    o = view(spark, sf_dir, "OBS")
    sha = F.when(F.col("seq") % 2 == 1, None).when((F.col("seq") % 4 == 0) | F.col("title").isNull(), "00").otherwise(F.sha2("title", 256))
    return o.select("seq", A.audit_raw_sha(F.col("title"), sha).alias("problem"))


@query(
    "audit_foreign_keys",
    "SELECT 'artifacts.document_id' AS reference, CAST(document_id AS VARCHAR) AS value, count(*) AS rows FROM {ART} a WHERE document_id NOT IN (SELECT document_id FROM {DOC} d WHERE document_id % 20 <> 0) GROUP BY document_id UNION ALL SELECT 'events.document_id', CAST(document_id AS VARCHAR), count(*) FROM {EVT} e WHERE document_id NOT IN (SELECT document_id FROM {DOC} d2 WHERE document_id % 20 <> 0) GROUP BY document_id",
)
def audit_foreign_keys(spark, sf_dir):
    known = docs(spark, sf_dir).where("document_id % 20 <> 0")
    tables = {"artifacts": view(spark, sf_dir, "ART"), "events": view(spark, sf_dir, "EVT"), "documents": known}
    return A.audit_foreign_keys(tables, [("artifacts", "document_id", "documents", "document_id"), ("events", "document_id", "documents", "document_id")])


@query("audit_unique", "SELECT document_id, kind, seq, count(*) AS n, false AS empty FROM (SELECT document_id, kind, seq % 3 AS seq FROM {ART} a) GROUP BY ALL HAVING count(*) > 1")
def audit_unique(spark, sf_dir):
    return A.audit_unique(view(spark, sf_dir, "ART").withColumn("seq", F.col("seq") % 3), ["document_id", "kind", "seq"])


_ALLOWED = ", ".join(f"'{a}>{b}'" for a, targets in A.ALLOWED.items() for b in targets)


@query("audit_transitions", f"SELECT document_id, id, previous, target_status AS status FROM (SELECT *, lag(target_status) OVER (PARTITION BY document_id ORDER BY id) AS previous FROM {{EVT}} e) WHERE previous IS NOT NULL AND previous <> target_status AND previous || '>' || target_status NOT IN ({_ALLOWED})")
def audit_transitions(spark, sf_dir):
    return A.audit_transitions(view(spark, sf_dir, "EVT").select("document_id", "id", F.col("target_status").alias("status"))).select("document_id", "id", "previous", "status")


@query(
    "verify_corpus",
    f"""SELECT document_id, 'json' AS kind, 'missing sidecar' AS problem FROM {{DOC}} d WHERE status = 'COMPLETED' AND NOT EXISTS (SELECT 1 FROM {FILES} f WHERE f.document_id = d.document_id AND kind = 'json')
    UNION ALL SELECT document_id, 'pdf', 'completed without pdf' FROM {{DOC}} d2 WHERE status = 'COMPLETED' AND NOT EXISTS (SELECT 1 FROM {ARTIFACTS} a WHERE a.document_id = d2.document_id AND kind = 'pdf')
    UNION ALL SELECT a.document_id, a.kind, CASE WHEN f.sha256 IS NULL THEN 'missing file' ELSE 'sha256 mismatch' END FROM {ARTIFACTS} a LEFT JOIN {FILES} f ON f.document_id = a.document_id AND f.kind = a.kind WHERE f.sha256 IS NULL OR f.sha256 <> sha256(a.content_key)
    UNION ALL SELECT document_id, kind, 'orphan' FROM {FILES} f WHERE document_id NOT IN (SELECT document_id FROM {{DOC}} d3)""",
)
def verify_corpus(spark, sf_dir):
    return A.verify(docs(spark, sf_dir), recorded(spark, sf_dir), files(spark, sf_dir))


@query("verify_history", "SELECT run_id, checked_at, problems FROM (SELECT run_id, max(updated_at) AS checked_at, count(*) FILTER (status LIKE 'FAILED%') AS problems FROM {DOC} d GROUP BY run_id) ORDER BY checked_at DESC, run_id DESC LIMIT 10")
def verify_history(spark, sf_dir):
    v = docs(spark, sf_dir).groupBy("run_id").agg(F.max("updated_at").alias("checked_at"), F.count_if(F.col("status").startswith("FAILED")).alias("problems")).withColumn("id", F.col("run_id"))
    return A.verify_history(v, 10).select("run_id", "checked_at", "problems")


@query(
    "evidence_triplets",
    "SELECT doc_id AS evidence_id, CASE WHEN doc_id % 7 = 1 THEN 'not_found' WHEN doc_id % 7 = 2 THEN 'incomplete' WHEN doc_id % 7 = 3 THEN 'integrity_failure' WHEN doc_id % 7 = 4 THEN 'receipt_mismatch' ELSE 'ok' END AS status FROM documents",
)
def evidence_triplets(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents"), F.col("evidence_id") % 7
    rows = d.select(F.col("doc_id").alias("evidence_id"), F.explode(F.array(F.lit("pdf"), F.lit("xml"), F.lit("json"))).alias("name"), F.sha2("text", 256).alias("sha256"))
    manifests = rows.where(k != 1)
    found = rows.where((k != 2) | (F.col("name") != "xml")).withColumn("sha256", F.when((k == 3) & (F.col("name") == "pdf"), "0").otherwise(F.col("sha256")))
    receipts = d.select(F.col("doc_id").alias("evidence_id"), F.when(F.col("doc_id") % 7 == 4, "0").otherwise(F.sha2(F.concat_ws(",", *[F.sha2("text", 256)] * 3), 256)).alias("digest"))
    return A.verify_triplets(manifests, found, receipts)


@query(
    "idempotency_gate",
    f"SELECT document_id, CASE WHEN whole AND sidecar THEN 'skip' WHEN whole THEN 'rewrite_sidecar' WHEN done THEN 'requeue' ELSE 'acquire' END AS action FROM (SELECT document_id, status = 'COMPLETED' AS done, status = 'COMPLETED' AND EXISTS (SELECT 1 FROM {ARTIFACTS} a WHERE a.document_id = d.document_id AND a.kind = 'pdf') AND EXISTS (SELECT 1 FROM {FILES} f WHERE f.document_id = d.document_id AND f.kind = 'pdf') AS whole, EXISTS (SELECT 1 FROM {FILES} f WHERE f.document_id = d.document_id AND f.kind = 'json') AS sidecar FROM {{DOC}} d)",
)
def idempotency_gate(spark, sf_dir):
    return A.plan_work(docs(spark, sf_dir), artifacts(spark, sf_dir), files(spark, sf_dir))


@query("adopt_orphans", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'adopt' ELSE 'discard' END AS action FROM {PAGE} p WHERE page_id % 3 <> 0 AND length(payload) > 0")
def adopt_orphans(spark, sf_dir):
    p = view(spark, sf_dir, "PAGE").select(F.col("page_id").alias("document_id"), F.lit("pdf").alias("kind"), F.col("payload").cast("binary").alias("content"))
    there = p.where("document_id % 3 = 0")
    return A.adopt(p, there, P.classify_payload(F.col("kind"), F.col("content"), 64)).select(F.col("document_id").alias("page_id"), "action")


@query("secret_leak_scan", "SELECT 'documents' AS \"table\", 'text' AS \"column\", count(*) AS rows FROM documents WHERE contains(text, '@') HAVING count(*) > 0 UNION ALL SELECT 'pages', 'url', count(*) FROM pages WHERE contains(url, '?') OR contains(url, '@') HAVING count(*) > 0 UNION ALL SELECT 'pages', 'html', count(*) FROM pages WHERE contains(html, '@') OR contains(html, '?') HAVING count(*) > 0")
def secret_leak_scan(spark, sf_dir):
    d = A.leak_scan({"documents": table(spark, sf_dir, "documents").select("doc_id", "text")}, ["@"])
    return d.unionByName(A.leak_scan({"pages": table(spark, sf_dir, "pages")}, ["?", "@"]))


_HTML = "regexp_matches(lower(left(ltrim(payload, ' \t\n\r'), 20)), '^(<!doctype html|<html|<head|<body)')"


def _payloads(spark, sf_dir):
    return view(spark, sf_dir, "PAGE").withColumn("content", F.col("payload").cast("binary"))


@query("sniff_html", f"SELECT page_id, {_HTML} AS is_html FROM {{PAGE}} p")
def sniff_html(spark, sf_dir):
    return _payloads(spark, sf_dir).select("page_id", P.looks_like_html(F.col("content")).alias("is_html"))


@query("sniff_challenge", "SELECT page_id, page_id % 6 = 0 AS challenge FROM {PAGE} p")
def sniff_challenge(spark, sf_dir):
    body = F.concat(F.when(F.col("page_id") % 6 == 0, "<script>POW_challenge</script>").otherwise(""), F.col("payload")).cast("binary")
    return _payloads(spark, sf_dir).select("page_id", P.looks_like_challenge(body).alias("challenge"))


@query(
    "classify_payload",
    f"SELECT page_id, CASE WHEN payload LIKE '%PDF-%' AND left(payload, 5) = '%PDF-' THEN CASE WHEN strlen(payload) < 300 THEN 'TOO_SMALL' WHEN NOT contains(payload, '%%EOF') THEN 'TRUNCATED' ELSE 'OK' END WHEN {_HTML} THEN 'HTML_PAGE' ELSE 'BAD_MAGIC' END AS pdf_verdict, CASE WHEN {_HTML} THEN 'HTML_PAGE' WHEN NOT regexp_matches(payload, '^\\s*<') THEN 'NO_MARKUP' WHEN strlen(payload) < 300 THEN 'TOO_SMALL' ELSE 'OK' END AS xml_verdict FROM {{PAGE}} p",
)
def classify_payload(spark, sf_dir):
    p = _payloads(spark, sf_dir)
    return p.select("page_id", P.classify_payload(F.lit("pdf"), F.col("content"), 300).alias("pdf_verdict"), P.classify_payload(F.lit("xml"), F.col("content"), 300).alias("xml_verdict"))


_XML = """CASE page_id % 6 WHEN 0 THEN '<article n="' || page_id || '"><p>text</p></article>' WHEN 1 THEN '<article>' || page_id || '<p>cut' WHEN 2 THEN '<!DOCTYPE a [<!ENTITY x "y">]><a>&x;' || page_id || '</a>'
    WHEN 3 THEN '<?xml version="1.0"?><page>' || replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</page>' WHEN 4 THEN '<a/><b>' || page_id || '</b>' ELSE '' END"""


@query(
    "xml_wellformed",
    """SELECT page_id, page_id % 6 IN (0, 3) AS well_formed, CASE page_id % 6 WHEN 0 THEN 'article' WHEN 3 THEN 'page' END AS root,
    CASE page_id % 6 WHEN 0 THEN NULL WHEN 3 THEN NULL WHEN 2 THEN 'unsafe entity' ELSE 'not well-formed' END AS problem FROM {PAGE} p""",
)
def xml_wellformed(spark, sf_dir):
    pages = view(spark, sf_dir, "PAGE").select("page_id", F.expr(_XML).cast("binary").alias("content"))
    return P.xml_wellformed(pages, "page_id", "content")


@query(
    "content_type_plausible",
    "SELECT id, CASE WHEN ct = '' THEN true WHEN kind = 'pdf' THEN split_part(ct, ';', 1) IN ('application/pdf', 'application/x-pdf', 'application/octet-stream') ELSE suffix(split_part(ct, ';', 1), '/xml') OR suffix(split_part(ct, ';', 1), '+xml') OR split_part(ct, ';', 1) IN ('text/plain', 'application/octet-stream') END AS ok FROM (SELECT id, CASE WHEN ok THEN 'pdf' ELSE 'xml' END AS kind, CASE attempt_no WHEN 1 THEN 'application/pdf;q=1' WHEN 2 THEN 'application/jats+xml' WHEN 3 THEN '' ELSE 'text/html' END AS ct FROM {EVT} e)",
)
def content_type_plausible(spark, sf_dir):
    n = F.col("attempt_no")
    ct = F.when(n == 1, "Application/PDF ;q=1").when(n == 2, "application/jats+xml").when(n == 3, "").otherwise("text/html")
    return view(spark, sf_dir, "EVT").select("id", P.content_type_ok(F.when(F.col("ok"), "pdf").otherwise("xml"), ct).alias("ok"))


@query("content_digest", "SELECT page_id, sha256(payload) AS sha256, strlen(payload) AS size_bytes FROM {PAGE} p")
def content_digest(spark, sf_dir):
    return _payloads(spark, sf_dir).select("page_id", P.content_digest(F.col("content")).alias("d")).select("page_id", "d.*")


_CLASS = """CASE WHEN http_status < 400 THEN NULL WHEN http_status IN (429,409,402,403) AND (coalesce(remaining <= 0, false) OR body IN ('daily credit limit reached', 'quota exceeded')) THEN 'BUDGET_EXHAUSTED' WHEN http_status = 429 THEN 'RATE_LIMITED' WHEN http_status IN (401,403) THEN 'AUTHENTICATION_ERROR'
 WHEN http_status = 404 THEN 'NOT_FOUND' WHEN http_status IN (400,405,406,410,414,422,451) THEN 'HTTP_ERROR' WHEN http_status IN (408,425) OR http_status BETWEEN 500 AND 599 THEN 'PROVIDER_ERROR' ELSE 'HTTP_ERROR' END"""


@query("classify_response", f"SELECT id, {_CLASS} AS category, coalesce({_CLASS} IN ('RATE_LIMITED', 'PROVIDER_ERROR'), false) AS retryable FROM {{EVT}} e")
def classify_response(spark, sf_dir):
    c = T.classify_response(F.col("http_status"), F.col("remaining"), F.col("body"))
    return view(spark, sf_dir, "EVT").select("id", c.alias("c")).select("id", "c.*")


@query("permanent_category", "SELECT id, coalesce(category IN ('NOT_FOUND', 'INVALID_PDF', 'NO_OA_LOCATION'), false) AS permanent FROM {EVT} e")
def permanent_category(spark, sf_dir):
    return view(spark, sf_dir, "EVT").select("id", T.is_permanent(F.col("category")).alias("permanent"))


@query("retry_after", "SELECT id, CASE attempt_no WHEN 1 THEN 30.0 WHEN 2 THEN 60.0 WHEN 3 THEN 120.0 END AS seconds FROM {EVT} e")
def retry_after(spark, sf_dir):
    n = F.col("attempt_no")
    header = F.when(n == 1, " 30 ").when(n == 2, "Wed, 21 Oct 2015 07:29:00 GMT").when(n == 3, "99999").otherwise("soon")
    now = F.to_timestamp(F.lit("2015-10-21 07:28:00"))
    return view(spark, sf_dir, "EVT").select("id", T.retry_after(header, now, 120).alias("seconds"))


@query("backoff_delay", "SELECT id, CASE WHEN remaining IS NOT NULL THEN remaining::DOUBLE ELSE least(10.0, 2 * pow(2, attempt_no - 1)) * 0.75 END AS low, CASE WHEN remaining IS NOT NULL THEN remaining::DOUBLE ELSE least(10.0, 2 * pow(2, attempt_no - 1)) * 1.25 END AS high FROM {EVT} e")
def backoff_delay(spark, sf_dir):
    b = T.backoff(F.col("attempt_no"), 2.0, 2.0, 10.0, F.col("remaining").cast("double"), 0.25)
    return view(spark, sf_dir, "EVT").select("id", b.alias("b")).select("id", "b.*")


@query("failure_target", "SELECT id, CASE WHEN retryable AND attempt_no + 1 < 4 THEN 'FAILED_RETRYABLE' ELSE 'FAILED_PERMANENT' END AS target FROM {EVT} e")
def failure_target(spark, sf_dir):
    return view(spark, sf_dir, "EVT").select("id", T.failure_target(F.col("retryable"), F.col("attempt_no"), 4).alias("target"))


@query("document_outcome", f"SELECT document_id, CASE WHEN has_pdf AND has_xml THEN 'COMPLETED' WHEN has_pdf THEN 'FAILED_PERMANENT' WHEN claimed AND attempts + 1 < 3 THEN 'FAILED_RETRYABLE' ELSE 'FAILED_PERMANENT' END AS status, has_xml AND NOT has_pdf AS partial_fulltext, CASE WHEN has_pdf AND has_xml THEN NULL WHEN has_pdf THEN 'NOT_FOUND' ELSE 'NO_OA_LOCATION' END AS error FROM {FLAGGED} f")
def document_outcome(spark, sf_dir):
    from ..operators.stats import artifact_flags

    c = F.col
    out = T.document_outcome(c("has_pdf"), c("has_xml"), c("claimed"), c("attempts"), 3, "required")
    return artifact_flags(docs(spark, sf_dir), artifacts(spark, sf_dir)).select("document_id", out.alias("o")).select("document_id", "o.*")


@query("requeue_failed", "SELECT document_id, CASE WHEN r THEN 'QUEUED' ELSE status END AS status, CASE WHEN r THEN false ELSE claimed END AS claimed, r AS requeued FROM (SELECT *, status IN ('FAILED_RETRYABLE','FAILED_PERMANENT','SKIPPED','ACQUIRING','VALIDATING') AND document_id % 3 = 0 AS r FROM {DOC} d)")
def requeue_failed(spark, sf_dir):
    d = docs(spark, sf_dir)
    return T.requeue(d, d.where("document_id % 3 = 0")).select("document_id", "status", "claimed", "requeued")


@query("claimable", "SELECT document_id, status FROM {DOC} d WHERE status IN ('DISCOVERED','NORMALIZED','QUEUED','FAILED_RETRYABLE') AND NOT claimed")
def claimable(spark, sf_dir):
    return T.claimable(docs(spark, sf_dir)).select("document_id", "status")


