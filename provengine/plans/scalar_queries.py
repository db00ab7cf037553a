"""Queries over the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from .fixtures import table, view
from .registry import query

_DOI = "regexp_replace(regexp_replace(regexp_replace(lower(trim(raw_doi)), '^\\((.*)\\)$', '\\1'), '^(https://doi.org/|info:doi/|doi:)', ''), '[.]+$', '')"
_SLUG = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
_DOC_ID = f"CASE WHEN raw_doi IS NOT NULL THEN 'doi_' || {_SLUG.format(_DOI)} || '_' || left(sha256({_DOI}), 12) ELSE {_SLUG.format('provider')} || '_' || {_SLUG.format('source_id')} || '_' || left(sha256(provider || ':' || source_id), 12) END"


def identified(spark, sf_dir):
    """Observations with canonical doi and document_id."""
    return S.assign_identity(view(spark, sf_dir, "OBS").withColumn("doi", S.normalize_doi("raw_doi")))


#: The same in DuckDB.
IDENTIFIED = f"(SELECT *, {_DOI} AS doi, {_DOC_ID} AS document_id FROM {{OBS}} o0)"


@query("normalize_doi", f"SELECT seq, {_DOI} AS doi FROM {{OBS}} o")
def normalize_doi(spark, sf_dir):
    return view(spark, sf_dir, "OBS").select("seq", S.normalize_doi("raw_doi").alias("doi"))


#: Spellings, # for a number, and whether each is a DOI's.
_SPELLINGS = (
    ("https://doi.org/10.1234/A#", True), ("http://dx.doi.org/10.1234/#", True), ("<10.1234/#>", True), ("10.1234/#.,;", True), ("DOI:10.1234/ABC#", True), ("10.1234/foo(bar#)", True), ("10.1234/a:#;c", True),
    ("10.12/#", False), ("10.1234", False), ("10.1234/", False), ("doi:", False), ("not-a-doi #", False), ("https://example.org/#", False), ("11.1234/#", False), ("10.abcd/#", False), ("", False), ("   ", False), (None, False),
)


@query("is_valid_doi", f"SELECT seq, ([{', '.join(str(good).lower() for _, good in _SPELLINGS)}])[seq % {len(_SPELLINGS)} + 1] AS valid FROM {{OBS}} o")
def is_valid_doi(spark, sf_dir):
    spelling = F.get(F.array(*[F.lit(text).cast("string") for text, _ in _SPELLINGS]), (F.col("seq") % len(_SPELLINGS)).cast("int"))
    return view(spark, sf_dir, "OBS").select("seq", S.is_valid_doi(F.replace(spelling, F.lit("#"), F.col("seq").cast("string"))).alias("valid"))


@query("slugify", f"SELECT doc_id, {_SLUG.format('text')} AS slug FROM documents")
def slugify(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.slugify("text").alias("slug"))


@query("document_id", f"SELECT seq, 'doi_' || {_SLUG.format(_DOI)} || '_' || left(sha256({_DOI}), 12) AS document_id FROM {{OBS}} o")
def document_id(spark, sf_dir):
    return view(spark, sf_dir, "OBS").select("seq", S.document_id_for_doi(S.normalize_doi("raw_doi")).alias("document_id"))


@query("document_id_source", f"SELECT seq, document_id FROM {IDENTIFIED} o")
def document_id_source(spark, sf_dir):
    return identified(spark, sf_dir).select("seq", "document_id")


@query("safe_document_id", f"SELECT seq, regexp_matches(document_id, '^[a-z0-9][a-z0-9_]{{0,199}}$') AS safe, coalesce(regexp_matches(raw_doi, '^[a-z0-9][a-z0-9_]{{0,199}}$'), false) AS raw_safe FROM {IDENTIFIED} o")
def safe_document_id(spark, sf_dir):
    return identified(spark, sf_dir).select("seq", S.is_safe_document_id("document_id").alias("safe"), S.is_safe_document_id("raw_doi").alias("raw_safe"))


@query(
    "pmcid_from_urls",
    "SELECT document_id, CASE WHEN count(DISTINCT pmc) = 1 THEN max(pmc) END AS pmcid FROM (SELECT document_id, nullif(regexp_extract(url, '^https://pmc[.]ncbi[.]nlm[.]nih[.]gov/articles/(PMC[0-9]+)/', 1), '') AS pmc FROM {CAND} c) GROUP BY document_id",
)
def pmcid_from_urls(spark, sf_dir):
    urls = view(spark, sf_dir, "CAND").groupBy("document_id").agg(F.collect_list("url").alias("urls"))
    return urls.select("document_id", S.pmcid_from_urls("urls").alias("pmcid"))


_LITERAL = """CASE page_id % 12 WHEN 0 THEN '[::ffff:10.' || k || '.0.1]' WHEN 1 THEN '[2001:db8::' || k || ']' WHEN 2 THEN '[2001:4860::' || k || ']' WHEN 3 THEN '[0:0:0:0:0:0:0:1]' WHEN 4 THEN '[::ffff:8.8.' || k || '.8]'
    WHEN 5 THEN '[fd12:' || k || '::]' WHEN 6 THEN '2130706433' WHEN 7 THEN '0x8.8.' || k || '.010' WHEN 8 THEN '10.' || k || '.1' WHEN 9 THEN '[fe80::' || k || ']' WHEN 10 THEN '100.64.' || k || '.1' ELSE '240.0.' || k || '.1' END"""


@query(
    "url_safety",
    """SELECT page_id, CASE WHEN test_url IS NULL OR test_url = '' THEN 'empty' WHEN regexp_matches(test_url, '\\s') THEN 'whitespace' WHEN NOT regexp_matches(lower(test_url), '^https?:') THEN 'scheme'
    WHEN contains(regexp_extract(test_url, '^[a-zA-Z]+://([^/?#]*)', 1), '@') THEN 'credentials' WHEN regexp_extract(test_url, '^[a-zA-Z]+://([^/?#]*)', 1) = '127.0.0.1' THEN 'private target' ELSE 'ok' END AS reason,
    CASE WHEN page_id % 12 IN (2, 4, 7, 10) THEN 'ok' ELSE 'private target' END AS literal FROM {PAGE} p""",
)
def url_safety(spark, sf_dir):
    p = view(spark, sf_dir, "PAGE").select("page_id", "test_url", (F.col("page_id") % 200).cast("string").alias("k"))
    literal = F.concat(F.lit("http://"), F.expr(_LITERAL), F.lit("/x"))
    return p.select("page_id", S.url_safety("test_url").alias("reason"), S.url_safety(literal).alias("literal"))


@query(
    "redact_url",
    """SELECT page_id, CASE WHEN regexp_matches(u, '^[^#]*[?]') THEN regexp_extract(u, '^([^?#]*)', 1) || '?' ||
    array_to_string(list_transform(list_filter(string_split(regexp_extract(u, '^[^?#]*[?]([^#]*)', 1), '&'), lambda p: p <> ''),
      lambda p: split_part(p, '=', 1) || '=' || CASE WHEN lower(split_part(p, '=', 1)) IN ('api_key','apikey','key','token','access_token','email') AND split_part(p, '=', 2) <> '' THEN 'REDACTED' ELSE split_part(p, '=', 2) END), '&')
    || regexp_extract(u, '(#.*)$', 1) ELSE u END AS redacted
    FROM (SELECT page_id, regexp_replace(test_url, '^([a-zA-Z]+://)[^/?#]*@', '\\1') AS u FROM {PAGE} p)""",
)
def redact_url(spark, sf_dir):
    return view(spark, sf_dir, "PAGE").select("page_id", S.redact_url("test_url").alias("redacted"))


@query(
    "scrub_text",
    """SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '((?:api_key|apikey|access_token|token|key)=)([^&\\s"'']+)', '\\1REDACTED', 'gi'), '(email=)([^&\\s"'']+)', '\\1REDACTED', 'gi'), '(mailto:)([^\\s"''<>)]+)', '\\1REDACTED', 'gi'), '[\\p{L}\\p{N}_.+-]+@[\\p{L}\\p{N}_-]+\\.[\\p{L}\\p{N}_.-]*[\\p{L}\\p{N}_]', 'REDACTED', 'g') AS scrubbed FROM documents""",
)
def scrub_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.scrub("text").alias("scrubbed"))


@query(
    "scrub_nested",
    "SELECT event_id, 'REDACTED' AS token, json_extract_string(props, '$.k') AS k, CASE WHEN event_type = 'click' THEN 'REDACTED' ELSE event_type END AS inner_value, 'REDACTED' AS inner_email FROM events",
)
def scrub_nested(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("t-"), F.col("user_id").cast("string")).alias("token"),
        F.get_json_object("props", "$.k").alias("k"),
        F.array(F.struct(F.col("event_type").alias("value"), F.concat("event_type", F.lit("@x.org")).alias("email"))).alias("inner"),
    )
    out = S.scrub_nested(ev, secrets=("click",))
    return out.select("event_id", "token", "k", F.col("inner")[0]["value"].alias("inner_value"), F.col("inner")[0]["email"].alias("inner_email"))


@query(
    "mask_secret",
    "SELECT doc_id, repeat('*', 8) || CASE WHEN length(text) > 8 THEN right(text, 4) ELSE '' END AS masked, left(source, 1) || repeat('*', greatest(3, length(source) - 1)::INT) || '@example.org' AS masked_email FROM documents WHERE text <> ''",
)
def mask_secret(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text <> ''").select(
        "doc_id", S.mask_secret("text", "token").alias("masked"), S.mask_secret(F.concat("source", F.lit("@example.org")), "email").alias("masked_email")
    )


@query("clean_text", "SELECT doc_id, nullif(trim(regexp_replace(text, '[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x{85}]+', ' ', 'g')), '') AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.clean_text("text").alias("cleaned"))


@query("coerce_int", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(NULL AS BIGINT) AS bad FROM events")
def coerce_int(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", S.coerce_int(F.concat(F.lit(" "), F.get_json_object("props", "$.k"))).alias("k"), S.coerce_int(F.concat(F.get_json_object("props", "$.k"), F.lit(".0"))).alias("bad")
    )


@query("tri_bool", "SELECT document_id, CASE left(status, 1) WHEN 'C' THEN true WHEN 'F' THEN false END AS flag FROM {DOC} d")
def tri_bool(spark, sf_dir):
    letter = F.left(F.col("status"), F.lit(1))
    return view(spark, sf_dir, "DOC").select("document_id", S.yes_no(F.when(letter == "C", "Y").when(letter == "F", "N").otherwise("?")).alias("flag"))


@query("short_id", "SELECT page_id, list_extract(string_split(regexp_replace(test_url, '/+$', ''), '/'), -1) AS short FROM {PAGE} p")
def short_id(spark, sf_dir):
    return view(spark, sf_dir, "PAGE").select("page_id", S.short_id("test_url").alias("short"))


@query(
    "canonical_json_sha",
    """SELECT seq, sha256('{"doi":' || coalesce('"' || raw_doi || '"', 'null') || ',"provider":"' || provider || '","seq":' || seq || ',"source_id":"' || source_id || '"}') AS sha FROM {OBS} o""",
)
def canonical_json_sha(spark, sf_dir):
    obs = view(spark, sf_dir, "OBS").select("source_id", "seq", "provider", F.col("raw_doi").alias("doi"))
    return obs.select("seq", S.canonical_sha(obs, ["source_id", "seq", "provider", "doi"]).alias("sha"))


@query("compare_normalised", "SELECT seq, regexp_replace(replace(lower(nullif(trim(regexp_replace(title, '[\\s\\p{Z}]+', ' ', 'g')), '')), 'ß', 'ss'), '[.]+$', '') AS cmp FROM {OBS} o")
def compare_normalised(spark, sf_dir):
    return view(spark, sf_dir, "OBS").select("seq", S.norm_cmp("title").alias("cmp"))
