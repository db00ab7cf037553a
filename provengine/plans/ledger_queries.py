"""Queries over the merge and ledger operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import ledger as L
from .fixtures import table, view
from .registry import query
from .scalar_queries import IDENTIFIED, identified
from .stats_queries import ARTIFACTS, artifacts

_AUTHORS = "list_filter([author_1, author_2], lambda x: x IS NOT NULL)"
FULL = f"(SELECT *, CASE WHEN oa_status IS NOT NULL THEN provider END AS oa_status_source, {_AUTHORS} AS authors, [provider] AS discovered_via, CASE provider WHEN 'openalex' THEN 'discovery' WHEN 'europe_pmc' THEN 'cross_check' ELSE 'fallback' END AS path FROM {IDENTIFIED} i)"


def observations(spark, sf_dir):
    """Observations with all merged fields."""
    provider = F.col("provider")
    return identified(spark, sf_dir).withColumns(
        {
            "oa_status_source": F.when(F.col("oa_status").isNotNull(), provider), "authors": F.array_compact(F.array("author_1", "author_2")), "discovered_via": F.array("provider"),
            "path": F.when(provider == "openalex", "discovery").when(provider == "europe_pmc", "cross_check").otherwise("fallback"),
            "identifiers": F.map_filter(F.create_map(F.lit("doi"), F.col("doi"), provider, F.col("source_id")), lambda k, v: v.isNotNull()),
        }
    )


@query("dedup_documents", f"SELECT seq, document_id, run_id, d = 1 AS created, r = 1 AS newly_linked, r = 1 AND d > 1 AS preexisting FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY seq) AS d, row_number() OVER (PARTITION BY document_id, run_id ORDER BY seq) AS r FROM {IDENTIFIED} i)")
def dedup_documents(spark, sf_dir):
    return L.dedup(identified(spark, sf_dir)).select("seq", "document_id", "run_id", "created", "newly_linked", "preexisting")


@query("doi_binding_conflict", f"SELECT doi, document_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY seq) AS place FROM (SELECT doi, document_id, min(seq) AS seq FROM (SELECT doi, CASE WHEN seq % 7 = 0 THEN 'alt_' || document_id ELSE document_id END AS document_id, seq FROM {IDENTIFIED} i WHERE doi IS NOT NULL) GROUP BY doi, document_id)) WHERE place > 1")
def doi_binding_conflict(spark, sf_dir):
    obs = identified(spark, sf_dir)
    return L.doi_conflicts(obs.withColumn("document_id", F.when(F.col("seq") % 7 == 0, F.concat(F.lit("alt_"), "document_id")).otherwise(F.col("document_id"))))


@query("latest_source_record", f"SELECT document_id, provider, source_id, max(seq) AS seq, arg_max_null(title, seq) AS latest_any FROM {IDENTIFIED} i GROUP BY document_id, provider, source_id")
def latest_source_record(spark, sf_dir):
    return L.latest_source_records(identified(spark, sf_dir)).select("document_id", "provider", "source_id", "seq", F.col("title").alias("latest_any"))


_FIRST = ", ".join(f"arg_min({f}, seq) FILTER (coalesce(CAST({f} AS VARCHAR), '') <> '') AS {f}" for f in L.FIRST_WINS)
GOLDEN = f"(SELECT document_id, {_FIRST} FROM {FULL} f GROUP BY document_id)"


@query("merge_first_non_empty", f"SELECT * FROM {GOLDEN} g")
def merge_first_non_empty(spark, sf_dir):
    return L.first_values(observations(spark, sf_dir))


def _union_sql(field: str) -> str:
    return f"SELECT document_id, string_agg(v, '|' ORDER BY pos) AS {field} FROM (SELECT document_id, v, min(seq * 100 + i) AS pos FROM (SELECT document_id, seq, unnest({field}) AS v, generate_subscripts({field}, 1) AS i FROM {FULL} f) GROUP BY document_id, v) GROUP BY document_id"


@query("merge_ordered_union", f"SELECT a.document_id, a.authors, d.discovered_via FROM ({_union_sql('authors')}) a JOIN ({_union_sql('discovered_via')}) d ON d.document_id = a.document_id")
def merge_ordered_union(spark, sf_dir):
    out = L.ordered_unions(observations(spark, sf_dir), ("authors", "discovered_via"))
    return out.select("document_id", F.array_join("authors", "|").alias("authors"), F.array_join("discovered_via", "|").alias("discovered_via"))


@query(
    "merge_identifiers",
    f"SELECT document_id, string_agg(k || '=' || v, ',' ORDER BY k) AS identifiers FROM (SELECT document_id, k, arg_min(v, seq) AS v FROM (SELECT document_id, seq, 'doi' AS k, doi AS v FROM {IDENTIFIED} i UNION ALL SELECT document_id, seq, provider, source_id FROM {IDENTIFIED} j) WHERE v IS NOT NULL GROUP BY document_id, k) GROUP BY document_id",
)
def merge_identifiers(spark, sf_dir):
    out = L.merged_identifiers(observations(spark, sf_dir))
    pairs = F.transform(F.array_sort(F.map_entries("identifiers")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return out.select("document_id", F.array_join(pairs, ",").alias("identifiers"))


@query(
    "merge_candidates",
    "SELECT document_id, string_agg(kind || ' ' || url || ' ' || source, ',' ORDER BY pos, source, kind, url) AS candidates FROM (SELECT document_id, kind, url, arg_min(source, (offered_index, source)) AS source, min(offered_index) AS pos FROM {CAND} c GROUP BY document_id, kind, url) GROUP BY document_id",
)
def merge_candidates(spark, sf_dir):
    cand = view(spark, sf_dir, "CAND").select("document_id", "offered_index", F.col("source").alias("by"), "kind", "url", "source")
    out = L.merged_unique(cand, "document_id", ("url", "kind"), ("offered_index", "by"), "candidates")
    return out.select("document_id", F.array_join(F.transform("candidates", lambda c: F.concat_ws(" ", c["kind"], c["url"], c["source"])), ",").alias("candidates"))


@query(
    "merge_topics",
    "SELECT work, string_agg(topic_id || ':' || topic_name, ',' ORDER BY pos) AS topics FROM (SELECT work_no // 5 AS work, topic_id, arg_min(topic_name, work_no) AS topic_name, min(work_no) AS pos FROM {PART} p GROUP BY ALL) GROUP BY work",
)
def merge_topics(spark, sf_dir):
    rows = view(spark, sf_dir, "PART").select(F.floor(F.col("work_no") / 5).alias("work"), "work_no", "topic_id", "topic_name")
    out = L.merged_unique(rows, "work", ("topic_id",), ("work_no",), "topics")
    return out.select("work", F.array_join(F.transform("topics", lambda t: F.concat_ws(":", t["topic_id"], t["topic_name"])), ",").alias("topics"))


@query("merge_cross_checks", f"SELECT document_id, provider AS source, max(seq) AS seq, arg_max_null(journal, seq) AS journal FROM {IDENTIFIED} i GROUP BY document_id, provider")
def merge_cross_checks(spark, sf_dir):
    return L.latest_checks(identified(spark, sf_dir).select("document_id", F.col("provider").alias("source"), "seq", "journal"))


_W = "(PARTITION BY document_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _decision_sql(masked: bool) -> str:
    parts = []
    for f in L.FIRST_WINS:
        paths = ", ".join(f"'{p}'" for p, fields in L.PATH_FIELDS.items() if f in fields)
        own = f"nullif(CAST({f} AS VARCHAR), '')"
        use = f"CASE WHEN path IN ({paths}) THEN {own} END" if masked else own
        parts.append(f"SELECT document_id, seq, '{f}' AS field_name, first_value({use} IGNORE NULLS) OVER {_W} AS e, {own} AS i, {use} AS u, 'first_non_empty' AS policy FROM full_obs")
    scalars = f"SELECT document_id, seq, field_name, policy, e IS NULL AS no_old, i IS NULL AS no_new, coalesce(e, u) IS NOT DISTINCT FROM e AS keeps, coalesce(e, u) IS NOT DISTINCT FROM i AS takes, i IS NOT DISTINCT FROM e AS agrees FROM ({' UNION ALL '.join(parts)})"
    lists = []
    for f in ("authors", "discovered_via"):
        paths = ", ".join(f"'{p}'" for p, fields in L.PATH_FIELDS.items() if f in fields)
        use = f"CASE WHEN path IN ({paths}) THEN {f} ELSE [] END" if masked else f
        lists.append(f"SELECT document_id, seq, '{f}' AS field_name, coalesce(flatten(list({use}) OVER {_W}), []) AS e0, {f} AS i, {use} AS u FROM full_obs")
    distinct = lambda x: f"list_filter({x}, lambda x, k: list_position({x}, x) = k)"
    arrays = f"SELECT document_id, seq, field_name, 'ordered_unique_union' AS policy, len(e) = 0 AS no_old, len(i) = 0 AS no_new, c = e AS keeps, c = i AS takes, i = e AS agrees FROM (SELECT *, {distinct('eu')} AS c FROM (SELECT *, list_concat(e, u) AS eu FROM (SELECT *, {distinct('e0')} AS e FROM ({' UNION ALL '.join(lists)}))))"
    decided = f"SELECT *, CASE WHEN no_old AND no_new THEN 'NO_VALUE' WHEN no_old AND takes THEN 'SELECTED' WHEN keeps AND agrees THEN 'CONFIRMED' WHEN keeps THEN 'RETAINED' WHEN takes THEN 'SELECTED' ELSE 'COMBINED' END AS decision FROM ({scalars} UNION ALL {arrays})"
    w = "(PARTITION BY document_id, field_name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    prev = f"SELECT *, coalesce(last_value(CASE WHEN decision = 'SELECTED' THEN seq END IGNORE NULLS) OVER {w}, first_value(CASE WHEN decision = 'CONFIRMED' THEN seq END IGNORE NULLS) OVER {w}) AS prev FROM ({decided})"
    return f"WITH full_obs AS (SELECT * FROM {FULL} f) SELECT document_id, seq, field_name, policy, decision, CASE decision WHEN 'SELECTED' THEN seq WHEN 'CONFIRMED' THEN coalesce(prev, seq) WHEN 'COMBINED' THEN NULL ELSE prev END AS chosen_observation FROM ({prev})"


_DECIDED = (*L.FIRST_WINS, "authors", "discovered_via")


@query("merge_decisions", _decision_sql(False))
def merge_decisions(spark, sf_dir):
    return L.merge_decisions(observations(spark, sf_dir), _DECIDED).select("document_id", "seq", "field_name", "policy", "decision", "chosen_observation")


@query("merge_path_mask", _decision_sql(True))
def merge_path_mask(spark, sf_dir):
    return L.merge_decisions(L.merge_mask(observations(spark, sf_dir)), _DECIDED).select("document_id", "seq", "field_name", "policy", "decision", "chosen_observation")


@query("chosen_observation", f"SELECT document_id, field_name, max(seq) AS last_seq, arg_max_null(chosen_observation, seq) AS chosen_observation FROM ({_decision_sql(False)}) GROUP BY document_id, field_name")
def chosen_observation(spark, sf_dir):
    rows = L.merge_decisions(observations(spark, sf_dir), _DECIDED)
    return rows.groupBy("document_id", "field_name").agg(F.max("seq").alias("last_seq"), F.max_by("chosen_observation", "seq").alias("chosen_observation"))


@query("decisions_for_doc", f"SELECT document_id, seq, decision FROM ({_decision_sql(False)}) WHERE field_name = 'title' AND document_id IN (SELECT document_id FROM {IDENTIFIED} i WHERE pub_no % 2 = 0)")
def decisions_for_doc(spark, sf_dir):
    from ..operators.stats import rows_of_publications

    obs = observations(spark, sf_dir)
    rows = L.merge_decisions(obs, ("title",))
    return rows_of_publications(obs.where("pub_no % 2 = 0").select("document_id"), rows, "document_id").select("document_id", "seq", "decision")


@query("ledger_identities", f"SELECT 'work_' || document_id AS work_id, 'publication_' || document_id AS publication_id, document_id, arg_min(doi, seq) AS doi, min(seq) AS created_seq FROM {IDENTIFIED} i GROUP BY document_id")
def ledger_identities(spark, sf_dir):
    return L.identities(identified(spark, sf_dir))


@query("observation_rows", "SELECT seq, CASE WHEN seq % 5 <> 0 THEN sha256('{\"id\":' || seq || '}') END AS raw_sha256, CASE WHEN seq % 5 <> 0 THEN 'RAW_AND_NORMALIZED' ELSE 'NORMALIZED_ONLY' END AS evidence_quality FROM {OBS} o")
def observation_rows(spark, sf_dir):
    raw = F.when(F.col("seq") % 5 != 0, F.concat(F.lit('{"id":'), F.col("seq").cast("string"), F.lit("}")))
    return L.observation_rows(view(spark, sf_dir, "OBS").withColumn("raw_json", raw)).select("seq", "raw_sha256", "evidence_quality")


@query("files_by_content", "SELECT 'sha256_' || sha256(text) AS file_id, CAST(min(strlen(text)) AS BIGINT) AS size_bytes, arg_min(lang, (doc_id, lang)) AS kind, min(doc_id) AS first_seen, count(*) AS copies, count(DISTINCT lang) > 1 AS conflict FROM documents GROUP BY text")
def files_by_content(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return L.files_by_content(docs.select(F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size_bytes"), F.col("lang").alias("kind"), F.col("doc_id").alias("first_seen")))


@query(
    "acquisition_rows",
    """SELECT DISTINCT 'acquisition_' || sha256('{"content_key":"' || content_key || '","document_id":' || document_id || ',"kind":"' || kind || '","source":"' || source || '"}') AS acquisition_id, document_id, kind, content_key, source FROM {ART} a""",
)
def acquisition_rows(spark, sf_dir):
    return L.acquisitions_from(view(spark, sf_dir, "ART")).select("acquisition_id", "document_id", "kind", "content_key", "source")


@query("latest_artifact", f"SELECT document_id, kind, size_bytes, content_key, source FROM {ARTIFACTS} a")
def latest_artifact(spark, sf_dir):
    return artifacts(spark, sf_dir)


_BACK = "(SELECT document_id, 'status' AS field_name, status AS value FROM {DOC} d UNION ALL SELECT document_id, 'journal', journal FROM {DOC} d2 UNION ALL SELECT document_id, 'oa_status', oa_status FROM {DOC} d3)"


@query("legacy_backfill", f"SELECT 'decision_' || sha256('migrated' || chr(31) || document_id || chr(31) || field_name) AS decision_id, document_id, field_name, value, 'MIGRATED_CURRENT_VALUE' AS decision FROM {_BACK} b WHERE document_id % 10 <> 0")
def legacy_backfill(spark, sf_dir):
    d = view(spark, sf_dir, "DOC")
    fields = ("status", "journal", "oa_status")
    empty = d.limit(0).select(F.col("status").alias("decision_id"))
    there = L.backfill(d.where("document_id % 10 = 0"), empty, fields).select("decision_id")
    return L.backfill(d, there, fields)


@query(
    "append_facts",
    "SELECT request_id, arg_min(status, seq) AS status, min(seq) AS seq FROM (SELECT id - id % 3 AS request_id, CASE attempt_no WHEN 1 THEN 'HIT' WHEN 2 THEN 'NO_HIT' WHEN 3 THEN 'ERROR' ELSE 'BOGUS' END AS status, id AS seq FROM {EVT} e) WHERE status <> 'BOGUS' AND request_id IN (SELECT id FROM {EVT} e2 WHERE id % 2 = 0) AND request_id % 5 <> 0 GROUP BY request_id",
)
def append_facts(spark, sf_dir):
    e = view(spark, sf_dir, "EVT")
    requests = e.where("id % 2 = 0").select(F.col("id").alias("request_id"))
    existing = e.where("id % 5 = 0").select(F.col("id").alias("request_id"))
    n = F.col("attempt_no")
    new = e.select((F.col("id") - F.col("id") % 3).alias("request_id"), F.when(n == 1, "HIT").when(n == 2, "NO_HIT").when(n == 3, "ERROR").otherwise("BOGUS").alias("status"), F.col("id").alias("seq"))
    return L.append_outcomes(requests, existing, new).select("request_id", "status", "seq")


@query(
    "merge_unpaywall",
    f"SELECT g.document_id, CASE WHEN coalesce(g.oa_status, '') = '' AND r.oa_status <> '' THEN r.oa_status ELSE g.oa_status END AS oa_status, CASE WHEN coalesce(g.oa_status, '') = '' AND r.oa_status <> '' THEN 'unpaywall' ELSE g.oa_status_source END AS oa_status_source, CASE WHEN r.document_id IS NOT NULL THEN 'openalex|unpaywall' ELSE 'openalex' END AS discovered_via FROM (SELECT document_id, arg_min(oa_status, seq) FILTER (seq % 2 = 0) AS oa_status, arg_min(oa_status_source, seq) FILTER (seq % 2 = 0 AND oa_status IS NOT NULL) AS oa_status_source FROM {FULL} f GROUP BY document_id) g LEFT JOIN (SELECT document_id, max(oa_status) AS oa_status FROM {FULL} f2 WHERE provider = 'unpaywall' GROUP BY document_id) r ON r.document_id = g.document_id",
)
def merge_unpaywall(spark, sf_dir):
    obs = observations(spark, sf_dir)
    even = F.when((F.col("seq") % 2 == 0) & F.col("oa_status").isNotNull(), F.col("seq"))
    canon = obs.groupBy("document_id").agg(F.min_by("oa_status", even).alias("oa_status"), F.min_by("oa_status_source", even).alias("oa_status_source")).withColumn("discovered_via", F.array(F.lit("openalex")))
    record = obs.where("provider = 'unpaywall'").groupBy("document_id").agg(F.max("oa_status").alias("oa_status"))
    return L.apply_fallback(canon, record).withColumn("discovered_via", F.array_join("discovered_via", "|"))


_CMP = "regexp_replace(replace(lower(nullif(trim(regexp_replace(CAST({0} AS VARCHAR), '[\\s\\p{{Z}}]+', ' ', 'g')), '')), 'ß', 'ss'), '[.]+$', '')"


_CHECKED = ("title", "journal", "publication_year")
_CHECK_CANON = f"(SELECT g.*, CASE WHEN pub % 3 = 0 THEN 'p' || pub END AS pmid, CASE WHEN pub % 4 = 0 THEN 'PMC' || pub END AS pmcid FROM {GOLDEN} g JOIN (SELECT document_id, min(pub_no) AS pub FROM {IDENTIFIED} i2 GROUP BY document_id) USING (document_id))"
_CHECK_OTHER = f"(SELECT seq, title, journal, publication_year, is_oa, CASE WHEN seq % 2 = 0 THEN doi END AS doi, CASE WHEN seq % 5 <> 0 THEN 'p' || pub_no END AS pmid, CASE WHEN seq % 7 <> 0 THEN 'PMC' || pub_no END AS pmcid FROM {IDENTIFIED} i WHERE provider = 'europe_pmc')"
_CHECK_DIFFER = ", ".join(f"CASE WHEN coalesce(CAST(c.{f} AS VARCHAR), '') <> '' AND coalesce(CAST(o.{f} AS VARCHAR), '') <> '' AND {_CMP.format('c.' + f)} <> {_CMP.format('o.' + f)} THEN '{f}' END" for f in _CHECKED)
_CHECK_MATCHED = ", ".join(f"CASE WHEN c.{k} = o.{k} THEN '{k}' END" for k in L.MATCHED_ON)


@query(
    "cross_check",
    f"""WITH c AS (SELECT * FROM {_CHECK_CANON} c0), o AS (SELECT * FROM {_CHECK_OTHER} o0),
    hits AS ({' UNION ALL '.join(f"SELECT c.document_id, {p} AS p, min(o.seq) AS r FROM c JOIN o ON o.{k} = c.{k} GROUP BY c.document_id" for p, k in enumerate(L.PAIRED_BY))}),
    best AS (SELECT document_id, arg_min(r, p) AS r FROM hits GROUP BY document_id)
    SELECT c.document_id, best.r AS record_id, best.r IS NOT NULL AS known_to_provider, array_to_string(list_filter([{_CHECK_MATCHED}], lambda x: x IS NOT NULL), ',') AS matched_on,
    array_to_string(list_filter([{_CHECK_DIFFER}], lambda x: x IS NOT NULL), ',') AS differences, o.is_oa AS is_open_access, o.seq % 2 = 0 AS in_epmc, o.seq % 3 = 0 AS has_pdf, o.pmcid IS NOT NULL AND o.is_oa IS TRUE AND best.r IS NOT NULL AS has_fulltext_xml, o.seq % 4 AS candidate_count
    FROM c LEFT JOIN best USING (document_id) LEFT JOIN o ON o.seq = best.r""",
)
def cross_check(spark, sf_dir):
    """Publications against the other provider's records, several of which may be of one publication, by DOI, PMCID or PMID."""
    obs = observations(spark, sf_dir)
    given = lambda **ids: F.map_filter(F.create_map(*[x for k, v in ids.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    tag = lambda p, n: F.concat(F.lit(p), F.col(n).cast("string"))
    pubs = obs.groupBy("document_id").agg(F.min("pub_no").alias("pub"))
    canon = L.first_values(obs).join(pubs, "document_id")
    canon = canon.withColumn("identifiers", given(doi=F.col("doi"), pmid=F.when(F.col("pub") % 3 == 0, tag("p", "pub")), pmcid=F.when(F.col("pub") % 4 == 0, tag("PMC", "pub"))))
    seq, pmcid = F.col("seq"), F.when(F.col("seq") % 7 != 0, tag("PMC", "pub_no"))
    other = obs.where("provider = 'europe_pmc'").select(
        seq.alias("record_id"), *_CHECKED, given(doi=F.when(seq % 2 == 0, F.col("doi")), pmid=F.when(seq % 5 != 0, tag("p", "pub_no")), pmcid=pmcid).alias("identifiers"),
        F.col("is_oa").alias("is_open_access"), (seq % 2 == 0).alias("in_epmc"), (seq % 3 == 0).alias("has_pdf"), (pmcid.isNotNull() & F.coalesce("is_oa", F.lit(False))).alias("has_fulltext_xml"), (seq % 4).alias("candidate_count"),
    )
    out = L.cross_check(canon, other, S.norm_cmp, _CHECKED)
    return out.select(
        "document_id", "record_id", "known_to_provider", F.array_join("matched_on", ",").alias("matched_on"), F.array_join(F.transform("differences", lambda d: d["field"]), ",").alias("differences"),
        "availability.is_open_access", "availability.in_epmc", "availability.has_pdf", F.coalesce("availability.has_fulltext_xml", F.lit(False)).alias("has_fulltext_xml"), "availability.candidate_count",
    )


_CANON = "(SELECT document_id, CASE WHEN document_id % 3 = 0 THEN 'd' || document_id END AS doi, CASE WHEN document_id % 4 = 0 THEN 'PMC' || document_id END AS pmcid, CASE WHEN document_id % 5 = 0 THEN 'PMC' || document_id END AS url_pmcid, 'p' || document_id AS pmid FROM {DOC} d)"
_OTHER = "(SELECT document_id AS record_id, CASE WHEN document_id % 2 = 0 THEN 'd' || document_id END AS doi, 'PMC' || (document_id + document_id % 2) AS pmcid, CASE WHEN document_id % 7 = 0 THEN 'p' || document_id END AS pmid FROM {DOC} d2)"


@query(
    "resolve_chain",
    f"""WITH c AS (SELECT * FROM {_CANON} c0), o AS (SELECT * FROM {_OTHER} o0), hits AS (
    SELECT c.document_id, 0 AS p, 'doi' AS m, min(o.record_id) AS r FROM c JOIN o ON o.doi = c.doi GROUP BY ALL
    UNION ALL SELECT c.document_id, 1, 'pmcid', min(o.record_id) FROM c JOIN o ON o.pmcid = c.pmcid GROUP BY ALL
    UNION ALL SELECT c.document_id, 2, 'url_pmcid', min(o.record_id) FROM c JOIN o ON o.pmcid = c.url_pmcid AND c.pmcid IS NULL GROUP BY ALL
    UNION ALL SELECT c.document_id, 3, 'pmid', min(o.record_id) FROM c JOIN o ON o.pmid = c.pmid GROUP BY ALL)
    SELECT c.document_id, arg_min(h.m, h.p) AS matched_by, arg_min(h.r, h.p) AS record_id FROM c LEFT JOIN hits h ON h.document_id = c.document_id GROUP BY c.document_id""",
)
def resolve_chain(spark, sf_dir):
    d, i = view(spark, sf_dir, "DOC"), F.col("document_id")
    tag = lambda p, n=i: F.concat(F.lit(p), n.cast("string"))
    canon = d.select("document_id", F.when(i % 3 == 0, tag("d")).alias("doi"), F.when(i % 4 == 0, tag("PMC")).alias("pmcid"), F.when(i % 5 == 0, tag("PMC")).alias("url_pmcid"), tag("p").alias("pmid"))
    other = d.select(i.alias("record_id"), F.when(i % 2 == 0, tag("d")).alias("doi"), tag("PMC", i + i % 2).alias("pmcid"), F.when(i % 7 == 0, tag("p")).alias("pmid"))
    return L.resolve_chain(canon, other)
