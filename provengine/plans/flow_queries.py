"""Queries over sources, sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import ledger as L
from ..sources import pages as P
from ..sources import sinks as K
from ..streaming import cursors as C
from ..streaming import golden as G
from ..streaming import machine
from ..streaming import stream as M
from .fixtures import table, view
from .ledger_queries import FULL, observations
from .project_queries import works_json
from .registry import query
from .stats_queries import ARTIFACTS, FAILS, artifacts, docs, failures


def pages(spark, sf_dir):
    """Pages of 25 works; every seventh is malformed, and works divisible by 10 have no id."""
    works = works_json(spark, sf_dir).withColumn("raw", F.when(F.col("seq") % 10 == 0, F.lit('{"id":null}')).otherwise(F.col("raw")))
    rows = works.groupBy(F.floor(F.col("seq") / 25).alias("page")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "raw"))), lambda x: x["raw"]), ",").alias("body"))
    return rows.select("page", F.when(F.col("page") % 7 == 3, F.lit('{"results":{}}')).when(F.col("page") % 7 == 5, F.lit("[1")).otherwise(F.concat(F.lit('{"results":['), "body", F.lit("]}"))).alias("raw"))


_RECORDS = "SELECT seq // 25 AS page, row_number() OVER (PARTITION BY seq // 25 ORDER BY seq) - 1 AS place, 'https://openalex.org/' || source_id AS id, seq FROM {OBS} o"


@query("src_payload_json", f"SELECT page, place, id FROM ({_RECORDS}) WHERE seq % 10 <> 0 AND page % 7 NOT IN (3, 5) UNION ALL SELECT DISTINCT page, -1, CASE WHEN page % 7 = 3 THEN 'results is no list' ELSE 'page is no object' END FROM ({_RECORDS}) WHERE page % 7 IN (3, 5)")
def src_payload_json(spark, sf_dir):
    records, rejects = P.split_pages(pages(spark, sf_dir))
    return records.select("page", "place", F.get_json_object("record", "$.id").alias("id")).unionByName(rejects.select("page", F.lit(-1).alias("place"), F.col("reason").alias("id")))


@query("src_ledger_scan", "SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'fr'")
def src_ledger_scan(spark, sf_dir):
    return P.read_ledger(spark, sf_dir, "documents", ["doc_id", "lang", "n_chars"]).where("lang = 'fr'")


@query(
    "snk_sidecars",
    f"SELECT d.document_id, d.journal, d.status, a.prim AS \"primary\", coalesce(a.n, 0) AS n_files, coalesce(a.sources, '') AS cross_checked_via, coalesce(u.n, 0) AS n_urls FROM {{DOC}} d LEFT JOIN (SELECT document_id, CASE WHEN bool_or(kind = 'pdf') THEN 'pdf' ELSE 'xml' END AS prim, count(*) AS n, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM {ARTIFACTS} a0 GROUP BY document_id) a ON a.document_id = d.document_id LEFT JOIN (SELECT document_id, count(DISTINCT url) AS n FROM {{CAND}} c GROUP BY document_id) u ON u.document_id = d.document_id",
)
def snk_sidecars(spark, sf_dir):
    out = K.build_sidecars(docs(spark, sf_dir), artifacts(spark, sf_dir), view(spark, sf_dir, "CAND"))
    n = lambda c: F.when(c.isNull(), 0).otherwise(F.size(c)).cast("long")
    return out.select(
        "document_id", "bibliographic.journal", "harvest.status", "artifacts.primary", n(F.map_keys("artifacts.files")).alias("n_files"), F.array_join("provenance.cross_checked_via", ",").alias("cross_checked_via"), n(F.col("provenance.candidate_urls")).alias("n_urls")
    )


def _digest_sql(name: str, columns: list[str], source: str) -> str:
    row = "sha256(concat_ws(chr(31), " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in sorted(columns)) + "))"
    return f"SELECT '{name}' AS name, CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(d, ',' ORDER BY b)) AS digest FROM (SELECT ('0x' || left(r, 8))::BIGINT % 256 AS b, sha256(string_agg(r, ',' ORDER BY r)) AS d, count(*) AS n FROM (SELECT {row} AS r FROM {source}) GROUP BY b)"


_TABLES = {
    "artifacts": ("ART", ["document_id", "kind", "seq", "content_key", "size_bytes", "source", "http_status"], "document_id"),
    "candidates": ("CAND", ["document_id", "offered_index", "kind", "source", "url", "host_type", "version", "succeeds"], "document_id"),
    "documents": ("DOC", ["document_id", "run_id", "status", "journal", "publication_year", "oa_status", "attempts", "claimed"], "document_id"),
    "events": ("EVT", ["id", "document_id", "run_id", "operation", "attempt_no", "ok", "category", "http_status", "remaining", "body", "source"], "id"),
    "observations": ("OBS", ["seq", "run_id", "provider", "source_id", "raw_doi", "title", "journal", "publication_year", "language"], "seq"),
    "topics": ("PART", ["work_no", "topic_id", "topic_name", "subfield", "field", "domain"], "work_no"),
}


@query("snk_evidence_export", " UNION ALL ".join(_digest_sql(n, c, "{%s} %s" % (v, n[:3])) for n, (v, c, _) in _TABLES.items()))
def snk_evidence_export(spark, sf_dir):
    """The bundle is written; the manifest is that of what is read back from it."""
    ledger = {n: view(spark, sf_dir, v).select(*c) for n, (v, c, _) in _TABLES.items()}
    return K.export_ledger(ledger, {n: key for n, (_, _, key) in _TABLES.items()}, f"{M.scratch(spark)}/bundle")


def evidence(spark, sf_dir):
    """(tables, shape) of a ledger: documents, their labels, and observations with the raw record, every fifth without."""
    documents = table(spark, sf_dir, "documents")
    raw = F.when(F.col("doc_id") % 5 != 0, F.to_json(F.struct("doc_id", "lang")))
    observed = documents.select(F.col("doc_id").alias("seq"), "doc_id", raw.alias("raw_json"), F.sha2(raw, 256).alias("raw_sha256"), F.to_json(F.array("lang", "source")).alias("tags_json"))
    tables = {"documents": documents, "labels": table(spark, sf_dir, "labels"), "observations": observed}
    shape = K.LedgerShape(
        {n: ", ".join(f"{c} {kind}" for c, kind in t.dtypes) for n, t in tables.items()},
        {"documents": "doc_id", "labels": "doc_id", "observations": "seq"},
        {"observations": {"raw_json": "OBJECT", "tags_json": "ARRAY"}},
        {"observations": ("raw_json", "raw_sha256")},
        [("labels", "doc_id", "documents", "doc_id"), ("observations", "doc_id", "documents", "doc_id")],
    )
    return tables, shape


@query(
    "src_evidence_import",
    "SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, CASE WHEN d.doc_id % 5 <> 0 THEN sha256('{\"doc_id\":' || d.doc_id || ',\"lang\":\"' || d.lang || '\"}') END AS raw_sha256 FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
)
def src_evidence_import(spark, sf_dir):
    at = M.scratch(spark)
    tables, shape = evidence(spark, sf_dir)
    K.export_ledger(tables, shape.keys, f"{at}/bundle")
    out = K.restore_ledger(spark, f"{at}/bundle", shape, f"{at}/restored")
    return out["documents"].join(out["labels"].select("doc_id", "quality"), "doc_id", "left").join(out["observations"].select("doc_id", "raw_sha256"), "doc_id")


@query(
    "snk_run_report",
    f"SELECT e.run_id, count(*) AS attempts, any_value(coalesce(f.n, 0)) AS failure_total, any_value(coalesce(f.ids, '')) AS failures FROM {{EVT}} e LEFT JOIN (SELECT run_id, max(n) AS n, string_agg(id || ':' || category, ',' ORDER BY id) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY id) AS rn, count(*) OVER (PARTITION BY run_id) AS n FROM {FAILS} x) WHERE rn <= 200 GROUP BY run_id) f ON f.run_id = e.run_id GROUP BY e.run_id",
)
def snk_run_report(spark, sf_dir):
    counters = view(spark, sf_dir, "EVT").groupBy("run_id").agg(F.count("*").alias("attempts"))
    out = K.run_reports(counters, failures(spark, sf_dir))
    text = F.array_join(F.transform("failures", lambda x: F.concat_ws(":", x["id"].cast("string"), x["category"])), ",")
    return out.select("run_id", "attempts", "failure_total", F.coalesce(text, F.lit("")).alias("failures"))


def cursor_pages(spark, sf_dir):
    """Pages of five works, ten pages a run, some landed twice. By run (modulo 5) a chain of cursors ends at its last page with one
    page broken at first (0), goes round (1), meets an empty page (2), has a limit (3), or names itself as the next (4)."""
    works = works_json(spark, sf_dir).withColumn("raw", F.when(F.col("seq") % 10 == 0, F.lit('{"id":null}')).otherwise(F.col("raw")))
    rows = works.groupBy(F.floor(F.col("seq") / 5).alias("p")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "raw"))), lambda x: x["raw"]), ",").alias("body"))
    rows = rows.withColumns({"run": F.floor(F.col("p") / 10), "k": F.col("p") % 10})
    kind, k = F.col("run") % 5, F.col("k")
    following = F.when(k == 9, None).when((kind == 1) & (k == 6), "c2").when((kind == 4) & (k == 3), "c3").otherwise(F.concat(F.lit("c"), (k + 1).cast("string")))
    body = F.when((kind == 2) & (k == 4), "").otherwise(F.col("body"))
    meta = F.to_json(F.struct(following.alias("next_cursor")))
    raw = F.concat(F.lit('{"results":['), body, F.lit('],"meta":'), meta, F.lit("}"))
    landed = rows.withColumn("raw", F.explode(F.when((kind == 0) & (k == 7), F.array(F.lit("[1"), raw)).when(k == 2, F.array(raw, raw)).otherwise(F.array(raw))))
    cursor = F.when(k == 0, "*").otherwise(F.concat(F.lit("c"), k.cast("string")))
    return landed.select(F.concat(F.lit("run-"), F.col("run").cast("string")).alias("run_id"), cursor.alias("cursor"), F.when(kind == 3, 17).alias("most"), "raw")


@query(
    "stream_discover",
    """WITH RECURSIVE r AS (SELECT seq // 5 AS p, row_number() OVER (PARTITION BY seq // 5 ORDER BY seq) - 1 AS place, 'https://openalex.org/' || source_id AS id, seq % 10 <> 0 AS usable FROM {OBS} o),
    pg AS (SELECT p // 10 AS run, p % 10 AS k, p, count(*) * (p // 10 % 5 <> 2 OR p % 10 <> 4)::INT AS raw_count, count(*) FILTER (usable) * (p // 10 % 5 <> 2 OR p % 10 <> 4)::INT AS n, CASE WHEN p // 10 % 5 = 3 THEN 17 END AS most FROM r GROUP BY p),
    lk AS (SELECT *, CASE WHEN k = 0 THEN '*' ELSE 'c' || k END AS cur, CASE WHEN k = 9 THEN NULL WHEN run % 5 = 1 AND k = 6 THEN 'c2' WHEN run % 5 = 4 AND k = 3 THEN 'c3' ELSE 'c' || (k + 1) END AS nxt FROM pg),
    w AS (SELECT run, p, 1 AS page, nxt, least(n, coalesce(most, n)) AS taken, least(n, coalesce(most, n)) AS seen, [cur] AS been,
            CASE WHEN n >= most THEN 'limit reached' WHEN nxt IS NULL THEN 'no next cursor' WHEN raw_count = 0 THEN 'empty page' WHEN nxt = cur THEN 'cursor repeated' END AS stopped FROM lk WHERE cur = '*'
          UNION ALL
          SELECT lk.run, lk.p, w.page + 1, lk.nxt, least(lk.n, coalesce(lk.most - w.seen, lk.n)), w.seen + least(lk.n, coalesce(lk.most - w.seen, lk.n)), list_append(w.been, lk.cur),
            CASE WHEN w.seen + lk.n >= lk.most THEN 'limit reached' WHEN lk.nxt IS NULL THEN 'no next cursor' WHEN lk.raw_count = 0 THEN 'empty page' WHEN list_contains(list_append(w.been, lk.cur), lk.nxt) THEN 'cursor repeated' END
          FROM w JOIN lk ON lk.run = w.run AND lk.cur = w.nxt WHERE w.stopped IS NULL)
    SELECT 'run-' || run AS run_id, page, place, id FROM (SELECT w.run, w.page, w.taken, r.place, r.id, row_number() OVER (PARTITION BY w.run, w.page ORDER BY r.place) AS nth FROM w JOIN r ON r.p = w.p WHERE r.usable) WHERE nth <= taken
    UNION ALL SELECT 'run-' || run, max(page), -1, arg_max(coalesce(stopped, 'waits for ' || nxt) || ' after ' || seen, page) FROM w GROUP BY run""",
)
def stream_discover(spark, sf_dir):
    """The records in the order of each run's cursors, and where each run stands (place -1)."""
    root = M.scratch(spark)
    records, at = C.stream_discover(M.land(cursor_pages(spark, sf_dir), root, 8), root, P.usable_records)
    stands = F.concat(F.coalesce("stopped", F.concat(F.lit("waits for "), "next_cursor")), F.lit(" after "), F.col("seen").cast("string"))
    return records.select("run_id", "page", "place", F.get_json_object("record", "$.id").alias("id")).unionByName(at.select("run_id", "page", F.lit(-1).alias("place"), stands.alias("id")))


_SEEN = "concat_ws('/', document_id, http_status, remaining)"


@query(
    "stream_dedup",
    f"""SELECT 'ever' AS mode, {_SEEN} AS key, 1 AS n FROM {{EVT}} e GROUP BY key
    UNION ALL SELECT 'window', {_SEEN} AS key, 1 + (max(id % 10) >= min(id % 10) + 6)::INT FROM {{EVT}} f WHERE id % 17 <> 0 OR id % 10 < 6 GROUP BY key""",
)
def stream_dedup(spark, sf_dir):
    """Ten batches, an hour each. Without a watermark each key comes once. With a delay of two hours the watermark of a batch lies
    three hours before it, and a key is forgotten when the watermark passes its time by two: after five batches it comes again.
    From batch 6 on every 17th event is five hours late, which is before the watermark, and is dropped."""
    batch = F.col("id") % 10
    hour = batch - F.when((F.col("id") % 17 == 0) & (batch >= 6), 5).otherwise(0)
    seen = view(spark, sf_dir, "EVT").select(F.expr(_SEEN).alias("key"), batch.alias("batch"), F.timestamp_seconds(F.lit(1_700_000_000) + hour * 3600).alias("at"))
    out = None
    for mode, rule in (("ever", ()), ("window", ("at", "2 hours"))):
        root = M.scratch(spark)
        once = M.run_to_table(M.stream_dedup(M.land_in_order(seen, root, "batch", None, 10), "key", *rule), root)
        one = once.groupBy("key").agg(F.count("*").cast("int").alias("n")).select(F.lit(mode).alias("mode"), "key", "n")
        out = one if out is None else out.unionByName(one)
    return out


_MOVES = ", ".join(f"('{a}', '{b}')" for a, targets in A.ALLOWED.items() for b in targets)
_STATES = f"""WITH RECURSIVE allowed(a, b) AS (VALUES {_MOVES}),
m AS (SELECT document_id, id, target_status AS target, row_number() OVER (PARTITION BY document_id ORDER BY id) AS k FROM {{EVT}} e),
s AS (SELECT document_id, id, k, 'DISCOVERED' AS before, target, target = 'DISCOVERED' OR EXISTS (SELECT 1 FROM allowed WHERE a = 'DISCOVERED' AND b = target) AS accepted FROM m WHERE k = 1
      UNION ALL
      SELECT m.document_id, m.id, m.k, CASE WHEN s.accepted THEN s.target ELSE s.before END, m.target,
             m.target = CASE WHEN s.accepted THEN s.target ELSE s.before END OR EXISTS (SELECT 1 FROM allowed WHERE a = CASE WHEN s.accepted THEN s.target ELSE s.before END AND b = m.target)
      FROM s JOIN m ON m.document_id = s.document_id AND m.k = s.k + 1),
t AS (SELECT document_id, id, before, CASE WHEN accepted THEN target ELSE before END AS after, accepted FROM s)
"""


@query("stream_state_machine", _STATES + "SELECT * FROM t")
def stream_state_machine(spark, sf_dir):
    root = M.scratch(spark)
    moves = view(spark, sf_dir, "EVT").select("document_id", "id", F.col("target_status").alias("target"))
    return M.run_to_table(machine.stream_transitions(M.land_in_order(moves, root, "id", "document_id")), root).drop("batch_id")


@query("batch_state_machine", _STATES + "SELECT document_id, arg_max(after, id) AS status, count(*) FILTER (NOT accepted) AS refused FROM t GROUP BY document_id")
def batch_state_machine(spark, sf_dir):
    return A.state_after(view(spark, sf_dir, "EVT").select("document_id", "id", F.col("target_status").alias("target")))


@query("stream_progress", "SELECT run_id, count(*) AS events, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS failed, max(ts) AS last_activity_at FROM {EVT} e GROUP BY run_id")
def stream_progress(spark, sf_dir):
    root = M.scratch(spark)
    out = M.run_to_table(M.stream_progress(M.land(view(spark, sf_dir, "EVT").select("run_id", "ok", "ts"), root)), root, "update")
    return out.groupBy("run_id").agg(F.max_by(F.struct("events", "ok", "failed", "last_activity_at"), "batch_id").alias("r")).select("run_id", "r.*")


@query("stream_budget", "SELECT source, id, CAST(sum(attempt_no) OVER (PARTITION BY source ORDER BY id) AS BIGINT) AS spent, coalesce(sum(attempt_no) OVER (PARTITION BY source ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 400, false) AS refused FROM {EVT} e")
def stream_budget(spark, sf_dir):
    root = M.scratch(spark)
    spent = view(spark, sf_dir, "EVT").select("source", "id", F.col("attempt_no").alias("credits"))
    return M.stream_budget(M.land_in_order(spent, root, "id", "id"), root, 400).drop("batch_id")


_RICH = f"""(SELECT *, list_filter([language, country_1, country_2], lambda x: x IS NOT NULL) AS domain_tags,
    [{{'url': 'https://h' || seq % 3 || '.example/' || source_id, 'kind': CASE seq % 2 WHEN 0 THEN 'pdf' ELSE 'xml' END, 'by': provider}}, {{'url': 'https://h0.example/' || source_id, 'kind': 'pdf', 'by': 'seq ' || seq}}] AS candidates,
    [{{'id': 'T' || seq % 3, 'name': 'seq ' || seq}}] AS topics, CASE WHEN provider <> 'openalex' THEN [{{'source': provider, 'note': journal || seq}}] ELSE [] END AS cross_checks FROM {FULL} f0)"""


def rich_observations(spark, sf_dir):
    """Observations with all 15 merged fields."""
    seq = F.col("seq").cast("string")
    at = lambda n: F.concat(F.lit("https://h"), n, F.lit(".example/"), F.col("source_id"))
    one = lambda url, kind, by: F.struct(url.alias("url"), kind.alias("kind"), by.alias("by"))
    check = F.struct(F.col("provider").alias("source"), F.concat("journal", seq).alias("note"))
    return observations(spark, sf_dir).select(
        "document_id", "seq", *L.FIRST_WINS, "authors", "discovered_via", "identifiers", F.array_compact(F.array("language", "country_1", "country_2")).alias("domain_tags"),
        F.array(one(at((F.col("seq") % 3).cast("string")), F.when(F.col("seq") % 2 == 0, "pdf").otherwise("xml"), F.col("provider")), one(at(F.lit("0")), F.lit("pdf"), F.concat(F.lit("seq "), seq))).alias("candidates"),
        F.array(F.struct(F.concat(F.lit("T"), (F.col("seq") % 3).cast("string")).alias("id"), F.concat(F.lit("seq "), seq).alias("name"))).alias("topics"),
        F.when(F.col("provider") != "openalex", F.array(check)).alias("cross_checks"),
    )


def _merged_sql() -> str:
    parts = [f"SELECT document_id, '{f}' AS field, CAST(arg_min({f}, seq) FILTER (coalesce(CAST({f} AS VARCHAR), '') <> '') AS VARCHAR) AS value FROM rich GROUP BY document_id" for f in L.FIRST_WINS]
    each = "SELECT document_id, seq, unnest({0}) AS v, generate_subscripts({0}, 1) AS i FROM rich"
    first = "SELECT document_id, '{0}' AS field, string_agg({1}, '|' ORDER BY pos) AS value FROM (SELECT document_id, arg_min(v, seq * 100 + i) AS v, min(seq * 100 + i) AS pos FROM ({2}) GROUP BY document_id, {3}) GROUP BY document_id"
    parts += [first.format(f, "v", each.format(f), "v") for f in L.UNIONS]
    parts.append(first.format("candidates", "v.url || ' ' || v.kind || ' ' || v.\"by\"", each.format("candidates"), "v.url, v.kind"))
    parts.append(first.format("topics", "v.id || ' ' || v.name", each.format("topics"), "v.id"))
    parts.append("SELECT document_id, 'identifiers', string_agg(k || '=' || v, '|' ORDER BY k) FROM (SELECT document_id, k, arg_min(v, seq) AS v FROM (SELECT document_id, seq, 'doi' AS k, doi AS v FROM rich UNION ALL SELECT document_id, seq, provider, source_id FROM rich) WHERE v IS NOT NULL GROUP BY document_id, k) GROUP BY document_id")
    parts.append(f"SELECT document_id, 'cross_checks', string_agg(v.source || ' ' || v.note, '|' ORDER BY v.source) FROM (SELECT document_id, arg_max(v, seq) AS v FROM ({each.format('cross_checks')}) GROUP BY document_id, v.source) GROUP BY document_id")
    return f"WITH rich AS (SELECT * FROM {_RICH} r0) SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE value IS NOT NULL"


@query("stream_merge", _merged_sql())
def stream_merge(spark, sf_dir):
    """All 15 fields after four batches and more, each fact as text."""
    root = M.scratch(spark)
    out = G.stream_merge(M.land(rich_observations(spark, sf_dir), root, 12), root, 4)
    texts = {f: F.col(f).cast("string") for f in L.FIRST_WINS} | {f: F.array_join(f, "|") for f in L.UNIONS}
    joined = lambda column, of: F.array_join(F.transform(column, of), "|")
    texts["identifiers"] = joined(F.array_sort(F.map_entries("identifiers")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    texts["candidates"] = joined("candidates", lambda c: F.concat_ws(" ", c["url"], c["kind"], c["by"]))
    texts["topics"] = joined("topics", lambda t: F.concat_ws(" ", t["id"], t["name"]))
    texts["cross_checks"] = joined(F.array_sort("cross_checks"), lambda c: F.concat_ws(" ", c["source"], c["note"]))
    return out.select("document_id", *[t.alias(f) for f, t in texts.items()]).unpivot(["document_id"], list(texts), "field", "value").where("value <> ''")


_SUFFIXES = ("json", "pdf", "XML", "part", "txt", "json")
_SUFFIX = "CASE g % 6 WHEN 0 THEN 'json' WHEN 1 THEN 'pdf' WHEN 2 THEN 'xml' WHEN 3 THEN 'part' WHEN 4 THEN 'txt' ELSE 'json' END"


@query("src_corpus_files", f"SELECT 'd' || g AS document_id, {_SUFFIX} AS kind, n AS size_bytes, g % 6 = 3 AS partial FROM (SELECT doc_id // 20 AS g, sum(strlen(text)) AS n FROM documents GROUP BY g) WHERE g % 6 <> 4")
def src_corpus_files(spark, sf_dir):
    """A file for every 20 documents, of each suffix in turn, written and named by tasks."""
    at = M.scratch(spark)
    rows = table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 20).alias("g")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), "").alias("content"))
    suffix = F.get(F.array(*[F.lit(s) for s in _SUFFIXES]), (F.col("g") % 6).cast("int"))
    K.write_files(rows.select(F.concat(F.lit("d"), F.col("g").cast("string"), F.lit("."), suffix).alias("name"), F.col("content").cast("binary").alias("content")), f"{at}/corpus")
    return P.scan_corpus(spark, f"{at}/corpus").select("document_id", "kind", "size_bytes", "partial")


@query(
    "src_ledger_lookup",
    "SELECT d.document_id, d.status, count(a.document_id) AS artifacts, max(a.size_bytes) AS largest FROM {DOC} d LEFT JOIN {ART} a ON a.document_id = d.document_id WHERE d.status <> 'SKIPPED' GROUP BY ALL",
)
def src_ledger_lookup(spark, sf_dir):
    """Two ledger tables in buckets, joined where they lie."""
    at, tag = M.scratch(spark), uuid.uuid4().hex
    documents = P.write_ledger(docs(spark, sf_dir), at, f"documents_{tag}", buckets=8)
    files = P.write_ledger(view(spark, sf_dir, "ART").select("document_id", "kind", "size_bytes"), at, f"artifacts_{tag}", buckets=8)
    by_document = files.groupBy("document_id").agg(F.count("*").alias("artifacts"), F.max("size_bytes").alias("largest"))
    return documents.where("status <> 'SKIPPED'").join(by_document.hint("merge"), "document_id", "left").select("document_id", "status", F.coalesce("artifacts", F.lit(0)).alias("artifacts"), "largest")


@query("run_documents", "SELECT run_id, document_id, row_number() OVER (PARTITION BY run_id ORDER BY document_id) AS place FROM {DOC} d")
def run_documents(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("document_id"))
    return docs(spark, sf_dir).select("run_id", "document_id", place.cast("long").alias("place"))
