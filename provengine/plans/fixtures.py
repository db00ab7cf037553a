"""The fixture views: one text each that both Spark SQL and DuckDB read.

They derive the shapes this engine works on from the given tables, so that every query's work grows with them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OBS = """
SELECT d.doc_id AS seq,
       CAST(floor(d.doc_id / 4) AS BIGINT) AS pub_no,
       concat('run-', CAST(d.doc_id % 5 AS STRING)) AS run_id,
       CASE d.doc_id % 3 WHEN 0 THEN 'openalex' WHEN 1 THEN 'europe_pmc' ELSE 'unpaywall' END AS provider,
       concat('W', CAST(CAST(floor(d.doc_id / 4) AS BIGINT) AS STRING)) AS source_id,
       CASE WHEN CAST(floor(d.doc_id / 4) AS BIGINT) % 11 = 0 THEN NULL
            WHEN d.doc_id % 5 = 0 THEN concat('https://doi.org/10.1234/Doc.', CAST(CAST(floor(d.doc_id / 4) AS BIGINT) AS STRING))
            WHEN d.doc_id % 5 = 1 THEN concat('doi:10.1234/doc.', CAST(CAST(floor(d.doc_id / 4) AS BIGINT) AS STRING), '.')
            WHEN d.doc_id % 5 = 2 THEN concat('(10.1234/DOC.', CAST(CAST(floor(d.doc_id / 4) AS BIGINT) AS STRING), ')')
            WHEN d.doc_id % 5 = 3 THEN concat('  10.1234/doc.', CAST(CAST(floor(d.doc_id / 4) AS BIGINT) AS STRING), ' ')
            ELSE concat('info:doi/10.1234/doc.', CAST(CAST(floor(d.doc_id / 4) AS BIGINT) AS STRING)) END AS raw_doi,
       CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE substr(d.text, 1, 40) END AS title,
       CASE WHEN d.doc_id % 6 = 0 THEN '' ELSE d.source END AS journal,
       CAST(CASE WHEN d.doc_id % 5 = 1 THEN NULL ELSE 2000 + d.n_chars % 25 END AS INT) AS publication_year,
       CASE WHEN d.n_chars < 300 THEN NULL ELSE substr(d.text, 1, 200) END AS abstract,
       CASE WHEN l.quality IS NULL THEN NULL ELSE l.quality = 1 END AS is_oa,
       CASE l.toxic WHEN 1 THEN 'closed' WHEN 0 THEN 'gold' ELSE NULL END AS oa_status,
       d.lang AS language,
       CASE d.doc_id % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'DE' WHEN 2 THEN 'AT' ELSE NULL END AS country_1,
       CASE WHEN d.doc_id % 9 = 0 THEN 'FR' ELSE NULL END AS country_2,
       concat('Author ', CAST(d.doc_id % 13 AS STRING)) AS author_1,
       CASE WHEN d.doc_id % 2 = 0 THEN concat('Author ', CAST(d.doc_id % 3 AS STRING)) ELSE NULL END AS author_2
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
"""

DOC = """
SELECT o.o_orderkey AS document_id,
       concat('run-', CAST(year(o.o_orderdate) * 100 + month(o.o_orderdate) AS STRING)) AS run_id,
       CASE WHEN o.o_orderstatus = 'F' THEN
              CASE substr(o.o_orderpriority, 1, 1) WHEN '3' THEN 'FAILED_PERMANENT' WHEN '4' THEN 'FAILED_RETRYABLE'
                   WHEN '5' THEN 'SKIPPED' ELSE 'COMPLETED' END
            WHEN o.o_orderstatus = 'O' THEN
              CASE substr(o.o_orderpriority, 1, 1) WHEN '1' THEN 'DISCOVERED' WHEN '2' THEN 'NORMALIZED' WHEN '3' THEN 'QUEUED'
                   WHEN '4' THEN 'ACQUIRING' ELSE 'VALIDATING' END
            ELSE 'COMPLETED' END AS status,
       concat('Journal ', CAST(o.o_custkey % 40 AS STRING)) AS journal,
       CAST(year(o.o_orderdate) AS INT) AS publication_year,
       CASE o.o_custkey % 4 WHEN 0 THEN 'gold' WHEN 1 THEN 'green' WHEN 2 THEN 'hybrid' ELSE NULL END AS oa_status,
       CAST(o.o_custkey % 5 AS INT) AS attempts,
       o.o_orderdate AS updated_at,
       o.o_custkey % 17 = 0 AS claimed
FROM orders o
"""

ART = """
SELECT l.l_orderkey AS document_id,
       CASE l.l_returnflag WHEN 'A' THEN 'pdf' ELSE 'xml' END AS kind,
       l.l_linenumber AS seq,
       concat('content-', CAST(l.l_partkey AS STRING)) AS content_key,
       CAST(1000 + l.l_partkey * 7 AS BIGINT) AS size_bytes,
       l.l_shipdate AS retrieved_at,
       CASE l.l_suppkey % 3 WHEN 0 THEN 'openalex' WHEN 1 THEN 'europe_pmc' ELSE 'unpaywall' END AS source,
       CAST(CASE WHEN l.l_suppkey % 10 = 0 THEN 404 ELSE 200 END AS INT) AS http_status
FROM lineitem l
WHERE l.l_returnflag <> 'N'
"""

CAND = """
SELECT l.l_orderkey AS document_id,
       l.l_linenumber AS offered_index,
       CASE l.l_returnflag WHEN 'R' THEN 'xml' ELSE 'pdf' END AS kind,
       CASE l.l_suppkey % 3 WHEN 0 THEN 'openalex' WHEN 1 THEN 'europe_pmc' ELSE 'unpaywall' END AS source,
       CASE WHEN l.l_suppkey % 10 = 0 THEN concat('https://pmc.ncbi.nlm.nih.gov/articles/PMC', CAST(l.l_partkey AS STRING), '/pdf/')
            ELSE concat('https://host', CAST(l.l_suppkey % 7 AS STRING), '.example.org/', CAST(l.l_partkey % 50 AS STRING), '.pdf') END AS url,
       CASE l.l_suppkey % 4 WHEN 0 THEN 'publisher' WHEN 1 THEN 'repository' ELSE NULL END AS host_type,
       CASE l.l_partkey % 4 WHEN 0 THEN 'publishedVersion' WHEN 1 THEN 'acceptedVersion' WHEN 2 THEN 'submittedVersion' ELSE NULL END AS version,
       l.l_suppkey % 10 <> 0 AND l.l_partkey % 3 = 0 AS succeeds
FROM lineitem l
"""

EVT = """
SELECT event_id AS id, ts, user_id AS document_id,
       concat('run-', CAST(day(ts) % 6 AS STRING)) AS run_id,
       event_type AS operation,
       CAST(k % 4 + 1 AS INT) AS attempt_no,
       event_type <> 'error' AS ok,
       CASE WHEN event_type <> 'error' THEN NULL
            ELSE CASE k % 5 WHEN 0 THEN 'TIMEOUT' WHEN 1 THEN 'NOT_FOUND' WHEN 2 THEN 'INVALID_PDF'
                 WHEN 3 THEN 'RATE_LIMITED' ELSE 'NO_OA_LOCATION' END END AS category,
       CAST(CASE WHEN event_type <> 'error' THEN 200
            ELSE CASE k % 6 WHEN 0 THEN 404 WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 403 WHEN 4 THEN 409 ELSE 451 END END AS INT) AS http_status,
       CAST(CASE WHEN k % 7 = 0 THEN 0 WHEN k % 7 < 4 THEN k ELSE NULL END AS INT) AS remaining,
       CASE WHEN k % 8 = 0 THEN 'daily credit limit reached' WHEN k % 8 = 1 THEN 'quota exceeded' ELSE 'busy' END AS body,
       event_type = 'error' AND k % 5 IN (0, 3) AS retryable,
       CASE k % 3 WHEN 0 THEN 'openalex' WHEN 1 THEN 'europe_pmc' ELSE 'unpaywall' END AS source,
       CASE event_type WHEN 'signup' THEN 'NORMALIZED' WHEN 'view' THEN 'QUEUED' WHEN 'click' THEN 'ACQUIRING'
            WHEN 'purchase' THEN 'COMPLETED' ELSE 'FAILED_RETRYABLE' END AS target_status
FROM ev
"""

PAGE = """
SELECT page_id, url, html,
       CASE page_id % 5 WHEN 0 THEN concat(url, CASE WHEN instr(url, '?') > 0 THEN '&' ELSE '?' END, 'api_key=s3cret&q=a')
            WHEN 1 THEN replace(url, '://', '://user:pw@')
            WHEN 2 THEN concat('https://content.openalex.org/works/W', CAST(page_id AS STRING), '.pdf')
            WHEN 3 THEN 'http://127.0.0.1/x' ELSE url END AS test_url,
       CASE page_id % 4 WHEN 0 THEN concat('%PDF-1.7 ', substr(html, 1, 600), ' %%EOF')
            WHEN 1 THEN concat('%PDF-1.7 ', substr(html, 1, 600))
            WHEN 2 THEN html ELSE concat('<?xml version="1.0"?><article>', CAST(page_id AS STRING), '</article>') END AS payload
FROM pages
"""

PART = """
SELECT p_partkey AS work_no, concat('T', CAST(p_size AS STRING)) AS topic_id, p_name AS topic_name,
       p_type AS subfield, p_brand AS field, CASE p_size % 4 WHEN 0 THEN 'Physical' WHEN 1 THEN 'Life' WHEN 2 THEN 'Health' ELSE 'Social' END AS domain
FROM part
"""

VIEWS = {"OBS": OBS, "DOC": DOC, "ART": ART, "CAND": CAND, "EVT": EVT, "PAGE": PAGE, "PART": PART}
TABLES = ("documents", "labels", "orders", "lineitem", "events", "pages", "part")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view over the tables of `sf_dir`, without names in the session's catalog."""
    text, inputs = VIEWS[name], {}
    if name == "EVT":
        inputs["ev"] = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    for t in TABLES:
        if re.search(rf"(FROM|JOIN) {t}\b", text):
            inputs[t] = table(spark, sf_dir, t)
    for name_ in inputs:
        text = re.sub(rf"(FROM|JOIN) {name_}\b", rf"\1 {{{name_}}}", text)
    return spark.sql(text, **inputs)


def oracle(text: str) -> str:
    """DuckDB SQL with each {NAME} of a view put in as a subquery."""
    for name, view_text in VIEWS.items():
        if name == "EVT":
            view_text = view_text.replace("FROM ev", "FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) ev")
        text = text.replace("{" + name + "}", f"({view_text})")
    return text.strip()
