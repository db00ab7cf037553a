"""Queries over provider projections and discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import vocabulary as V
from ..operators import discover as D
from ..operators import project as P
from .fixtures import table, view
from .registry import query
from .scalar_queries import _DOI, IDENTIFIED, identified


def works_json(spark, sf_dir):
    """First-provider payloads made of the observations."""
    o, doc = view(spark, sf_dir, "OBS"), F.col
    person = lambda c: F.struct(F.struct(doc(c).alias("display_name")).alias("author"))
    work = F.struct(
        F.concat(F.lit("https://openalex.org/"), "source_id").alias("id"), doc("raw_doi").alias("doi"), doc("title"), doc("publication_year"), doc("language"), F.array(person("author_1"), person("author_2"), person("author_1")).alias("authorships"),
        F.struct(F.lit(True).alias("is_oa"), F.concat(F.lit("https://h.example.org/"), doc("pub_no").cast("string"), F.lit(".pdf")).alias("pdf_url"), F.struct(doc("journal").alias("display_name"), F.lit("journal").alias("type")).alias("source")).alias("primary_location"),
        F.struct(doc("is_oa"), doc("oa_status"), F.concat(F.lit("https://h.example.org/"), (doc("pub_no") % 3).cast("string"), F.lit(".pdf")).alias("oa_url")).alias("open_access"),
    )
    return o.select("seq", F.to_json(work, {"ignoreNullFields": "false"}).alias("raw"))


_PMC_RAW = "concat('PMC', pub_no)"


@query(
    "normalize_work",
    f"""SELECT seq, source_id, document_id, doi, nullif(trim(regexp_replace(title, '[\\s\\p{{Z}}]+', ' ', 'g')), '') AS title, publication_year, nullif(journal, '') AS journal, is_oa, oa_status, language,
    CASE WHEN author_2 IS NULL OR author_2 = author_1 THEN author_1 ELSE author_1 || '|' || author_2 END AS authors, CASE WHEN pub_no = pub_no % 3 THEN 1 ELSE 2 END AS n_candidates FROM (SELECT *, {_DOI} AS doi, CASE WHEN raw_doi IS NULL THEN 'openalex_' || lower(source_id) || '_' || left(sha256('openalex:' || source_id), 12) ELSE 'doi_' || regexp_replace(regexp_replace({_DOI}, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') || '_' || left(sha256({_DOI}), 12) END AS document_id FROM {{OBS}} o)""",
)
def normalize_work(spark, sf_dir):
    out = P.normalize_openalex(works_json(spark, sf_dir))
    return out.select("seq", "source_id", "document_id", "doi", "title", "publication_year", "journal", "is_oa", "oa_status", "language", F.array_join("authors", "|").alias("authors"), F.size("candidates").alias("n_candidates"))


@query(
    "normalize_epmc",
    f"SELECT seq, 'MED/' || seq AS source_id, {_DOI} AS doi, nullif(trim(regexp_replace(title, '[\\s\\p{{Z}}]+', ' ', 'g')), '') AS title, publication_year, nullif(journal, '') AS journal, is_oa, CASE WHEN is_oa AND seq % 2 = 0 THEN 2 ELSE 1 END AS n_candidates, CASE WHEN author_2 IS NULL OR author_2 = author_1 THEN author_1 ELSE author_1 || '|' || author_2 END AS authors FROM {{OBS}} o",
)
def normalize_epmc(spark, sf_dir):
    o, c = view(spark, sf_dir, "OBS"), F.col
    url = lambda code, style: F.struct(F.concat(F.lit("https://e.example.org/"), c("seq").cast("string")).alias("url"), F.lit(code).alias("availabilityCode"), F.lit(style).alias("documentStyle"), F.lit("Site").alias("site"))
    result = F.struct(
        c("seq").cast("string").alias("id"), F.lit("MED").alias("source"), F.when(c("seq") % 2 == 0, F.concat(F.lit("pmc"), c("pub_no").cast("string"))).alias("pmcid"), c("raw_doi").alias("doi"), "title", c("publication_year").cast("string").alias("pubYear"),
        F.struct(F.struct(c("journal").alias("title")).alias("journal")).alias("journalInfo"), F.when(c("is_oa"), "Y").when(~c("is_oa"), "N").alias("isOpenAccess"), F.concat(F.concat_ws(", ", "author_1", "author_2"), F.lit(".")).alias("authorString"),
        F.struct(F.array(url("S", "pdf"), url("OA", "html"), url("OA", "pdf"), url("F", "pdf")).alias("fullTextUrl")).alias("fullTextUrlList"),
    )
    out = P.normalize_epmc(o.select("seq", F.to_json(result).alias("raw")))
    return out.select("seq", "source_id", "doi", "title", "publication_year", "journal", "is_oa", F.size("candidates").alias("n_candidates"), F.array_join("authors", "|").alias("authors"))


@query(
    "normalize_unpaywall",
    f"SELECT seq, coalesce({_DOI}, '10.9999/asked') AS doi, nullif(trim(regexp_replace(title, '[\\s\\p{{Z}}]+', ' ', 'g')), '') AS title, publication_year, is_oa, oa_status, 'https://r.example.org/b.pdf|https://p.example.org/c.pdf|https://r.example.org/a.pdf' AS candidates FROM {{OBS}} o",
)
def normalize_unpaywall(spark, sf_dir):
    o, c = view(spark, sf_dir, "OBS"), F.col
    loc = lambda host, name, version: F.struct(F.lit(f"https://{host[0]}.example.org/{name}.pdf").alias("url_for_pdf"), F.lit(f"https://{host[0]}.example.org/{name}").alias("url"), F.lit(host).alias("host_type"), F.lit(version).alias("version"))
    best = loc("repository", "b", "acceptedVersion")
    record = F.struct(
        c("raw_doi").alias("doi"), "title", c("publication_year").alias("year"), "is_oa", "oa_status", best.alias("best_oa_location"),
        F.array(loc("repository", "a", "submittedVersion"), best, loc("publisher", "c", "publishedVersion")).alias("oa_locations"), F.array(F.struct(F.lit("Ann").alias("given"), c("author_1").alias("family"))).alias("z_authors"),
    )
    out = P.normalize_unpaywall(o.select("seq", F.lit("10.9999/asked").alias("asked_doi"), F.to_json(record).alias("raw")))
    return out.select("seq", "doi", "title", "publication_year", "is_oa", "oa_status", F.array_join("candidates.url", "|").alias("candidates"))


@query("rebuild_abstract", "SELECT doc_id, nullif(trim(regexp_replace(text, '[\\s\\p{Z}\\x1c-\\x1f\\x{85}]+', ' ', 'g')), '') AS abstract FROM documents")
def rebuild_abstract(spark, sf_dir):
    words = F.split(S.clean_text(F.coalesce("text", F.lit(""))), " ")
    return table(spark, sf_dir, "documents").select("doc_id", P.rebuild_abstract(P.inverted_index(words)).alias("abstract"))


@query("authors_list", "SELECT seq, CASE WHEN author_2 IS NULL OR author_2 = author_1 THEN author_1 ELSE author_1 || '|' || author_2 END AS authors FROM {OBS} o")
def authors_list(spark, sf_dir):
    o = view(spark, sf_dir, "OBS")
    return o.select("seq", F.array_join(P.authors(F.array("author_1", "author_2", "author_1")), "|").alias("authors"))


_WORK = "(SELECT work_no // 5 AS work, work_no, topic_id, topic_name, subfield, field, domain FROM {PART} p)"


def _works_with_topics(spark, sf_dir):
    part = view(spark, sf_dir, "PART")
    topic = F.struct("work_no", F.struct(F.col("topic_id").alias("id"), F.col("topic_name").alias("display_name"), "subfield", "field", "domain").alias("t"))
    works = part.groupBy(F.floor(F.col("work_no") / 5).alias("work")).agg(F.sort_array(F.collect_list(topic)).alias("all"))
    all_ = F.transform("all", lambda x: x["t"])
    return works.select("work", P.topics(F.get(all_, F.lit(0)), all_).alias("topics"))


@query("topics_list", f"SELECT work, string_agg(topic_id || CASE WHEN pos = first THEN '*' ELSE '' END, ',' ORDER BY pos) AS topics FROM (SELECT work, topic_id, min(work_no) AS pos, min(min(work_no)) OVER (PARTITION BY work) AS first FROM {_WORK} w GROUP BY work, topic_id) GROUP BY work")
def topics_list(spark, sf_dir):
    return _works_with_topics(spark, sf_dir).select("work", F.array_join(F.transform("topics", lambda t: F.concat(t["id"], F.when(t["is_primary"], "*").otherwise(""))), ",").alias("topics"))


_FIRST_TOPIC = f"(SELECT work, topic_id, min(work_no) AS pos, arg_min(topic_name, work_no) AS topic_name, arg_min(subfield, work_no) AS subfield, arg_min(field, work_no) AS field, arg_min(domain, work_no) AS domain FROM {_WORK} w GROUP BY work, topic_id)"


@query(
    "domain_tags",
    f"SELECT work, string_agg(tag, ',' ORDER BY pos) AS tags FROM (SELECT work, tag, min(pos) AS pos FROM (SELECT work, domain AS tag, pos FROM {_FIRST_TOPIC} a UNION ALL SELECT work, field, 1e9 + pos FROM {_FIRST_TOPIC} b UNION ALL SELECT work, subfield, 2e9 + pos FROM {_FIRST_TOPIC} c UNION ALL SELECT work, topic_name, 3e9 + pos FROM {_FIRST_TOPIC} d) GROUP BY work, tag) GROUP BY work",
)
def domain_tags(spark, sf_dir):
    return _works_with_topics(spark, sf_dir).select("work", F.array_join(P.domain_tags(F.col("topics")), ",").alias("tags"))


@query("identifiers_map", f"SELECT seq, coalesce('doi=' || {_DOI} || ',', '') || 'openalex=' || source_id || CASE WHEN seq % 3 = 0 THEN ',pmid=' || seq ELSE '' END AS identifiers FROM {{OBS}} o")
def identifiers_map(spark, sf_dir):
    o = view(spark, sf_dir, "OBS")
    ids = P.identifiers(openalex=F.col("source_id"), doi=S.normalize_doi("raw_doi"), pmid=S.short_id(F.when(F.col("seq") % 3 == 0, F.concat(F.lit("https://x.org/"), F.col("seq").cast("string"), F.lit("/")))), mag=F.lit(""))
    return o.select("seq", F.array_join(F.transform(F.array_sort(F.map_entries(ids)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("identifiers"))


_OPEN = "(SELECT document_id, url, min(offered_index) AS pos FROM {CAND} c WHERE %s GROUP BY document_id, url)"


@query("oa_locations", "SELECT document_id, string_agg(url, ',' ORDER BY pos, url) AS urls FROM " + _OPEN % "NOT (host_type IS NOT NULL AND host_type = 'repository' AND version IS NULL)" + " o GROUP BY document_id")
def oa_locations(spark, sf_dir):
    c = view(spark, sf_dir, "CAND")
    closed = F.coalesce((F.col("host_type") == "repository") & F.col("version").isNull(), F.lit(False))
    loc = F.struct("offered_index", F.col("url").alias("pdf_url"), F.when(closed, F.lit(False)).alias("is_oa"), "host_type", "version", F.lit(None).cast("string").alias("license"), F.lit(None).cast("string").alias("landing_page_url"))
    works = c.groupBy("document_id").agg(F.sort_array(F.collect_list(loc)).alias("locations"))
    found = works.select("document_id", P.oa_locations(F.col("locations"), F.lit(None).cast("string")).alias("c")).where(F.size("c") > 0)
    return found.select("document_id", F.array_join("c.url", ",").alias("urls"))


@query("open_url_list", "SELECT document_id, string_agg(url, ',' ORDER BY pos, url) AS urls FROM " + _OPEN % "kind = 'pdf' AND (version IS NULL OR version <> 'acceptedVersion')" + " o GROUP BY document_id")
def open_url_list(spark, sf_dir):
    c = view(spark, sf_dir, "CAND")
    code = F.when(F.col("version") == "acceptedVersion", "S").when(F.col("version") == "publishedVersion", "OA").when(F.col("version").isNotNull(), "f ")
    entry = F.struct("offered_index", "url", code.alias("availability_code"), F.upper("kind").alias("style"), F.lit("site").alias("site"))
    lists = c.groupBy("document_id").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    found = lists.select("document_id", P.open_urls(F.col("entries")).alias("c")).where(F.size("c") > 0)
    return found.select("document_id", F.array_join("c.url", ",").alias("urls"))


@query("content_urls", "SELECT page_id, test_url = 'https://content.openalex.org/works/W' || page_id || '.pdf' AS ok, page_id % 10 = 2 AS other FROM {PAGE} p")
def content_urls(spark, sf_dir):
    p = view(spark, sf_dir, "PAGE")
    own = F.concat(F.lit("W"), F.col("page_id").cast("string"))
    return p.select("page_id", P.content_url_ok(F.col("test_url"), own, "pdf").alias("ok"), P.content_url_ok(F.when(F.col("page_id") % 10 == 2, F.col("test_url")).otherwise(F.concat(F.lit("https://content.openalex.org/works/W9"), own, F.lit(".pdf"))), own, "pdf").alias("other"))


@query(
    "vocab_validate",
    """SELECT seq, list_sort(list_distinct(list_filter([upper(country_1), upper(country_2), bad, fine], lambda x: x IS NOT NULL))) AS codes, bad IS NOT NULL AS refused, count(DISTINCT bad) OVER () AS unknown
    FROM (SELECT seq, country_1, country_2, CASE seq % 50 WHEN 7 THEN 'ZZ' WHEN 9 THEN 'GER' WHEN 11 THEN '49' WHEN 13 THEN 'EH' END AS bad, CASE seq % 50 WHEN 15 THEN 'XK' END AS fine FROM {OBS} o)""",
)
def vocab_validate(spark, sf_dir):
    bad = F.when(F.col("seq") % 50 == 7, "zz").when(F.col("seq") % 50 == 9, "Ger").when(F.col("seq") % 50 == 11, "49").when(F.col("seq") % 50 == 13, "eh")
    fine = F.when(F.col("seq") % 50 == 15, "xk")
    o = view(spark, sf_dir, "OBS").select("seq", F.concat_ws("|", F.lower("country_1"), F.lit(" "), "country_2", bad, fine, "country_1").alias("codes"))
    rows, unknown = D.normalize_codes(o, "codes", V.countries(spark), upper=True)
    return D.refused(rows, "seq", "codes", unknown).crossJoin(F.broadcast(unknown.agg(F.count("*").alias("unknown"))))


@query("vocab_name", "SELECT seq, language, CASE language WHEN 'de' THEN 'German' WHEN 'en' THEN 'English' WHEN 'es' THEN 'Spanish' WHEN 'fr' THEN 'French' ELSE language END AS name FROM {OBS} o")
def vocab_name(spark, sf_dir):
    return D.with_names(view(spark, sf_dir, "OBS").select("seq", "language"), "language", V.languages(spark))


def _works(spark, sf_dir):
    return identified(spark, sf_dir).withColumns({"countries": F.array_compact(F.array("country_1", "country_2")), "authors": F.array_compact(F.array("author_1", "author_2"))})


_Q = D.Query(is_oa=True, has_doi=True, languages=("en", "fr"), countries=("DE", "US"), from_year=2005, to_year=2020)
_Q_SQL = "is_oa AND doi IS NOT NULL AND language IN ('en','fr') AND (country_1 IN ('DE','US') OR country_2 IN ('DE','US')) AND publication_year BETWEEN 2005 AND 2020"


@query("discovery_filter", f"SELECT seq, document_id, language, publication_year FROM {IDENTIFIED} i WHERE {_Q_SQL}")
def discovery_filter(spark, sf_dir):
    return D.discover(_works(spark, sf_dir), _Q).select("seq", "document_id", "language", "publication_year")


_FS = """(SELECT document_id, nullif(array_to_string(list_sort(list_filter([
  CASE WHEN attempts = 1 THEN 'topics.id:T' || document_id % 7 WHEN attempts = 2 THEN 'primary_topic.id:T' || document_id % 7 END, CASE WHEN document_id % 2 = 0 THEN 'is_oa:true' END, CASE WHEN claimed THEN 'has_doi:true' END,
  'open_access.oa_status:' || oa_status, CASE WHEN attempts = 3 THEN 'language:de|en' END, CASE WHEN attempts = 4 THEN 'publication_year:' || publication_year ELSE 'from_publication_date:' || publication_year || '-01-01' END], lambda x: x IS NOT NULL)), ','), '') AS filter FROM {DOC} d)"""


def _filters(spark, sf_dir):
    d, n = view(spark, sf_dir, "DOC"), F.col("attempts")
    none = F.array().cast("array<string>")
    return d.withColumns(
        {
            "topic_id": F.when(n.isin(1, 2), F.concat(F.lit("T"), (F.col("document_id") % 7).cast("string"))), "primary_topic_only": n == 2, "is_oa": F.col("document_id") % 2 == 0, "has_doi": F.col("claimed"),
            "languages": F.when(n == 3, F.array(F.lit("de"), F.lit("en"))).otherwise(none), "countries": none, "year": F.when(n == 4, F.col("publication_year")), "from_year": F.col("publication_year"), "to_year": F.lit(None).cast("int"),
        }
    ).select("document_id", D.filter_string().alias("filter"))


@query("filter_string", f"SELECT * FROM {_FS} f")
def filter_string(spark, sf_dir):
    return _filters(spark, sf_dir)


@query("query_fingerprint", f"""SELECT document_id, sha256('{{"filter":"' || filter || '","search":null}}') AS fingerprint FROM {_FS} f""")
def query_fingerprint(spark, sf_dir):
    rows = _filters(spark, sf_dir).withColumn("search", F.lit(None).cast("string"))
    return rows.select("document_id", S.canonical_sha(rows, ["search", "filter"]).alias("fingerprint"))


@query("preview", f"SELECT seq, document_id, author_1 AS first_author, (SELECT count(*) FROM {IDENTIFIED} j WHERE {_Q_SQL}) AS total FROM {IDENTIFIED} i WHERE {_Q_SQL} ORDER BY seq LIMIT 10")
def preview(spark, sf_dir):
    return D.preview(_works(spark, sf_dir), _Q).select("seq", "document_id", "first_author", "total")


_FOUND = "(SELECT document_id, updated_at, journal FROM {DOC} d WHERE lower(coalesce(journal, '')) LIKE '%al 1%' AND lower(coalesce(oa_status, '')) = 'gold' AND EXISTS (SELECT 1 FROM {ART} a WHERE a.document_id = d.document_id AND a.kind = 'pdf'))"


@query("corpus_search", f"SELECT *, (SELECT count(*) FROM {_FOUND} g) AS total FROM {_FOUND} f ORDER BY updated_at DESC, document_id LIMIT 50 OFFSET 5")
def corpus_search(spark, sf_dir):
    found = D.query_documents(view(spark, sf_dir, "DOC"), view(spark, sf_dir, "ART"), search="al 1", oa_status="Gold", has_pdf=True).select("document_id", "updated_at", "journal")
    return D.page_of(found, 5, 50)
