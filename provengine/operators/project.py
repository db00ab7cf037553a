"""Provider payloads (untrusted JSON) to the common schema, by typed reads of VARIANT paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clean_text, coerce_int, document_id_for_doi, document_id_for_source, normalize_doi, short_id, strip, yes_no

CONTENT_URL = "^https://content\\.openalex\\.org/works/(W[0-9]+)\\.(pdf|grobid-xml)$"


def parse(df: DataFrame, raw: str = "raw") -> DataFrame:
    return df.withColumn("v", F.try_parse_json(raw))


def text_at(v: Column, path: str) -> Column:
    """The string at a path; NULL if what is there isn't one."""
    node = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(node) == "STRING", F.try_variant_get(v, path, "string"))


def bool_at(v: Column, path: str) -> Column:
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def int_at(v: Column, path: str) -> Column:
    node = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(node.isin("STRING", "BIGINT"), coerce_int(F.try_variant_get(v, path, "string"))).cast("int")


def list_at(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def distinct_texts(values: Column) -> Column:
    """Ordered unique, empty ones dropped."""
    return F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != "")))


def let(value: Column, body) -> Column:
    """`body` of a value that is made once: inside a lambda, an outer expression is made anew for each item."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def unique_by(items: Column, key) -> Column:
    """The first item of each key, in order; items without a key are dropped."""
    keyed = F.filter(F.transform(items, lambda x: F.struct(key(x).alias("k"), x.alias("x"))), lambda p: p["k"].isNotNull())
    return let(F.struct(keyed.alias("p"), F.transform(keyed, lambda p: p["k"]).alias("k")), lambda s: F.transform(F.filter(s["p"], lambda p, i: F.array_position(s["k"], p["k"]) == i + 1), lambda p: p["x"]))


def inverted_index(words: Column) -> Column:
    """The map of token to places of a list of words, by one sort inside the row."""
    placed = F.sort_array(F.transform(words, lambda w, k: F.struct(w.alias("token"), k.cast("long").alias("at"))))
    with_starts = lambda p: F.struct(p.alias("p"), F.filter(F.transform(p, lambda x, k: F.when((k == 0) | (F.get(p, k - 1)["token"] != x["token"]), k)), lambda k: k.isNotNull()).alias("starts"))
    run = lambda s, start, k: F.slice(s["p"], start + 1, F.coalesce(F.get(s["starts"], k + 1), F.size(s["p"])) - start)
    entry = lambda s, start, k: F.struct(F.get(s["p"], start)["token"].alias("token"), F.transform(run(s, start, k), lambda x: x["at"]).alias("places"))
    return F.map_from_entries(let(let(placed, with_starts), lambda s: F.transform(s["starts"], lambda start, k: entry(s, start, k))))


def rebuild_abstract(index: Column) -> Column:
    """Text of an inverted index (a map of token to places): negative places dropped, the lesser token on a clash."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("token")))))
    sorted_ = F.sort_array(F.filter(places, lambda p: p["at"].isNotNull() & (p["at"] >= 0)))
    first = let(sorted_, lambda all_: F.filter(all_, lambda p, i: (i == 0) | (F.get(all_, i - 1)["at"] != p["at"])))
    return clean_text(F.array_join(F.transform(first, lambda p: p["token"]), " "))


def authors(names: Column, fallback: Column | None = None) -> Column:
    """Ordered unique cleaned names; without any, those of a comma-separated string."""
    own = distinct_texts(F.transform(names, clean_text))
    if fallback is None:
        return own
    listed = distinct_texts(F.transform(F.split(F.regexp_replace(clean_text(fallback), "\\.+$", ""), ","), lambda x: F.trim(x)))
    return F.when(F.size(own) > 0, own).otherwise(F.coalesce(listed, F.array().cast("array<string>")))


def topics(primary: Column, others: Column) -> Column:
    """The primary topic first, then the others; unique by id."""
    mark = lambda ts, flag: F.transform(ts, lambda t: F.struct(t["id"].alias("id"), t["display_name"].alias("display_name"), F.lit(flag).alias("is_primary"), t["subfield"].alias("subfield"), t["field"].alias("field"), t["domain"].alias("domain")))
    first = F.array_compact(F.array(primary))
    return unique_by(F.concat(mark(first, True), mark(others, False)), lambda t: t["id"])


def domain_tags(found: Column) -> Column:
    """All domains, then fields, subfields and topic names; ordered unique."""
    level = lambda name: F.transform(found, lambda t: t[name])
    return distinct_texts(F.concat(*[level(c) for c in ("domain", "field", "subfield", "display_name")]))


def identifiers(**values: Column) -> Column:
    names = F.array(*[F.lit(k) for k in values])
    return F.map_filter(F.map_from_arrays(names, F.array(*values.values())), lambda _, v: v.isNotNull() & (v != ""))


CANDIDATE = "struct<url:string,kind:string,source:string,host_type:string,version:string,license:string,landing_page_url:string>"


def candidate(url: Column, kind: str, source: str, host=None, version=None, licence=None, landing=None) -> Column:
    none = F.lit(None).cast("string")
    part = lambda c: none if c is None else c
    return F.struct(
        url.alias("url"), F.lit(kind).alias("kind"), F.lit(source).alias("source"), part(host).alias("host_type"), part(version).alias("version"), part(licence).alias("license"), part(landing).alias("landing_page_url")
    ).cast(CANDIDATE)


def oa_locations(ordered: Column, oa_url: Column) -> Column:
    """Candidates from locations that aren't closed, unique by url, then the general open url."""
    free = F.filter(ordered, lambda loc: ~loc["is_oa"].eqNullSafe(F.lit(False)) & blank_to_null(loc["pdf_url"]).isNotNull())
    found = F.transform(free, lambda loc: candidate(strip(loc["pdf_url"]), "pdf", "openalex", loc["host_type"], loc["version"], loc["license"], loc["landing_page_url"]))
    more = F.array_compact(F.array(F.when(blank_to_null(oa_url).isNotNull(), candidate(strip(oa_url), "pdf", "openalex"))))
    return unique_by(F.concat(found, more), lambda c: c["url"])


def open_urls(entries: Column) -> Column:
    """Direct PDF links that are flagged open (or not flagged), unique by url."""
    keep = F.filter(
        entries,
        lambda e: clean_text(e["url"]).isNotNull() & F.upper(F.trim(F.coalesce(e["availability_code"], F.lit("")))).isin("", "OA", "F") & (F.lower(F.trim(F.coalesce(e["style"], F.lit("")))) == "pdf"),
    )
    return unique_by(F.transform(keep, lambda e: candidate(clean_text(e["url"]), "pdf", "europe_pmc", clean_text(e["site"]))), lambda c: c["url"])


def content_url_ok(url: Column, work_id: Column, suffix: str) -> Column:
    """Only the provider's own https address of this very work."""
    return F.coalesce((F.regexp_extract(url, CONTENT_URL, 1) == work_id) & (F.regexp_extract(url, CONTENT_URL, 2) == suffix) & (work_id != ""), F.lit(False))


def _level(t: Column, level: str) -> Column:
    return clean_text(text_at(t, f"$.{level}.display_name")).alias(level)


def _topic(t: Column) -> Column:
    return F.struct(short_id(strip(text_at(t, "$.id"))).alias("id"), clean_text(text_at(t, "$.display_name")).alias("display_name"), _level(t, "subfield"), _level(t, "field"), _level(t, "domain"))


def _location(loc: Column) -> Column:
    return F.struct(
        bool_at(loc, "$.is_oa").alias("is_oa"), text_at(loc, "$.pdf_url").alias("pdf_url"), F.coalesce(blank_to_null(text_at(loc, "$.source.type")), blank_to_null(text_at(loc, "$.host_type"))).alias("host_type"),
        blank_to_null(text_at(loc, "$.version")).alias("version"), blank_to_null(text_at(loc, "$.license")).alias("license"), blank_to_null(text_at(loc, "$.landing_page_url")).alias("landing_page_url"),
    )


def _objects(*nodes: Column) -> Column:
    return F.filter(F.array(*nodes), lambda n: n.isNotNull() & F.schema_of_variant(n).startswith("OBJECT"))


def normalize_openalex(df: DataFrame) -> DataFrame:
    """Works of the first provider (`raw` JSON text); rows without an id are left out."""
    v = F.col("v")
    get = lambda path: F.try_variant_get(v, path, "variant")
    out = parse(df).withColumn("source_id", short_id(blank_to_null(text_at(v, "$.id")))).where(F.coalesce("source_id", F.lit("")) != "")
    places = F.concat(_objects(get("$.best_oa_location"), get("$.primary_location")), F.filter(list_at(v, "$.locations"), lambda n: F.schema_of_variant(n).startswith("OBJECT")))
    index = F.try_variant_get(v, "$.abstract_inverted_index", "map<string,array<bigint>>")
    primary = F.when(F.schema_of_variant(get("$.primary_topic")).startswith("OBJECT"), _topic(get("$.primary_topic")))
    out = out.withColumns(
        {
            "doi": normalize_doi(text_at(v, "$.doi")), "title": clean_text(F.coalesce(F.nullif(text_at(v, "$.title"), F.lit("")), text_at(v, "$.display_name"))),
            "authors": authors(F.transform(list_at(v, "$.authorships"), lambda a: text_at(a, "$.author.display_name"))), "publication_year": int_at(v, "$.publication_year"),
            "journal": clean_text(text_at(v, "$.primary_location.source.display_name")), "abstract": rebuild_abstract(index), "is_oa": bool_at(v, "$.open_access.is_oa"), "oa_status": text_at(v, "$.open_access.oa_status"),
            "topics": topics(primary, F.transform(list_at(v, "$.topics"), _topic)), "candidates": oa_locations(F.transform(places, _location), text_at(v, "$.open_access.oa_url")), "language": text_at(v, "$.language"),
        }
    )
    ids = {k: short_id(blank_to_null(text_at(v, f"$.ids.{k}"))) for k in ("pmid", "pmcid", "mag")}
    doi = F.col("doi")
    return out.withColumns(
        {
            "provider": F.lit("openalex"), "domain_tags": domain_tags(F.col("topics")), "identifiers": identifiers(openalex=F.col("source_id"), doi=doi, **ids),
            "document_id": F.when(doi.isNotNull(), document_id_for_doi(doi)).otherwise(document_id_for_source(F.lit("openalex"), F.col("source_id"))),
        }
    ).drop("v")


def normalize_epmc(df: DataFrame) -> DataFrame:
    """Results of the second provider."""
    v = F.col("v")
    pmcid, pmid = clean_text(text_at(v, "$.pmcid")), clean_text(text_at(v, "$.pmid"))
    article, origin = strip(F.try_variant_get(v, "$.id", "string")), strip(F.try_variant_get(v, "$.source", "string"))
    entries = F.transform(
        list_at(v, "$.fullTextUrlList.fullTextUrl"),
        lambda e: F.struct(text_at(e, "$.url").alias("url"), F.try_variant_get(e, "$.availabilityCode", "string").alias("availability_code"), F.try_variant_get(e, "$.documentStyle", "string").alias("style"), text_at(e, "$.site").alias("site")),
    )
    flag = lambda path: F.coalesce(bool_at(v, path), yes_no(F.upper(strip(text_at(v, path)))))
    names = F.transform(list_at(v, "$.authorList.author"), lambda a: F.coalesce(clean_text(text_at(a, "$.fullName")), clean_text(text_at(a, "$.lastName"))))
    key = F.when((F.coalesce(article, F.lit("")) != "") & (F.coalesce(origin, F.lit("")) != ""), F.concat(origin, F.lit("/"), article))
    out = parse(df).withColumns({"pmcid": pmcid, "is_oa": flag("$.isOpenAccess")})
    xml = F.when(F.col("is_oa") & F.col("pmcid").isNotNull(), candidate(F.concat(F.lit("/"), F.upper("pmcid"), F.lit("/fullTextXML")), "xml", "europe_pmc", F.lit("repository")))
    return out.select(
        *[c for c in out.columns if c not in ("v", "pmcid", "is_oa")], F.lit("europe_pmc").alias("provider"), F.coalesce(key, "pmcid", pmid, F.nullif(article, F.lit("")), F.lit("unknown")).alias("source_id"),
        normalize_doi(text_at(v, "$.doi")).alias("doi"), clean_text(text_at(v, "$.title")).alias("title"), authors(names, text_at(v, "$.authorString")).alias("authors"), int_at(v, "$.pubYear").alias("publication_year"),
        F.coalesce(clean_text(text_at(v, "$.journalInfo.journal.title")), clean_text(text_at(v, "$.journalTitle"))).alias("journal"), clean_text(text_at(v, "$.abstractText")).alias("abstract"), "is_oa",
        identifiers(doi=normalize_doi(text_at(v, "$.doi")), pmid=pmid, pmcid=F.upper("pmcid"), europe_pmc=key).alias("identifiers"), F.concat(open_urls(entries), F.array_compact(F.array(xml))).alias("candidates"),
    )


def normalize_unpaywall(df: DataFrame, asked: str = "asked_doi") -> DataFrame:
    """Records of the third provider; the DOI that was asked for stands in for a missing one."""
    v = F.col("v")
    loc = lambda n: F.struct(
        *[clean_text(text_at(n, f"$.{c}")).alias(c) for c in ("url", "url_for_pdf", "url_for_landing_page", "host_type", "version", "license")]
    )
    rank = lambda c, order: F.coalesce(F.array_position(F.array(*[F.lit(o) for o in order]), F.lower(c)), F.lit(0))
    place = lambda c, order: F.when(rank(c, order) > 0, rank(c, order)).otherwise(len(order) + 1)
    rest = F.transform(list_at(v, "$.oa_locations"), loc)
    keyed = F.array_sort(F.transform(rest, lambda x: F.struct(place(x["host_type"], ("publisher", "repository")).alias("h"), place(x["version"], ("publishedversion", "acceptedversion", "submittedversion")).alias("r"), F.coalesce(x["url_for_pdf"], x["url"], F.lit("")).alias("u"), x.alias("x"))))
    ordered = F.concat(F.transform(_objects(F.try_variant_get(v, "$.best_oa_location", "variant")), loc), F.transform(keyed, lambda k: k["x"]))
    usable = F.filter(ordered, lambda x: x["url_for_pdf"].isNotNull())
    found = unique_by(F.transform(usable, lambda x: candidate(x["url_for_pdf"], "pdf", "unpaywall", x["host_type"], x["version"], x["license"], F.coalesce(x["url_for_landing_page"], x["url"]))), lambda c: c["url"])
    names = F.transform(list_at(v, "$.z_authors"), lambda a: F.concat_ws(" ", clean_text(text_at(a, "$.given")), clean_text(text_at(a, "$.family"))))
    doi = F.coalesce(normalize_doi(text_at(v, "$.doi")), F.col(asked))
    out = parse(df)
    return out.select(
        *[c for c in out.columns if c != "v"], F.lit("unpaywall").alias("provider"), doi.alias("source_id"), doi.alias("doi"), clean_text(text_at(v, "$.title")).alias("title"), authors(names).alias("authors"), int_at(v, "$.year").alias("publication_year"),
        clean_text(text_at(v, "$.journal_name")).alias("journal"), F.lit(None).cast("string").alias("abstract"), bool_at(v, "$.is_oa").alias("is_oa"), clean_text(text_at(v, "$.oa_status")).alias("oa_status"), identifiers(doi=doi).alias("identifiers"), found.alias("candidates"),
        distinct_texts(F.transform(ordered, lambda x: F.coalesce(x["url_for_landing_page"], x["url"]))).alias("landing_page_urls"),
    )
