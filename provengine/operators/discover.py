"""Structured discovery queries, previews and corpus search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalize_codes(df: DataFrame, codes: str, vocabulary: DataFrame, upper: bool) -> tuple[DataFrame, DataFrame]:
    """(rows with `codes` as a sorted unique array, unknown codes): split on , and |, trimmed, case folded."""
    fold = F.upper if upper else F.lower
    parts = F.transform(F.split(F.coalesce(F.col(codes), F.lit("")), "[,|]"), lambda x: fold(F.trim(x)))
    out = df.withColumn(codes, F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != ""))))
    unknown = out.select(F.explode(codes).alias("code")).distinct().join(vocabulary.select("code"), "code", "left_anti")
    return out, unknown


def refused(df: DataFrame, key: str, codes: str, unknown: DataFrame) -> DataFrame:
    """All of `df` with `refused`: a row of normalised codes that names an unknown one is refused whole, never narrowed to the rest."""
    bad = df.select(key, F.explode(codes).alias("code")).join(unknown, "code").select(F.col(key).alias("_bad")).distinct()
    return df.join(bad, F.col(key) == F.col("_bad"), "left").withColumn("refused", F.col("_bad").isNotNull()).drop("_bad")


def with_names(df: DataFrame, code: str, vocabulary: DataFrame) -> DataFrame:
    """Display names of codes; an unknown code stands for itself."""
    names = vocabulary.select(F.col("code").alias(code), "name")
    return df.join(names, code, "left").withColumn("name", F.coalesce("name", code))


@dataclass(frozen=True)
class Query:
    """OR inside a constraint, AND between them; an empty one constrains nothing."""

    topic_id: str | None = None
    primary_topic_only: bool = False
    is_oa: bool = False
    has_doi: bool = False
    oa_status: str | None = None
    languages: tuple[str, ...] = ()
    countries: tuple[str, ...] = ()
    publication_year: int | None = None
    from_year: int | None = None
    to_year: int | None = None


def discover(works: DataFrame, q: Query) -> DataFrame:
    tests: list[Column] = []
    if q.topic_id:
        tests.append(F.exists("topics", lambda t: (t["id"] == q.topic_id) & (t["is_primary"] if q.primary_topic_only else F.lit(True))))
    if q.is_oa:
        tests.append(F.col("is_oa"))
    if q.has_doi:
        tests.append(F.col("doi").isNotNull())
    if q.oa_status:
        tests.append(F.col("oa_status") == q.oa_status)
    if q.languages:
        tests.append(F.col("language").isin(*q.languages))
    if q.countries:
        tests.append(F.arrays_overlap("countries", F.array(*[F.lit(c) for c in q.countries])))
    if q.publication_year is not None:
        tests.append(F.col("publication_year") == q.publication_year)
    else:
        if q.from_year is not None:
            tests.append(F.col("publication_year") >= q.from_year)
        if q.to_year is not None:
            tests.append(F.col("publication_year") <= q.to_year)
    for test in tests:
        works = works.where(test)
    return works


def filter_string() -> Column:
    """The textual form of a query row, sorted and joined by commas; NULL (refused) without any constraint.

    Columns: topic_id, primary_topic_only, is_oa, has_doi, oa_status, languages, countries, year, from_year, to_year."""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    text = lambda c: F.col(c).cast("string")
    parts = F.array_compact(
        F.array(
            F.when(F.col("topic_id").isNotNull(), F.concat(F.when(F.col("primary_topic_only"), "primary_topic.id:").otherwise("topics.id:"), "topic_id")),
            F.when(F.col("is_oa"), "is_oa:true"), F.when(F.col("has_doi"), "has_doi:true"), F.when(F.coalesce("oa_status", F.lit("")) != "", F.concat(F.lit("open_access.oa_status:"), "oa_status")),
            F.when(some("languages"), F.concat(F.lit("language:"), F.array_join("languages", "|"))), F.when(some("countries"), F.concat(F.lit("authorships.institutions.country_code:"), F.array_join("countries", "|"))),
            F.when(F.col("year").isNotNull(), F.concat(F.lit("publication_year:"), text("year"))),
            F.when(F.col("year").isNull() & F.col("from_year").isNotNull(), F.concat(F.lit("from_publication_date:"), text("from_year"), F.lit("-01-01"))),
            F.when(F.col("year").isNull() & F.col("to_year").isNotNull(), F.concat(F.lit("to_publication_date:"), text("to_year"), F.lit("-12-31"))),
        )
    )
    return F.nullif(F.array_join(F.array_sort(parts), ","), F.lit(""))


def preview(works: DataFrame, q: Query, limit: int = 10) -> DataFrame:
    """The first few matching works, each with the number of all that match."""
    found = discover(works, q)
    total = found.agg(F.count("*").alias("total"))  # one row
    return found.orderBy("seq").limit(min(limit, 10)).crossJoin(F.broadcast(total)).withColumn("first_author", F.get("authors", F.lit(0)))


def query_documents(documents: DataFrame, artifacts: DataFrame, search: str | None = None, oa_status: str | None = None, has_pdf: bool | None = None, has_xml: bool | None = None, year: int | None = None, journal: str | None = None, status: str | None = None) -> DataFrame:
    """Documents that meet all given filters (wildcards in `search` work as in LIKE). Letters of every script are compared without
    case, in the search and in the text alike."""
    out = documents
    like = lambda c, needle: F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).like(f"%{needle.strip().lower()}%")
    if search:
        fields = [c for c in ("title", "doi", "journal", "document_id") if c in documents.columns]
        test = F.lit(False)
        for c in fields:
            test = test | like(c, search)
        out = out.where(test)
    if oa_status:
        out = out.where(F.lower(F.coalesce("oa_status", F.lit(""))) == oa_status.strip().lower())
    if year is not None:
        out = out.where(F.col("publication_year") == year)
    if journal:
        out = out.where(like("journal", journal))
    if status:
        out = out.where(F.col("status") == status)
    for kind, wanted in (("pdf", has_pdf), ("xml", has_xml)):
        if wanted is not None:
            out = out.join(artifacts.where(F.col("kind") == kind).select("document_id"), "document_id", "left_semi" if wanted else "left_anti")
    return out


def page_of(found: DataFrame, offset: int, limit: int, after: tuple | None = None) -> DataFrame:
    """One page, latest update first, with the total; `after` (updated_at, document_id) pages by key instead of
    sorting all that an offset skips."""
    total = found.agg(F.count("*").alias("total"))  # one row
    rows = found
    if after:
        rows = rows.where((F.col("updated_at") < F.lit(after[0])) | ((F.col("updated_at") == F.lit(after[0])) & (F.col("document_id") > F.lit(after[1]))))
    rows = rows.orderBy(F.col("updated_at").desc(), "document_id")
    return (rows if after else rows.offset(max(0, offset))).limit(max(1, limit)).crossJoin(F.broadcast(total))
