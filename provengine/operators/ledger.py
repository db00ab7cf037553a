"""Deduplication, field-level merging and the append-only ledger that explains it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Merged fields, their policies, and what a record may change by the path it came on.
FIRST_WINS = ("title", "publication_year", "journal", "abstract", "is_oa", "oa_status", "oa_status_source", "doi")
UNIONS = ("authors", "domain_tags", "discovered_via")
MERGE_FIELDS = (*FIRST_WINS, *UNIONS, "identifiers", "candidates", "topics", "cross_checks")
POLICIES = {
    **dict.fromkeys(FIRST_WINS, "first_non_empty"), **dict.fromkeys(UNIONS, "ordered_unique_union"), "identifiers": "first_value_per_identifier",
    "candidates": "unique_url_and_kind_union", "topics": "unique_topic_id_union", "cross_checks": "unique_record_union",
}
PATH_FIELDS = {
    "discovery": MERGE_FIELDS,
    "cross_check": ("title", "publication_year", "journal", "abstract", "is_oa", "identifiers", "candidates", "cross_checks"),
    "fallback": ("candidates", "oa_status", "oa_status_source", "discovered_via"),
}
OUTCOME_STATUSES = ("HIT", "NO_HIT", "TIMEOUT", "ERROR")


def _is_text(df: DataFrame, field: str) -> bool:
    return df.schema[field].dataType.simpleString() == "string"


def filled(df: DataFrame, field: str) -> Column:
    """Neither NULL nor empty; false and 0 are values."""
    kind, col = df.schema[field].dataType.simpleString(), F.col(field)
    if kind == "string":
        return col.isNotNull() & (col != "")
    if kind.startswith(("array", "map")):
        return col.isNotNull() & (F.size(col) > 0)
    return col.isNotNull()


def dedup(obs: DataFrame) -> DataFrame:
    """Observations with created (first of its document), newly_linked (first of its document in its run) and
    preexisting (linked to a document that an earlier observation created)."""
    of = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))
    out = obs.withColumns({"created": of("document_id") == 1, "newly_linked": of("document_id", "run_id") == 1})
    return out.withColumn("preexisting", F.col("newly_linked") & ~F.col("created"))


def dedup_counters(obs: DataFrame) -> DataFrame:
    return dedup(obs).groupBy("run_id").agg(F.count("*").alias("discovered"), F.count_if(~F.col("newly_linked")).alias("duplicates"), F.count_if("created").alias("queued"))


def doi_conflicts(obs: DataFrame) -> DataFrame:
    """Documents refused because their DOI is bound to another: all but the first of each DOI, by seq."""
    first = obs.where(F.col("doi").isNotNull()).groupBy("doi", "document_id").agg(F.min("seq").alias("seq"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("doi").orderBy("seq"))).where("place > 1").drop("place")


def latest_source_records(obs: DataFrame) -> DataFrame:
    """Last write wins for each (document, provider, source_id); max_by combines before the shuffle."""
    facts = [c for c in obs.columns if c not in ("document_id", "provider", "source_id")]
    return obs.groupBy("document_id", "provider", "source_id").agg(F.max_by(F.struct(*facts), "seq").alias("r")).select("document_id", "provider", "source_id", "r.*")


def first_values(obs: DataFrame, fields: tuple[str, ...] = FIRST_WINS) -> DataFrame:
    """First non-empty value of each field in seq order."""
    return obs.groupBy("document_id").agg(*[F.min_by(f, F.when(filled(obs, f), F.col("seq"))).alias(f) for f in fields])


def ordered_unions(obs: DataFrame, fields: tuple[str, ...] = UNIONS) -> DataFrame:
    """Ordered unique unions of array fields in seq order."""
    return obs.groupBy("document_id").agg(
        *[F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.coalesce(f, F.array().cast(obs.schema[f].dataType)).alias("v")))), lambda x: x["v"]))).alias(f) for f in fields]
    )


def merged_identifiers(obs: DataFrame) -> DataFrame:
    """First value of each identifier, as a map."""
    each = obs.select("document_id", "seq", F.explode("identifiers").alias("key", "value")).where(F.col("value").isNotNull())
    first = each.groupBy("document_id", "key").agg(F.min_by("value", "seq").alias("value"))
    return first.groupBy("document_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("identifiers"))


def merged_unique(rows: DataFrame, group: str, keys: tuple[str, ...], order: tuple[str, ...], name: str) -> DataFrame:
    """Candidates unique by (url, kind), topics by id: the first of each key in `order`, collected in it."""
    facts = [c for c in rows.columns if c not in (group, *order)]
    first = rows.groupBy(group, *[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min_by(F.struct(*facts), F.struct(*order)).alias("one"), F.min(F.struct(*order)).alias("at"))
    return first.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "one"))), lambda x: x["one"]).alias(name))


def latest_checks(checks: DataFrame) -> DataFrame:
    """Cross-checks: the latest of each source replaces those before it."""
    facts = [c for c in checks.columns if c not in ("document_id", "source")]
    return checks.groupBy("document_id", "source").agg(F.max_by(F.struct(*facts), "seq").alias("r")).select("document_id", "source", "r.*")


def merge_mask(obs: DataFrame, path: str = "path") -> DataFrame:
    """Add masked_<field>: the value where its record's path may change it, else NULL."""
    allowed = lambda f: F.col(path).isin(*[p for p, fields in PATH_FIELDS.items() if f in fields])
    return obs.withColumns({f"masked_{f}": F.when(allowed(f), F.col(f)) for f in MERGE_FIELDS if f in obs.columns})


def merge_decisions(obs: DataFrame, fields: tuple[str, ...] | None = None, values: bool = False) -> DataFrame:
    """One row for each observation and field: decision, policy, and the observation the value now rests on.

    Where obs has masked_<field>, that is what may change a value, while the record's own value is what is compared.
    Scalars take the first filled value, arrays an ordered unique union. An element's place in that union never changes, so a
    record is judged by the places of its own elements and by how many were there before: linear in the observations of
    a document. `values` adds existing, incoming and chosen as JSON; unions are then built for every row."""
    fields = fields or tuple(f for f in MERGE_FIELDS if f in obs.columns)
    arrays = [f for f in fields if obs.schema[f].dataType.simpleString().startswith("array")]
    parts = [_scalar_steps(obs, [f for f in fields if f not in arrays])] if len(arrays) < len(fields) else []
    parts += [_union_steps(obs, arrays)] if arrays else []
    keeps, takes, agrees = F.col("keeps"), F.col("takes"), F.col("agrees")
    decision = (
        F.when(F.col("no_old") & F.col("no_new"), "NO_VALUE").when(F.col("no_old") & takes, "SELECTED").when(keeps & agrees, "CONFIRMED")
        .when(keeps, "RETAINED").when(takes, "SELECTED").otherwise("COMBINED")
    )
    rows = reduce(DataFrame.unionByName, parts).withColumns({"policy": _policy(fields), "decision": decision}).drop("no_old", "no_new", "keeps", "takes", "agrees")
    out = _rests_on(rows)
    return out.join(_merged_values(obs, fields), ["document_id", "seq", "field_name"]) if values else out


def _policy(fields: tuple[str, ...]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for f in fields for x in (f, POLICIES[f])]), F.col("field_name"))


def _used(obs: DataFrame, field: str) -> str:
    return f"masked_{field}" if f"masked_{field}" in obs.columns else field


def _before():
    return Window.partitionBy("document_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)


def _scalar_values(obs: DataFrame, f: str) -> tuple[Column, Column, Column]:
    """(existing, incoming, chosen) of a scalar field."""
    use = _used(obs, f)
    own = F.when(filled(obs, use), F.col(use))
    existing = F.first(own, ignorenulls=True).over(_before())
    return existing, F.when(filled(obs, f), F.col(f)), F.coalesce(existing, own)


def _steps(obs: DataFrame, structs: list[Column]) -> DataFrame:
    wide = obs.select("document_id", "seq", *[s.alias(f"f{k}") for k, s in enumerate(structs)])
    return wide.select("document_id", "seq", F.explode(F.array(*[f"f{k}" for k in range(len(structs))])).alias("d")).select("document_id", "seq", "d.*")


def _scalar_steps(obs: DataFrame, fields: list[str]) -> DataFrame:
    structs = []
    for f in fields:
        old, new, chosen = _scalar_values(obs, f)
        tests = {"no_old": old.isNull(), "no_new": new.isNull(), "keeps": chosen.eqNullSafe(old), "takes": chosen.eqNullSafe(new), "agrees": new.eqNullSafe(old)}
        structs.append(F.struct(F.lit(f).alias("field_name"), *[t.alias(n) for n, t in tests.items()]))
    return _steps(obs, structs)


def _union_steps(obs: DataFrame, fields: list[str]) -> DataFrame:
    """Of each element the place in its document's union: by its first appearance, and the same ever after. One pass: a row an
    element of what may change the union (own) and of what is compared with it, and one for the observation itself."""

    def listed(of: str, column: str) -> Column:
        elements = F.coalesce(column, F.array().cast(obs.schema[column].dataType))
        return F.transform(elements, lambda v, k: F.struct(F.lit(of).alias("of"), k.alias("i"), F.to_json(F.struct(v.alias("v"))).alias("element")))

    itself = F.array(F.struct(F.lit("row").alias("of"), F.lit(0).alias("i"), F.lit("").alias("element")))
    structs = [F.struct(F.lit(f).alias("field_name"), F.concat(itself, listed("own", _used(obs, f)), listed("offered", f)).alias("all")) for f in fields]
    one = ["document_id", "field_name"]
    each = _steps(obs, structs).select(*one, "seq", F.explode("all").alias("x")).select(*one, "seq", "x.*")
    at = F.struct("seq", "i")
    first = F.min(F.when(F.col("of") == "own", at)).over(Window.partitionBy(*one, "element"))
    place = F.dense_rank().over(Window.partitionBy(*one).orderBy(F.col("first").asc_nulls_last())) - 1
    placed = each.withColumn("first", first).withColumn("place", F.when(F.col("first").isNotNull(), place))
    fits = F.when(F.col("of") == "offered", F.coalesce(F.col("place") == F.col("i"), F.lit(False)))
    rows = placed.groupBy(*one, "seq").agg(
        F.count_if((F.col("of") == "own") & (F.col("first") == at)).alias("more"), F.count_if(F.col("of") == "offered").alias("n"), F.coalesce(F.bool_and(fits), F.lit(True)).alias("ordered")
    )
    after = F.sum("more").over(Window.partitionBy(*one).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("after", after).withColumn("before", F.col("after") - F.col("more"))
    same = lambda size: F.col("ordered") & (F.col("n") == F.col(size))
    tests = {"no_old": F.col("before") == 0, "no_new": F.col("n") == 0, "keeps": F.col("more") == 0, "takes": same("after"), "agrees": same("before")}
    return out.select("document_id", "seq", "field_name", *[t.alias(n) for n, t in tests.items()])


def _merged_values(obs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """existing, incoming and chosen of each observation and field as JSON: whole prefixes, quadratic for arrays."""
    structs = []
    for f in fields:
        if obs.schema[f].dataType.simpleString().startswith("array"):
            none, use = F.array().cast(obs.schema[f].dataType), _used(obs, f)
            old = F.array_distinct(F.flatten(F.collect_list(F.coalesce(use, none)).over(_before())))
            new, chosen = F.coalesce(f, none), F.array_distinct(F.concat(old, F.coalesce(use, none)))
        else:
            old, new, chosen = _scalar_values(obs, f)
        text = lambda c: F.to_json(F.struct(c.alias("v")))  # noqa: E731  one type for all fields
        structs.append(F.struct(F.lit(f).alias("field_name"), text(old).alias("existing"), text(new).alias("incoming"), text(chosen).alias("chosen")))
    return _steps(obs, structs)


def _rests_on(rows: DataFrame) -> DataFrame:
    """chosen_observation, without recursion: the latest SELECTED before, else the first CONFIRMED before."""
    before = Window.partitionBy("document_id", "field_name").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    at = lambda d: F.when(F.col("decision") == d, F.col("seq"))
    previous = F.coalesce(F.last(at("SELECTED"), ignorenulls=True).over(before), F.first(at("CONFIRMED"), ignorenulls=True).over(before))
    return rows.withColumn("previous", previous).withColumn(
        "chosen_observation",
        F.when(F.col("decision") == "SELECTED", F.col("seq")).when(F.col("decision") == "CONFIRMED", F.coalesce("previous", "seq")).when(F.col("decision") != "COMBINED", F.col("previous")),
    ).drop("previous")


def identities(obs: DataFrame) -> DataFrame:
    out = obs.groupBy("document_id").agg(F.min("seq").alias("created_seq"), F.min_by("doi", F.when(F.col("doi").isNotNull(), F.col("seq"))).alias("doi"))
    return out.select(F.concat(F.lit("work_"), "document_id").alias("work_id"), F.concat(F.lit("publication_"), "document_id").alias("publication_id"), "document_id", "doi", "created_seq")


def observation_rows(obs: DataFrame, raw: str = "raw_json") -> DataFrame:
    return obs.withColumns({"raw_sha256": F.sha2(raw, 256), "evidence_quality": F.when(F.col(raw).isNull(), "NORMALIZED_ONLY").otherwise("RAW_AND_NORMALIZED")})


def files_by_content(files: DataFrame) -> DataFrame:
    """One row a content digest; the same digest with other sizes or kinds is an error."""
    return files.groupBy("sha256").agg(
        F.min_by(F.struct("size_bytes", "kind"), F.struct("first_seen", "size_bytes", "kind")).alias("one"), F.min("first_seen").alias("first_seen"), F.count("*").alias("copies"), (F.count_distinct("size_bytes", "kind") > 1).alias("conflict")
    ).select(F.concat(F.lit("sha256_"), "sha256").alias("file_id"), "one.size_bytes", "one.kind", "first_seen", "copies", "conflict")


def acquisitions_from(artifacts: DataFrame) -> DataFrame:
    """Append-only acquisitions under an id made of what they are; repeats are ignored."""
    ident = F.sha2(F.to_json(F.struct("content_key", "document_id", "kind", "source")), 256)
    return artifacts.withColumn("acquisition_id", F.concat(F.lit("acquisition_"), ident)).dropDuplicates(["acquisition_id"])


def backfill(documents: DataFrame, existing_ids: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """One MIGRATED_CURRENT_VALUE decision for each document and field, NULLs kept, without those already there."""
    wide = documents.select("document_id", *[F.col(f).cast("string").alias(f) for f in fields])
    rows = wide.unpivot(["document_id"], list(fields), "field_name", "value")
    made = rows.withColumn("decision_id", F.concat(F.lit("decision_"), F.sha2(F.concat_ws("\x1f", F.lit("migrated"), F.col("document_id").cast("string"), "field_name"), 256)))
    return made.withColumn("decision", F.lit("MIGRATED_CURRENT_VALUE")).join(existing_ids, "decision_id", "left_anti")


def append_outcomes(requests: DataFrame, existing: DataFrame, new: DataFrame) -> DataFrame:
    """Outcomes to append: known status, a request that exists, none there yet, and the first of the batch."""
    good = new.where(F.col("status").isin(*OUTCOME_STATUSES)).join(requests.select("request_id"), "request_id", "left_semi").join(existing.select("request_id"), "request_id", "left_anti")
    facts = [c for c in new.columns if c != "request_id"]
    return good.groupBy("request_id").agg(F.min_by(F.struct(*facts), "seq").alias("r")).select("request_id", "r.*")


def apply_fallback(canon: DataFrame, record: DataFrame, source: str = "unpaywall") -> DataFrame:
    """A fallback record fills oa_status and its source only where empty, and joins discovered_via."""
    given = record.select("document_id", F.col("oa_status").alias("new_status"))
    empty = F.col("oa_status").isNull() | (F.col("oa_status") == "")
    fills = empty & F.col("new_status").isNotNull() & (F.col("new_status") != "")
    joined = canon.join(given.withColumn("hit", F.lit(True)), "document_id", "left")
    return joined.select(
        *[c for c in canon.columns if c not in ("oa_status", "oa_status_source", "discovered_via")],
        F.when(fills, F.col("new_status")).otherwise(F.col("oa_status")).alias("oa_status"),
        F.when(fills, F.lit(source)).otherwise(F.col("oa_status_source")).alias("oa_status_source"),
        F.when(F.col("hit"), F.array_distinct(F.concat("discovered_via", F.array(F.lit(source))))).otherwise(F.col("discovered_via")).alias("discovered_via"),
    )


# Identifiers that records are paired by, first the strongest, and the order in which matches are named.
PAIRED_BY = ("doi", "pmcid", "pmid")
MATCHED_ON = ("doi", "pmid", "pmcid")
AVAILABILITY = ("is_open_access", "in_epmc", "has_pdf", "has_fulltext_xml", "candidate_count")


def cross_check(canon: DataFrame, other: DataFrame, compare, fields: tuple[str, ...]) -> DataFrame:
    """One row a canonical record (document_id, identifiers, fields): the other provider's record (record_id, identifiers, fields, and
    what it has of AVAILABILITY) that shares an identifier with it, by the strongest kind, then the least record_id.

    matched_on names all identifiers that both hold alike, differences the fields that both fill and that differ once
    `compare` has normalised them. Identifiers of all kinds are joined at once, against one record for each value, so a
    value that many records hold pairs no record twice."""
    kinds = F.array(*[F.lit(k) for k in PAIRED_BY])
    each = lambda df, *rest: df.select(*rest, F.posexplode(kinds).alias("strength", "kind"), "identifiers").withColumn("value", F.try_element_at("identifiers", F.col("kind"))).where("value <> ''")
    available = F.struct(*[F.col(c) if c in other.columns else F.lit(None).alias(c) for c in AVAILABILITY])
    theirs = other.select(F.struct("record_id", "identifiers", *fields, available.alias("availability")).alias("theirs"), "identifiers")
    by_value = each(theirs, "theirs").groupBy("kind", "value").agg(F.min_by("theirs", "theirs.record_id").alias("theirs"))
    found = each(canon, "document_id").join(by_value, ["kind", "value"]).groupBy("document_id").agg(F.min_by("theirs", "strength").alias("theirs"))
    joined = canon.join(found, "document_id", "left")
    same = lambda k: F.try_element_at("identifiers", F.lit(k)) == F.try_element_at("theirs.identifiers", F.lit(k))
    text = lambda f: F.nullif(F.col(f).cast("string"), F.lit(""))
    differ = lambda f: F.when(compare(text(f)) != compare(text(f"theirs.{f}")), F.struct(F.lit(f).alias("field"), text(f).alias("ours"), text(f"theirs.{f}").alias("theirs")))
    return joined.select(
        "document_id", F.col("theirs.record_id").alias("record_id"), F.col("theirs").isNotNull().alias("known_to_provider"),
        F.array_compact(F.array(*[F.when(same(k), k) for k in MATCHED_ON])).alias("matched_on"), F.array_compact(F.array(*[differ(f) for f in fields])).alias("differences"), F.col("theirs.availability").alias("availability"),
    )


def resolve_chain(canon: DataFrame, other: DataFrame) -> DataFrame:
    """The other provider's record by DOI, else stated PMCID, else one from URLs (if none is stated), else PMID."""
    steps = [
        (0, "doi", F.col("doi"), "doi"), (1, "pmcid", F.col("pmcid"), "pmcid"), (2, "url_pmcid", F.when(F.col("pmcid").isNull(), F.col("url_pmcid")), "pmcid"), (3, "pmid", F.col("pmid"), "pmid"),
    ]
    parts = None
    for priority, label, key, theirs in steps:
        left = canon.select("document_id", key.alias("key")).where("key IS NOT NULL")
        right = other.where(F.col(theirs).isNotNull()).groupBy(F.col(theirs).alias("key")).agg(F.min("record_id").alias("record_id"))
        hit = left.join(right, "key").select("document_id", F.lit(priority).alias("priority"), F.lit(label).alias("matched_by"), "record_id")
        parts = hit if parts is None else parts.unionByName(hit)
    best = parts.groupBy("document_id").agg(F.min_by(F.struct("matched_by", "record_id"), "priority").alias("b")).select("document_id", "b.*")
    return canon.select("document_id").join(best, "document_id", "left")
