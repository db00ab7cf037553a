"""Integrity audits: digests, keys, references, transitions, and files against recorded state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Where the pieces of a hash that sums are made of begin: short, so that no sum of longs overflows.
SHIFTS = (0, 24, 48)
# The moves a document's state may make.
ALLOWED = {
    "DISCOVERED": ("NORMALIZED", "SKIPPED", "FAILED_PERMANENT"),
    "NORMALIZED": ("QUEUED", "SKIPPED", "FAILED_PERMANENT"),
    "QUEUED": ("ACQUIRING", "SKIPPED", "FAILED_PERMANENT"),
    "ACQUIRING": ("VALIDATING", "COMPLETED", "FAILED_RETRYABLE", "FAILED_PERMANENT", "SKIPPED", "QUEUED"),
    "VALIDATING": ("COMPLETED", "FAILED_RETRYABLE", "FAILED_PERMANENT", "QUEUED"),
    "COMPLETED": ("QUEUED", "FAILED_RETRYABLE"),
    "FAILED_RETRYABLE": ("QUEUED", "FAILED_PERMANENT", "SKIPPED"),
    "FAILED_PERMANENT": ("QUEUED",),
    "SKIPPED": ("QUEUED",),
}


def orphans(files: DataFrame, documents: DataFrame) -> DataFrame:
    """Corpus files whose document nobody knows."""
    return files.join(documents.select("document_id"), "document_id", "left_anti")


def missing(artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """Recorded artifacts without a file."""
    return artifacts.join(files.select("document_id", "kind"), ["document_id", "kind"], "left_anti")


def _row_digests(table: DataFrame, columns: list[str]) -> DataFrame:
    """The SHA-256 of each row's texts, as bytes."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    return table.select(F.unhex(F.sha2(text, 256)).alias("row"))


def _sums() -> dict[str, Column]:
    """The number of rows, and sums of 24-bit pieces of a hash of row digests; they tell two tables apart without a shuffle."""
    h = F.xxhash64("row")
    return {"n": F.count("*")} | {f"sum_{k}": F.sum(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(0xFFFFFF))) for k in SHIFTS}


def ledger_sums(table: DataFrame, columns: list[str]) -> DataFrame:
    """(n, sum_0, sum_24, sum_48) of a table; `ledger_digest` gives the sums too."""
    return _row_digests(table, columns).agg(*[c.alias(k) for k, c in _sums().items()])


def ledger_digest(table: DataFrame, columns: list[str], buckets: int | None = None, bucket_rows: int = 1 << 18, rows: int | None = None, sums: bool = False) -> DataFrame:
    """(rows, digest), on demand with (sum_0, sum_24, sum_48): row digests, then one for each bucket over its sorted row digests, then one over the buckets.

    A bucket holds 32 bytes a row, and 64 characters a row when it is hashed. Unless their number is given there are 256, doubled until
    `bucket_rows` rows fit in one on average; the number follows from that of the rows, which stands beside the digest and
    is counted unless it is given. Row digests are dealt by bucket as bytes, and only then gathered: a task of the scan sees
    all buckets and can combine nothing."""
    if buckets is None:
        n, buckets = table.count() if rows is None else rows, 256
        while n > buckets * bucket_rows:
            buckets *= 2
    bucket = F.pmod(F.conv(F.hex(F.substring("row", 1, 4)), 16, 10).cast("long"), F.lit(buckets))
    dealt = _row_digests(table, columns).select("row", bucket.alias("bucket")).repartition("bucket")
    hexes = F.transform(F.sort_array(F.collect_list("row")), lambda r: F.lower(F.hex(r)))
    each = dealt.groupBy("bucket").agg(F.sha2(F.array_join(hexes, ","), 256).alias("d"), *[c.alias(k) for k, c in _sums().items()])
    whole = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "d"))), lambda b: b["d"]), ","), 256)
    out = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), whole.alias("digest"), *[F.sum(f"sum_{k}").alias(f"sum_{k}") for k in SHIFTS])
    return out if sums else out.select("rows", "digest")


def audit_columns(tables: dict[str, DataFrame], expected: dict[str, list[str]]) -> list[str]:
    """Problems with the set of tables and of their columns: names alone, nothing is read."""
    out = [f"missing table {t}" for t in sorted(expected.keys() - tables.keys())] + [f"unknown table {t}" for t in sorted(tables.keys() - expected.keys())]
    for t in sorted(expected.keys() & tables.keys()):
        if set(tables[t].columns) != set(expected[t]):
            out.append(f"columns of {t}: {sorted(set(tables[t].columns) ^ set(expected[t]))}")
    return out


def audit_counts(tables: dict[str, DataFrame], manifest: DataFrame) -> DataFrame:
    """Tables whose number of rows isn't the manifest's (name, n)."""
    counts = reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("found")).withColumn("name", F.lit(name)) for name, t in sorted(tables.items())])
    return counts.join(manifest, "name", "full_outer").where(~F.col("found").eqNullSafe(F.col("n")))


def good_json(text: Column, root: str, nullable: bool = False) -> Column:
    """Whether a text is one JSON value and no more, with the declared root (OBJECT, ARRAY, or any).

    The parser stops after a value and says nothing of what follows. So the text must also be the one element of a list
    and the one value of an object: what follows a value can't continue both."""
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    inside = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    good = (F.size(listed) == 1) & inside.isNotNull() & F.schema_of_variant(F.get(listed, F.lit(0))).startswith(root)
    return F.when(text.isNull(), F.lit(nullable)).otherwise(F.coalesce(good, F.lit(False)))


def audit_json(df: DataFrame, column: str, root: str, nullable: bool = False) -> Column:
    """`good_json` of a column."""
    return good_json(F.col(column), root, nullable)


def audit_raw_sha(raw: Column, recorded: Column) -> Column:
    """NULL, or what is wrong with a recorded digest."""
    return F.when(raw.isNull() & recorded.isNotNull(), "digest without raw text").when(raw.isNotNull() & recorded.isNull(), "raw text without digest").when(F.sha2(raw, 256) != recorded, "digest mismatch")


def audit_foreign_keys(tables: dict[str, DataFrame], keys: list[tuple[str, str, str, str]]) -> DataFrame:
    """Broken references as (reference, value, rows), over (table, column, target, target column).

    The references to one column and its values meet in one grouping, which combines before the shuffle; nothing is
    sorted, and a task holds one table of counts. Those of another type than the target are joined with it."""
    kind = lambda t, c: tables[t].select(c).schema[0].dataType
    value = F.col("value").cast("string").alias("value")
    alike: dict[tuple[str, str], list[tuple[str, str]]] = {}
    parts = []
    for table, column, target, target_column in keys:
        if kind(table, column) == kind(target, target_column):
            alike.setdefault((target, target_column), []).append((table, column))
            continue
        child = tables[table].where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("rows"))
        parent = tables[target].select(F.col(target_column).alias("value")).distinct()
        parts.append(child.join(parent, "value", "left_anti").select(F.lit(f"{table}.{column}").alias("reference"), value, "rows"))
    for (target, target_column), mine in alike.items():
        rows = [tables[t].select(F.col(c).alias("value"), F.lit(k).alias("of")) for k, (t, c) in enumerate([(target, target_column), *mine])]
        counts = [F.count_if(F.col("of") == k).alias(f"rows_{k}") for k in range(len(rows))]
        each = reduce(DataFrame.unionByName, rows).where("value IS NOT NULL").groupBy("value").agg(*counts).where("rows_0 = 0")
        found = F.array(*[F.struct(F.lit(f"{t}.{c}").alias("reference"), F.col(f"rows_{k}").alias("rows")) for k, (t, c) in enumerate(mine, 1)])
        parts.append(each.select(value, F.explode(found).alias("x")).where("x.rows > 0").select("x.reference", "value", "x.rows"))
    return reduce(DataFrame.unionByName, parts)


def audit_unique(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that stand more than once, and empty ones."""
    empty = reduce(lambda a, b: a | b, [F.col(k).isNull() | (F.col(k).cast("string") == "") for k in key])
    return df.groupBy(*key).agg(F.count("*").alias("n")).withColumn("empty", empty).where((F.col("n") > 1) | F.col("empty"))


def audit_transitions(history: DataFrame, key: str = "document_id", order: str = "id", status: str = "status") -> DataFrame:
    """Consecutive states of which the second may not follow the first; equal ones always may."""
    before = history.withColumn("previous", F.lag(status).over(Window.partitionBy(key).orderBy(order)))
    pair = lambda a, b: F.concat(a, F.lit(">"), b)
    allowed = [f"{a}>{b}" for a, targets in ALLOWED.items() for b in targets]
    return before.where(F.col("previous").isNotNull() & (F.col("previous") != F.col(status)) & ~pair(F.col("previous"), F.col(status)).isin(*allowed))


def state_after(history: DataFrame, key: str = "document_id", order: str = "id", target: str = "target", start: str = "DISCOVERED") -> DataFrame:
    """Each key's state after its requested moves in order, and how many were refused: an illegal one changes nothing."""
    moves = history.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, target))), lambda x: x[target]).alias("moves"))
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, targets in ALLOWED.items() for b in targets])

    def step(acc: Column, move: Column) -> Column:
        good = (acc["status"] == move) | F.array_contains(allowed, F.concat(acc["status"], F.lit(">"), move))
        return F.struct(F.when(good, move).otherwise(acc["status"]).alias("status"), (acc["refused"] + F.when(good, 0).otherwise(1)).alias("refused"))

    first = F.struct(F.lit(start).alias("status"), F.lit(0).alias("refused"))
    return moves.select(key, F.aggregate("moves", first, step).alias("s")).select(key, "s.status", F.col("s.refused").cast("long").alias("refused"))


def verify(documents: DataFrame, artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """(document_id, kind, problem): state against files (document_id, kind, sha256; sidecars are kind json). One shuffle: all
    that is known of a document meets in its group, which holds its few artifacts and files."""
    row = lambda df, of, **given: df.select("document_id", F.lit(of).alias("of"), *[given.get(c, F.lit(None)).cast("string").alias(c) for c in ("status", "kind", "sha256")])
    fact = {"kind": F.col("kind"), "sha256": F.col("sha256")}
    every = row(documents, "document", status=F.col("status")).unionByName(row(artifacts, "artifact", **fact)).unionByName(row(files, "file", **fact))
    listed = lambda of: F.collect_list(F.when(F.col("of") == of, F.struct("kind", "sha256")))
    known = every.groupBy("document_id").agg(
        F.bool_or(F.col("of") == "document").alias("known"), F.bool_or(F.coalesce(F.col("status") == "COMPLETED", F.lit(False))).alias("done"), listed("artifact").alias("artifacts"), listed("file").alias("files")
    )
    say = lambda kind, problem: F.struct(kind.alias("kind"), F.lit(problem).alias("problem"))
    lacks = lambda of, kind: F.col("done") & ~F.exists(of, lambda x: F.coalesce(x["kind"] == kind, F.lit(False)))

    def against_files(artifact: Column) -> Column:
        mine = F.filter("files", lambda f: f["kind"] == artifact["kind"])
        wrong = F.transform(F.filter(mine, lambda f: f["sha256"] != artifact["sha256"]), lambda f: say(f["kind"], "sha256 mismatch"))
        return F.when(F.size(mine) == 0, F.array(say(artifact["kind"], "missing file"))).otherwise(wrong)

    none = F.array().cast("array<struct<kind: string, problem: string>>")
    problems = F.concat(
        F.when(lacks("files", "json"), F.array(say(F.lit("json"), "missing sidecar"))).otherwise(none),
        F.when(lacks("artifacts", "pdf"), F.array(say(F.lit("pdf"), "completed without pdf"))).otherwise(none),
        F.flatten(F.transform("artifacts", against_files)),
        F.when(~F.col("known"), F.transform("files", lambda f: say(f["kind"], "orphan"))).otherwise(none),
    )
    return known.select("document_id", F.explode(problems).alias("p")).select("document_id", "p.*")


def verify_history(verifications: DataFrame, n: int) -> DataFrame:
    return verifications.orderBy(F.col("checked_at").desc(), F.col("id").desc()).limit(n)


def verify_triplets(manifests: DataFrame, files: DataFrame, receipts: DataFrame, parts: int = 3) -> DataFrame:
    """evidence_id, status: manifests (evidence_id, name, sha256) against files (evidence_id, name, sha256) and
    receipts (evidence_id, digest of the sorted file digests)."""
    want = manifests.join(files.select("evidence_id", "name", F.col("sha256").alias("found")), ["evidence_id", "name"], "left")
    each = want.groupBy("evidence_id").agg(
        F.count("*").alias("n"), F.count("found").alias("there"), F.count_if(F.col("found") != F.col("sha256")).alias("wrong"), F.sha2(F.array_join(F.sort_array(F.collect_list("found")), ","), 256).alias("digest")
    )
    out = receipts.withColumnRenamed("digest", "receipt").join(each, "evidence_id", "full_outer")
    status = F.when(F.col("n").isNull(), "not_found").when((F.col("n") != parts) | (F.col("there") < F.col("n")), "incomplete").when(F.col("wrong") > 0, "integrity_failure").when(F.col("receipt").isNotNull() & (F.col("receipt") != F.col("digest")), "receipt_mismatch").otherwise("ok")
    return out.select("evidence_id", status.alias("status"))


def plan_work(documents: DataFrame, artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """What a run must do with each document: skip, rewrite_sidecar, requeue (completed, but its file is gone) or acquire."""
    flag = lambda df, kind, name: df.where(F.col("kind") == kind).select("document_id").distinct().withColumn(name, F.lit(True))
    out = documents.join(flag(artifacts, "pdf", "recorded"), "document_id", "left").join(flag(files, "pdf", "present"), "document_id", "left").join(flag(files, "json", "sidecar"), "document_id", "left")
    whole = (F.col("status") == "COMPLETED") & F.col("recorded").isNotNull() & F.col("present").isNotNull()
    action = F.when(whole & F.col("sidecar").isNotNull(), "skip").when(whole, "rewrite_sidecar").when(F.col("status") == "COMPLETED", "requeue").otherwise("acquire")
    return out.select("document_id", action.alias("action"))


def adopt(files: DataFrame, artifacts: DataFrame, verdict: Column) -> DataFrame:
    """Files without an artifact row: valid ones are adopted, others discarded."""
    free = files.join(artifacts.select("document_id", "kind"), ["document_id", "kind"], "left_anti")
    return free.withColumn("action", F.when(verdict == "OK", "adopt").otherwise("discard"))


def leak_scan(tables: dict[str, DataFrame], secrets: list[str]) -> DataFrame:
    """(table, column, rows) of string columns that hold a configured secret."""
    parts = []
    for name, table in tables.items():
        texts = [f.name for f in table.schema.fields if f.dataType.simpleString() == "string"]
        hit = lambda c: reduce(lambda a, b: a | b, [F.coalesce(F.col(c).contains(s), F.lit(False)) for s in secrets])
        counts = table.agg(*[F.count_if(hit(c)).alias(c) for c in texts])
        parts.append(counts.unpivot([], texts, "column", "rows").select(F.lit(name).alias("table"), "column", "rows"))
    return reduce(DataFrame.unionByName, parts).where("rows > 0")
