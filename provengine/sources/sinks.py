"""Sidecars, run reports, and export and restore of the ledger. All are tables: never a task or file a document."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import redact_url
from ..operators.audit import audit_foreign_keys, audit_raw_sha, audit_unique, good_json, ledger_digest, ledger_sums
from .versions import current, drop_unused, publish


def build_sidecars(documents: DataFrame, artifacts: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """One nested record a document: bibliographic, artifacts (primary: pdf before xml), provenance, harvest."""
    files = artifacts.groupBy("document_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", F.struct("size_bytes", "content_key", "source"))))).alias("files"),
        F.when(F.bool_or(F.col("kind") == "pdf"), "pdf").when(F.bool_or(F.col("kind") == "xml"), "xml").alias("primary"), F.array_sort(F.collect_set("source")).alias("sources"),
    )
    out = documents.join(files, "document_id", "left")
    if urls is not None:
        offered = urls.groupBy("document_id").agg(F.array_sort(F.collect_set(redact_url("url"))).alias("urls"))
        out = out.join(offered, "document_id", "left")
    else:
        out = out.withColumn("urls", F.array().cast("array<string>"))
    return out.select(
        "document_id", F.struct("journal", "publication_year", "oa_status").alias("bibliographic"), F.struct("primary", "files").alias("artifacts"),
        F.struct(F.coalesce("sources", F.array().cast("array<string>")).alias("cross_checked_via"), F.coalesce("urls", F.array().cast("array<string>")).alias("candidate_urls")).alias("provenance"), F.struct("run_id", "status", "attempts", "updated_at").alias("harvest"),
    )


def run_reports(counters: DataFrame, failures: DataFrame, sample: int = 200) -> DataFrame:
    """Counters of each run with its first failures and the number of all."""
    order = Window.partitionBy("run_id").orderBy("id")
    first = failures.withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample)
    lists = first.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("id", "category", "document_id"))).alias("failures"))
    total = failures.groupBy("run_id").agg(F.count("*").alias("failure_total"))
    return counters.join(total, "run_id", "left").join(lists, "run_id", "left").fillna(0, ["failure_total"])


def write_files(df: DataFrame, root: str) -> tuple[int, int]:
    """Write a file for each row of `df` (name, content as bytes) below `root`, in the tasks that hold the rows; (files, bytes).

    `root` is a URI that Arrow's file systems open, shared by all executors. A file is written under a hidden name and then
    given its own, so readers see whole files and a task that runs again replaces what it wrote."""
    base = root if re.match("[a-z0-9]+://", root) else "file://" + root.removeprefix("file:")

    def write(batches):
        fs, at = FileSystem.from_uri(base)
        fs.create_dir(at, recursive=True)
        for batch in batches:
            sizes = []
            for name, content in zip(*[batch.column(c).to_pylist() for c in ("name", "content")]):
                if not name or "/" in name or name.startswith((".", "_")):
                    raise ValueError(f"no name for a file: {name!r}")
                hidden = f"{at}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(hidden) as out:
                    out.write(content or b"")
                fs.move(hidden, f"{at}/{name}")
                sizes.append(len(content or b""))
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64())], ["size"])

    done = df.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(write, "size long").agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return done[0], done[1]


def export_manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows, digest) of each table."""
    out = None
    for name, table in sorted(tables.items()):
        one = ledger_digest(table, sorted(table.columns)).withColumn("name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def export_ledger(tables: dict[str, DataFrame], keys: dict[str, str], out: str) -> DataFrame:
    """Write each table as compressed JSON lines in the order of its id, and beside them the manifest of what is read back.
    An error if that isn't what was given: the given rows are compared by sums, so row digests are dealt out once."""
    lines = []
    for name, table in sorted(tables.items()):
        table.repartitionByRange(keys[name]).sortWithinPartitions(keys[name]).write.mode("errorifexists").options(ignoreNullFields="false", compression="gzip").json(f"{out}/{name}")
        given = ledger_sums(table, sorted(table.columns)).first()
        back = table.sparkSession.read.schema(table.schema).json(f"{out}/{name}")
        found = ledger_digest(back, sorted(table.columns), rows=given["n"], sums=True).first()
        if given["n"] != found["rows"] or any(given[k] != found[k] for k in given.asDict() if k != "n"):
            raise ValueError(f"{name} isn't read back as it was given")
        lines.append((found["rows"], found["digest"], name))
    manifest = table.sparkSession.createDataFrame(lines, "rows long, digest string, name string")  # one row a table
    manifest.coalesce(1).write.mode("errorifexists").json(f"{out}/manifest")
    return manifest


@dataclass(frozen=True)
class LedgerShape:
    """What a bundle must hold: the columns of each table (DDL) and its key; JSON columns with the root that each must have
    (OBJECT, ARRAY or "" for any); of a table, the column of raw JSON and that of its digest; and references."""

    schemas: dict[str, str]
    keys: dict[str, str]
    json: dict[str, dict[str, str]] = field(default_factory=dict)
    raw: dict[str, tuple[str, str]] = field(default_factory=dict)
    references: list[tuple[str, str, str, str]] = field(default_factory=list)


def _read_lines(spark: SparkSession, at: str, name: str, shape: LedgerShape) -> DataFrame:
    """A table of the bundle with `problem`, what is wrong with a row in itself."""
    lines = spark.read.text(f"{at}/{name}").select(F.from_json("value", shape.schemas[name]).alias("r"), F.from_json("value", "map<string, string>").alias("all"))
    columns = lines.select("r.*").columns
    key, of = shape.keys[name], lambda c: F.col("r").getField(c)
    problem = F.when(F.col("all").isNull(), "no JSON object").when(F.array_sort(F.map_keys("all")) != F.array(*[F.lit(c) for c in sorted(columns)]), "other columns")
    problem = problem.when(of(key).isNull() | (of(key).cast("string") == ""), f"empty {key}")
    raw, digest = shape.raw.get(name, (None, None))
    for column, root in shape.json.get(name, {}).items():
        problem = problem.when(~good_json(of(column), root, nullable=column == raw), f"{column} is no JSON {root or 'text'}")
    if raw:
        problem = problem.when(audit_raw_sha(of(raw), of(digest)).isNotNull(), audit_raw_sha(of(raw), of(digest)))
    return lines.select("r.*", problem.alias(PROBLEM))


#: A column of staged tables; readers of a restored ledger never see it.
PROBLEM = "__problem"


def restore_ledger(spark: SparkSession, bundle: str, shape: LedgerShape, dest: str) -> dict[str, DataFrame]:
    """All or nothing, into an empty ledger. Each try stages the tables in a folder of its own, audits what it staged
    (columns, keys, JSON, raw digests, manifest, references), and only then names that folder the ledger's version. So readers
    (`read_restored`) see nothing or all, and after a crash or a refusal a new try starts clean."""
    if current(spark, f"{dest}/versions")[0] >= 0:
        raise ValueError(f"{dest} is not empty")
    attempt = uuid.uuid4().hex
    staged = {}
    for name in sorted(shape.schemas):
        _read_lines(spark, bundle, name, shape).write.parquet(f"{dest}/attempts/{attempt}/{name}.parquet")
        staged[name] = spark.read.parquet(f"{dest}/attempts/{attempt}/{name}.parquet")
    if problems := _problems(spark, bundle, shape, staged):
        raise ValueError("; ".join(problems))
    publish(spark, f"{dest}/versions", 0, [attempt])
    drop_unused(spark, f"{dest}/versions", f"{dest}/attempts")
    return read_restored(spark, shape, dest)


def _problems(spark: SparkSession, bundle: str, shape: LedgerShape, staged: dict[str, DataFrame]) -> list[str]:
    """What is wrong, a line for each kind: a few strings a table, never rows."""
    counts = reduce(DataFrame.unionByName, [t.where(F.col(PROBLEM).isNotNull()).groupBy(F.lit(n).alias("name"), F.col(PROBLEM).alias("what")).count() for n, t in staged.items()])
    out = [f"{r['name']}: {r['what']} in {r['count']} rows" for r in counts.orderBy("name", "what").collect()]
    if out:
        return out
    tables = {n: t.drop(PROBLEM) for n, t in staged.items()}
    recorded = {r["name"]: (r["rows"], r["digest"]) for r in spark.read.json(f"{bundle}/manifest").collect()}  # one row a table
    out += [f"unknown table {n}" for n in sorted(recorded.keys() - tables.keys())]
    found = {r["name"]: (r["rows"], r["digest"]) for r in export_manifest(tables).collect()}
    out += [f"manifest differs for {n}" for n in sorted(tables) if recorded.get(n) != found[n]]
    for n, t in tables.items():
        twice = audit_unique(t, [shape.keys[n]]).count()
        out += [f"{n}: {twice} keys stand more than once"] if twice else []
    if shape.references:
        broken = audit_foreign_keys(tables, shape.references).groupBy("reference").agg(F.sum("rows").alias("n"))
        out += [f"broken references of {r['reference']} in {r['n']} rows" for r in broken.orderBy("reference").collect()]
    return out


def read_restored(spark: SparkSession, shape: LedgerShape, dest: str) -> dict[str, DataFrame]:
    """The tables of a restored ledger; an error if no restore has been completed."""
    number, parts = current(spark, f"{dest}/versions")
    if number < 0:
        raise ValueError(f"{dest} holds no ledger")
    return {n: spark.read.parquet(f"{dest}/attempts/{parts[0]}/{n}.parquet").drop(PROBLEM) for n in shape.schemas}
