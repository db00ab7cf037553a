"""Streams and versions: order, restarts after a crash, the state store, and what readers see."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from provengine.operators.audit import ALLOWED, state_after
from provengine.plans import flow_queries as Q
from provengine.sources import pages as P
from provengine.sources import sinks as K
from provengine.sources import versions as V
from provengine.streaming import cursors, golden, machine
from provengine.streaming import stream as M

SF = "/root/testdata/sf0.001"


def page(ids, following):
    return json.dumps({"results": [{"id": i} for i in ids], "meta": {"next_cursor": following}})


def discovered(spark, batches, most=None, landed=lambda n: None, root=None):
    """Run discovery over batches of (run, cursor, raw), one file a batch."""
    root = root or M.scratch(spark)
    for rows in batches:
        spark.createDataFrame([(r, c, most, raw) for r, c, raw in rows], "run_id string, cursor string, most int, raw string").coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema("run_id string, cursor string, most int, raw string").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    records, at = cursors.stream_discover(stream, root, P.usable_records, landed)
    ids = [json.loads(r.record)["id"] for r in records.orderBy("run_id", "page", "place").collect()]
    return ids, {r.run_id: (r.page, r.next_cursor, r.seen, r.stopped) for r in at.collect()}, root


def test_cursors_out_of_order(spark):
    a, b, c = page("ab", "x"), page("cd", "y"), page("e", None)
    ids, at, _ = discovered(spark, [[("r", "y", c)], [("r", "x", b), ("r", "x", b)], [("r", "*", a)], [("r", "x", page("zz", "q"))]])
    assert ids == list("abcde") and at == {"r": (3, None, 5, cursors.NO_CURSOR)}


def test_cursors_stop(spark):
    pages = [("round", "*", page("a", "x")), ("round", "x", page("b", "*")), ("self", "*", page("a", "*")), ("none", "*", page("", "x")), ("none", "x", page("b", None)), ("waits", "x", page("a", None))]
    ids, at, _ = discovered(spark, [pages[::2], pages[1::2]])
    assert at == {"round": (2, None, 2, cursors.REPEATED), "self": (1, None, 1, cursors.REPEATED), "none": (1, None, 0, cursors.EMPTY)}
    assert sorted(ids) == ["a", "a", "b"]
    ids, at, _ = discovered(spark, [[("r", "*", page("abc", "x")), ("r", "x", page("def", "y")), ("r", "y", page("g", None))]], most=5)
    assert ids == list("abcde") and at == {"r": (2, None, 5, cursors.LIMIT)}


def test_cursors_broken_page_is_read_again(spark):
    ids, at, root = discovered(spark, [[("r", "*", page("a", "x")), ("r", "x", "[1"), ("r", None, page("z", None))]])
    assert ids == ["a"] and at == {"r": (1, "x", 1, None)}
    ids, at, _ = discovered(spark, [[("r", "x", page("b", None))]], root=root)  # the same checkpoint goes on
    assert ids == ["a", "b"] and at == {"r": (2, None, 2, cursors.NO_CURSOR)}


def test_cursors_crash_between_records_and_places(spark):
    chain = [[("r", "*" if k == 0 else f"c{k}", page([f"{k}a", f"{k}b"], f"c{k + 1}" if k < 4 else None))] for k in range(5)]
    root, calls = M.scratch(spark), []

    def fail_once(number):
        calls.append(number)
        if number == 2 and calls.count(2) == 1:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        discovered(spark, chain, landed=fail_once, root=root)
    assert spark.read.parquet(f"{root}/records").count() == 6 and spark.read.parquet(f"{root}/at").agg(F.max("page")).first()[0] == 2
    ids, at, _ = discovered(spark, [], landed=fail_once, root=root)
    assert ids == [f"{k}{x}" for k in range(5) for x in "ab"] and at["r"] == (5, None, 10, cursors.NO_CURSOR)
    assert calls == [0, 1, 2, 2, 3, 4]  # the page in hand is read again, none is skipped


class Progress(StreamingQueryListener):
    def __init__(self):
        self.metrics = set()

    def onQueryStarted(self, event):
        pass

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def onQueryProgress(self, event):
        for op in event.progress.stateOperators:
            self.metrics |= {op.operatorName, *op.customMetrics}


@pytest.mark.parametrize("held", [50_000, 3])
def test_transitions_in_batches_with_a_restart(spark, held):
    targets = F.array(*[F.lit(t) for t in ALLOWED])
    moves = spark.range(900).select((F.col("id") % 7).alias("document_id"), "id", F.get(targets, F.pmod(F.xxhash64("id"), F.lit(len(ALLOWED))).cast("int")).alias("target"))
    seen, root = Progress(), M.scratch(spark)
    spark.streams.addListener(seen)
    try:
        M.run_to_table(machine.stream_transitions(M.land_in_order(moves.where("id < 500"), root, "id", "document_id", 3), held=held), root)
        more = M.land_in_order(moves.where("id >= 500"), root, "id", "document_id", 2)  # the checkpoint is taken up again
        out = M.run_to_table(machine.stream_transitions(more, held=held), root)
        got = {r.document_id: (r.status, r.refused) for r in out.groupBy("document_id").agg(F.max_by("after", "id").alias("status"), F.count_if(~F.col("accepted")).alias("refused")).collect()}
    finally:
        spark.streams.removeListener(seen)
    assert out.count() == 900 and out.select("batch_id").distinct().count() >= 4
    assert got == {r.document_id: (r.status, r.refused) for r in state_after(moves).collect()}
    assert any("rocksdb" in m for m in seen.metrics)


def test_golden_versions(spark):
    """Each batch rewrites the documents it touches; a batch that is taken again changes nothing; a reader holds one version."""
    root = M.scratch(spark)
    table = golden.Golden(root, most_parts=2)
    schema = "document_id string, seq long, title string, authors array<string>, cross_checks array<struct<source: string, n: int>>"
    batches = [
        [("a", 5, "late", ["x"], [("s", 5)]), ("b", 1, "b1", ["q", "q", None], None)],
        [("a", 2, "first", ["y", "x"], [("s", 2), ("t", 2)])],
        [("c", 9, None, [], [])],
        [("b", 7, "b7", ["r"], [("s", 7)]), ("a", 8, None, None, [("t", 8)])],
    ]
    frames = [spark.createDataFrame(rows, schema) for rows in batches]
    kind = frames[0].schema
    for k, frame in enumerate(frames):
        table.take(frame, k)
        if k == 1:
            assert spark.read.parquet(f"{root}/parts/b1").select("document_id").distinct().collect() == [("a",)]
            held = table.read(spark, kind)
        table.take(frame, k)
    got = {r.document_id: (r.title, r.authors, [tuple(c) for c in r.cross_checks]) for r in table.read(spark, kind).collect()}
    assert got == {"a": ("first", ["y", "x"], [("t", 8), ("s", 5)]), "b": ("b1", ["q", "r"], [("s", 7)]), "c": (None, [], [])}
    assert V.current(spark, f"{root}/versions")[0] == 3 and V.current(spark, f"{root}/versions", 3)[0] == 2
    assert held.columns == ["document_id", "title", "authors", "cross_checks"]


def test_versions(spark):
    root = M.scratch(spark)
    assert V.current(spark, root) == (-1, [])
    V.publish(spark, root, 0, ["a"])
    V.publish(spark, root, 1, ["a", "b"])
    spark.range(1).write.parquet(f"{root}/version=2/half")  # a folder that was never committed
    assert V.current(spark, root) == (1, ["a", "b"]) and V.current(spark, root, 1) == (0, ["a"])


# --- restore -----------------------------------------------------------------------------------


@pytest.fixture()
def ledger(spark):
    tables = {
        "works": spark.createDataFrame([("w1", '{"a":1}'), ("w2", "{}")], "work_id string, meta string"),
        "seen": spark.createDataFrame([("s1", "w1", '{"b":2}'), ("s2", "w2", None)], "seen_id string, work_id string, raw string").withColumn("sha", F.sha2("raw", 256)),
    }
    shape = K.LedgerShape(
        {n: ", ".join(f"{c} {k}" for c, k in t.dtypes) for n, t in tables.items()}, {"works": "work_id", "seen": "seen_id"}, {"works": {"meta": "OBJECT"}, "seen": {"raw": ""}}, {"seen": ("raw", "sha")}, [("seen", "work_id", "works", "work_id")]
    )
    return tables, shape


def bundle(spark, tables, shape, **changed):
    at = M.scratch(spark)
    K.export_ledger({**tables, **changed}, shape.keys, f"{at}/bundle")
    return at


def rows(tables):
    return {n: sorted(map(tuple, t.collect()), key=str) for n, t in tables.items()}


def test_restore_round_trip(spark, ledger):
    tables, shape = ledger
    at = bundle(spark, tables, shape)
    with pytest.raises(ValueError, match="holds no ledger"):
        K.read_restored(spark, shape, f"{at}/new")
    assert rows(K.restore_ledger(spark, f"{at}/bundle", shape, f"{at}/new")) == rows(tables)
    assert rows(K.read_restored(spark, shape, f"{at}/new")) == rows(tables)
    with pytest.raises(ValueError, match="not empty"):
        K.restore_ledger(spark, f"{at}/bundle", shape, f"{at}/new")


@pytest.mark.parametrize(
    ("table", "change", "said"),
    [
        ("seen", lambda t: t.withColumn("work_id", F.lit("w9")), "broken references of seen.work_id in 2 rows"),
        ("works", lambda t: t.withColumn("meta", F.lit("{")), "works: meta is no JSON OBJECT in 2 rows"),
        ("works", lambda t: t.withColumn("meta", F.lit("[]")), "works: meta is no JSON OBJECT in 2 rows"),
        ("works", lambda t: t.withColumn("meta", F.lit(None).cast("string")), "works: meta is no JSON OBJECT"),
        ("seen", lambda t: t.withColumn("raw", F.when(F.col("raw").isNotNull(), "{")), "raw is no JSON text in 1 rows"),
        ("seen", lambda t: t.withColumn("sha", F.when(F.col("raw").isNotNull(), "00")), "seen: digest mismatch in 1 rows"),
        ("seen", lambda t: t.withColumn("sha", F.lit("00")), "seen: digest without raw text in 1 rows"),
        ("seen", lambda t: t.withColumn("sha", F.lit(None).cast("string")), "seen: raw text without digest in 1 rows"),
        ("works", lambda t: t.withColumn("work_id", F.lit("")), "works: empty work_id in 2 rows"),
        ("works", lambda t: t.union(t), "works: 2 keys stand more than once"),
        ("works", lambda t: t.withColumn("extra", F.lit(1)), "works: other columns in 2 rows"),
        ("works", lambda t: t.drop("meta"), "works: other columns in 2 rows"),
    ],
)
def test_restore_refuses(spark, ledger, table, change, said):
    tables, shape = ledger
    at = bundle(spark, tables, shape, **{table: change(tables[table])})
    with pytest.raises(ValueError, match=said.replace(".", r"\.")):
        K.restore_ledger(spark, f"{at}/bundle", shape, f"{at}/new")
    with pytest.raises(ValueError, match="holds no ledger"):
        K.read_restored(spark, shape, f"{at}/new")


def test_restore_refuses_another_manifest_and_broken_lines(spark, ledger):
    tables, shape = ledger
    at = bundle(spark, tables, shape)
    other = bundle(spark, tables, shape, works=tables["works"].withColumn("meta", F.lit('{"c":3}')))
    spark.read.text(f"{other}/bundle/works").write.mode("overwrite").text(f"{at}/bundle/works")
    with pytest.raises(ValueError, match="manifest differs for works"):
        K.restore_ledger(spark, f"{at}/bundle", shape, f"{at}/new")
    spark.createDataFrame([("not json",)], "value string").write.mode("append").text(f"{at}/bundle/works")
    with pytest.raises(ValueError, match="works: no JSON object in 1 rows"):
        K.restore_ledger(spark, f"{at}/bundle", shape, f"{at}/new")


def test_restore_after_a_crash(spark, ledger, monkeypatch):
    tables, shape = ledger
    at = bundle(spark, tables, shape)

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(K, "publish", lost)  # all is staged, nothing is named yet
        with pytest.raises(RuntimeError, match="lost"):
            K.restore_ledger(spark, f"{at}/bundle", shape, f"{at}/new")
    with pytest.raises(ValueError, match="holds no ledger"):
        K.read_restored(spark, shape, f"{at}/new")
    assert rows(K.restore_ledger(spark, f"{at}/bundle", shape, f"{at}/new")) == rows(tables)
    assert len(V._folders(spark, f"{at}/new/attempts")[1]) == 1  # what the lost try had staged is gone


def test_evidence_shape(spark):
    tables, shape = Q.evidence(spark, SF)
    assert set(tables) == set(shape.schemas) == set(shape.keys)


# --- files and tables --------------------------------------------------------------------------


def test_files_are_written_by_tasks(spark):
    at = M.scratch(spark)
    rows = [("d1.pdf", b"%PDF"), ("d2.XML", b"<a/>"), ("d3.part", b"p"), ("d4.txt", b"x"), ("d5.json", None)]
    df = spark.createDataFrame(rows, "name string, content binary").repartition(3)
    assert K.write_files(df, f"{at}/corpus") == (5, 10) == K.write_files(df, f"{at}/corpus")  # a second try replaces the files
    found = {(r.document_id, r.kind, r.size_bytes, r.partial) for r in P.scan_corpus(spark, f"{at}/corpus").collect()}
    assert found == {("d1", "pdf", 4, False), ("d2", "xml", 4, False), ("d3", "part", 1, True)}  # not the empty one
    with pytest.raises(Exception, match="no name for a file"):
        K.write_files(spark.createDataFrame([("../d1.pdf", b"")], "name string, content binary"), f"{at}/corpus")
    assert K.write_files(df.limit(0), f"{at}/corpus") == (0, 0)


def test_ledger_tables_join_and_look_up_where_they_lie(spark):
    at, tag = M.scratch(spark), M.scratch(spark)[-8:]
    one = spark.range(5000).select(F.concat(F.lit("doc-"), F.col("id").cast("string")).alias("document_id"), F.concat(F.lit("10.1/"), F.xxhash64("id").cast("string")).alias("doi"))
    a = P.write_ledger(one, at, f"a_{tag}", buckets=4)
    b = P.write_ledger(one.select("document_id", F.length("doi").alias("n")), at, f"b_{tag}", buckets=4)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    joined = a.join(b.hint("merge"), "document_id")
    assert joined.count() == 5000 and "Exchange" not in plan(joined)
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # so that the plan tells of the buckets it reads
    try:
        assert "SelectedBucketsCount: 1 out of 4" in plan(a.where("document_id = 'doc-77'"))
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert blooms(f"{at}/a_{tag}") > 1000 and a.where(F.col("doi") == a.where("document_id = 'doc-77'").first().doi).count() == 1


def blooms(root):
    """Bytes of the files of a local table that are neither columns nor footer."""
    import glob
    import os

    import pyarrow.parquet as pq

    out = 0
    for f in glob.glob(root.removeprefix("file:").replace("///", "/") + "/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        groups = [meta.row_group(k) for k in range(meta.num_row_groups)]
        out += os.path.getsize(f) - meta.serialized_size - sum(g.column(c).total_compressed_size for g in groups for c in range(g.num_columns))
    return out


def test_vocabularies(spark):
    from provengine.functions import vocabulary

    languages, countries = ({r.code: r.name for r in v(spark).collect()} for v in (vocabulary.languages, vocabulary.countries))
    assert (len(languages), len(countries)) == (181, 247)
    assert not {"iw", "in", "ji", "mo", "bh"} & set(languages) and {"he", "id", "yi", "sh"} <= set(languages)
    assert countries["XK"] == "Kosovo" and "EH" not in countries and (languages["de"], countries["AT"]) == ("German", "Austria")
