"""Plans whose shuffles and memory a task must not outgrow a larger corpus."""

import glob
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from provengine.operators import audit, project, rank
from provengine.plans import QUERIES
from provengine.sources import sinks as K
from provengine.streaming import golden
from provengine.streaming import stream as M

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_digest_deals_bytes_once(spark):
    df = spark.range(2000).select(F.col("id"), F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("v"))
    texts = [hashlib.sha256(f"{k}\x1f{k % 7 if k % 3 else chr(0)}".encode()).hexdigest() for k in range(2000)]
    buckets = {}
    for t in sorted(texts):
        buckets.setdefault(int(t[:8], 16) % 256, []).append(t)
    want = hashlib.sha256(",".join(hashlib.sha256(",".join(b).encode()).hexdigest() for _, b in sorted(buckets.items())).encode()).hexdigest()
    out = audit.ledger_digest(df, ["id", "v"], rows=2000)
    assert tuple(out.first()) == (2000, want) and out.columns == ["rows", "digest"]
    assert tuple(audit.ledger_digest(df.limit(0), ["id", "v"], sums=True).first())[0] == 0
    lines = plan(out).splitlines()
    dealt = next(k for k, line in enumerate(lines) if "REPARTITION_BY_COL" in line)
    assert not any("collect_list" in line for line in lines[dealt:])  # rows are gathered behind the exchange alone


def test_export_is_compressed_and_read_back(spark):
    at = M.scratch(spark)
    tables = {"a": spark.range(300).select("id", F.lit("x\r\n \x00").alias("v")), "b": spark.range(0).select("id")}
    manifest = K.export_ledger(tables, {"a": "id", "b": "id"}, f"{at}/bundle")
    assert sorted(map(tuple, manifest.select("name", "rows").collect())) == [("a", 300), ("b", 0)]
    assert sorted(map(tuple, spark.read.schema(manifest.schema).json(f"{at}/bundle/manifest").collect())) == sorted(map(tuple, manifest.collect())) == sorted(map(tuple, K.export_manifest(tables).collect()))
    files = sorted(glob.glob(f"{at.removeprefix('file://')}/bundle/a/part-*"))
    assert files and all(f.endswith(".json.gz") for f in files) and sum(len(gzip.open(f).readlines()) for f in files) == 300
    with pytest.raises(ValueError, match="read back"):
        K.export_ledger({"a": spark.range(3).select("id", F.expr("timestamp'2020-01-01 00:00:00.000001'").alias("v"))}, {"a": "id"}, f"{at}/other")


def test_abstracts_are_rebuilt_inside_the_row(spark):
    assert "Exchange" not in plan(QUERIES["rebuild_abstract"](spark, SF))
    long = ["w%d" % (k * k % 97) for k in range(5000)]
    df = spark.createDataFrame([(1, ["b", "a", "b", ""]), (2, []), (3, None), (4, long)], "k int, w array<string>")
    got = {r.k: r.m for r in df.select("k", project.inverted_index(F.col("w")).alias("m")).collect()}
    assert got[1] == {"b": [0, 2], "a": [1], "": [3]} and got[2] == {} and got[3] is None
    assert got[4] == {w: [k for k, x in enumerate(long) if x == w] for w in set(long)}


def test_candidates_are_dealt_once_by_their_number(spark):
    text = plan(QUERIES["fallback_pick"](spark, SF))
    assert text.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in text
    rows = spark.range(1000).select((F.col("id") % 50).alias("document_id"), "id")
    few, many = (rank.by_document(rows, most) for most in (10, 100))
    assert (few.rdd.getNumPartitions(), many.rdd.getNumPartitions()) == (100, 10)
    assert few.select("document_id", F.spark_partition_id()).distinct().count() == 50
    for name in ("rank_candidates", "rank_oa_locations"):
        assert plan(QUERIES[name](spark, SF)).count("Exchange hashpartitioning") == 1


def test_references_meet_their_target_in_one_grouping(spark):
    text = plan(QUERIES["audit_foreign_keys"](spark, SF))
    assert "Join" not in text and "Sort" not in text and text.count("Exchange hashpartitioning") == 1
    tables = {
        "a": spark.createDataFrame([(1,), (1,), (2,), (None,), (9,)], "r long"), "b": spark.createDataFrame([(2,), (8,), (9,)], "r long"), "c": spark.createDataFrame([("1",), ("7",), ("7",)], "r string"),
        "d": spark.createDataFrame([(1,), (1,), (None,)], "k long"),
    }
    got = audit.audit_foreign_keys(tables, [(t, "r", "d", "k") for t in "abc"])
    assert got.columns == ["reference", "value", "rows"]
    assert sorted(map(tuple, got.collect())) == [("a.r", "2", 1), ("a.r", "9", 1), ("b.r", "2", 1), ("b.r", "8", 1), ("b.r", "9", 1), ("c.r", "7", 2)]


def test_golden_batches_write_what_they_bring(spark):
    """A batch neither reads nor writes what is known of its documents; readers and foldings of parts count each fact once."""
    root = M.scratch(spark)
    table = golden.Golden(root, most_parts=2)
    frames = [spark.createDataFrame([(d, 10 * k + n, f"{d} {k}", [f"a{k}", "a"]) for n, d in enumerate("pq")], "document_id string, seq long, title string, authors array<string>") for k in (3, 1, 2, 1)]
    for k, frame in enumerate(frames):
        table.take(frame, k)
        if k < 2:
            written = spark.read.parquet(f"{root}/parts/b{k}")
            assert written.where("field = 'title'").count() == 2 and written.where("field = 'authors'").count() == 4
    got = table.read(spark, frames[0].schema)
    assert plan(got).count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, got.collect())) == [("p", "p 1", ["a1", "a", "a2", "a3"]), ("q", "q 1", ["a1", "a", "a2", "a3"])]


def test_new_pieces_are_encoded_together():
    """Pieces with line feeds and blanks too; the library gets none alone."""
    np, tokens, names = (pytest.importorskip(m) for m in ("numpy", "provengine.llm.tokens", "public_tokenizers"))
    encode = tokens.PieceEncoder(names.path("byte_bpe_50k.json"), 2)
    texts = ["one\n\n two  three\n", "", "\n", " \t\r\n  x\x00\x7f\xa0\xad\u00e9\u0104\u2014 ", "0 1  22\n\n\n333", "".join(map(chr, range(0x28, 0x500)))]
    want = [[*encode.library.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    encode.library = None
    raw = [t.encode() for t in texts]
    for _ in range(2):  # new, then remembered
        ids, sizes = encode(np.concatenate([[0], np.cumsum([len(r) for r in raw])]), np.frombuffer(b"".join(raw), dtype=np.uint8))
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want
