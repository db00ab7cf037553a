"""Decisions over long histories, pairing by several identifiers, running sums of uneven sequences, and verification in one pass."""

import random
import time

from pyspark.sql import functions as F

from provengine.functions import scalar
from provengine.operators import audit, ledger, stats
from provengine.session import scratch

DECIDE = {  # (nothing before, nothing offered, chosen is what was, chosen is what is offered, both alike)
    "NO_VALUE": lambda o, n, k, t, a: o and n,
    "SELECTED": lambda o, n, k, t, a: o and t,
    "CONFIRMED": lambda o, n, k, t, a: k and a,
    "RETAINED": lambda o, n, k, t, a: k,
    "SELECTED ": lambda o, n, k, t, a: t,
    "COMBINED": lambda o, n, k, t, a: True,
}


def unique(values):
    return list(dict.fromkeys(values))


def decided(rows):
    """rows: (masked, own) lists of one document in order."""
    union, out = [], []
    for masked, own in rows:
        chosen = unique(union + masked)
        tests = (not union, not own, chosen == union, chosen == own, own == union)
        out.append(next(d.strip() for d, rule in DECIDE.items() if rule(*tests)))
        union = chosen
    return out


def test_decisions_of_unions(spark):
    rng = random.Random(2)
    lists = lambda: rng.choice([[], [rng.choice("abcd")], rng.choices(["a", "b", "c", None], k=rng.randint(2, 4))])
    history = {d: [(lists(), lists()) for _ in range(25)] for d in "xyz"}
    for d, rows in history.items():
        history[d] = [(own if rng.random() < 0.7 else masked, own) for masked, own in rows]
        whole = unique([v for masked, _ in history[d] for v in masked])
        history[d] += [([], whole), (whole, whole), (["new"], [*whole, "new"]), ([], [*whole, "new"][::-1])]
    data = [(d, k, own, masked) for d, rows in history.items() for k, (masked, own) in enumerate(rows)]
    obs = spark.createDataFrame(data, "document_id string, seq long, authors array<string>, masked_authors array<string>")
    got = ledger.merge_decisions(obs, ("authors",), values=True).orderBy("document_id", "seq").collect()
    assert [r.decision for r in got] == [x for d in sorted(history) for x in decided(history[d])]
    assert len({r.decision for r in got}) == 5 and {r.policy for r in got} == {"ordered_unique_union"}
    plain = ledger.merge_decisions(obs, ("authors",)).orderBy("document_id", "seq").collect()
    assert [(r.decision, r.chosen_observation) for r in plain] == [(r.decision, r.chosen_observation) for r in got] and "chosen" not in plain[0]
    null = spark.createDataFrame([("n", 1, None), ("n", 2, ["a"])], "document_id string, seq long, authors array<string>")
    assert [r.decision for r in ledger.merge_decisions(null, ("authors",)).orderBy("seq").collect()] == ["NO_VALUE", "SELECTED"]


def test_decisions_grow_with_the_history(spark):
    """Ten times the observations of one document take far less than a hundred times as long."""

    def seconds(n):
        obs = spark.range(n).select(F.lit("d").alias("document_id"), F.col("id").alias("seq"), F.array((F.col("id") % 5000).cast("string"), F.col("id").cast("string")).alias("authors"))
        began = time.perf_counter()
        ledger.merge_decisions(obs, ("authors",)).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds(100)
    few = seconds(2_000)
    assert seconds(20_000) < 10 * few + 5


def test_cross_check_by_each_identifier(spark):
    kind = "map<string, string>"
    canon = spark.createDataFrame(
        [
            ("a", {"doi": "d1", "pmid": "1"}, "One", "J"), ("b", {"pmcid": "PMC2", "pmid": "9"}, "Two", None), ("c", {"pmid": "3"}, "Three", "J"), ("d", {"doi": "none"}, "Four", "J"), ("e", None, None, None),
            ("f", {"doi": "d6", "pmid": "3"}, "six.", "K"), ("g", {"doi": ""}, "x", "y"),
        ],
        f"document_id string, identifiers {kind}, title string, journal string",
    )
    other = spark.createDataFrame(
        [
            (10, {"doi": "d1", "pmid": "1"}, "one", "K", True), (11, {"doi": "d1"}, "uno", "J", None), (12, {"pmcid": "PMC2", "pmid": "8"}, "Two", "J", False), (13, {"pmid": "9"}, "Other", "J", None), (14, {"pmid": "3"}, "", "J", None),
            (15, {"pmid": "3", "doi": "d6"}, "Six", "K", None), (16, {"doi": ""}, "x", "y", None), (17, None, "x", "y", None),
        ],
        f"record_id int, identifiers {kind}, title string, journal string, is_open_access boolean",
    )
    got = {r.document_id: r for r in ledger.cross_check(canon, other, scalar.norm_cmp, ("title", "journal")).collect()}
    assert {d: (r.record_id, r.matched_on, [x.field for x in r.differences]) for d, r in got.items()} == {
        "a": (10, ["doi", "pmid"], ["journal"]), "b": (12, ["pmcid"], []), "c": (14, ["pmid"], []), "d": (None, [], []), "e": (None, [], []), "f": (15, ["doi", "pmid"], []), "g": (None, [], []),
    }
    assert got["a"].availability.is_open_access and got["a"].known_to_provider and not got["d"].known_to_provider and got["d"].availability is None
    assert (got["a"].differences[0].ours, got["a"].differences[0].theirs) == ("J", "K")


def test_running_credits_in_a_narrow_range(spark):
    """Nearly all rows in one narrow range of the sequence, far from the rest: segments still hold about as many rows each."""
    ids = [*range(10**12, 10**12 + 4000), 1, 2, 3, 5 * 10**13]
    df = spark.createDataFrame([(i, "ab"[i % 2] if i % 9 else None, i % 4) for i in ids], "id long, source string, credits int").repartition(7)
    spent, want = {}, set()
    for i in sorted(ids):
        source = "ab"[i % 2] if i % 9 else None
        spent[source] = spent.get(source, 0) + i % 4
        want.add((i, source, spent[source]))
    for rows in (1 << 18, 250):
        got = stats.running_credits(df, segment_rows=rows)
        assert {(r.id, r.source, r.spent) for r in got.collect()} == want
    sizes = [r["count"] for r in df.repartitionByRange(17, "source", "id").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 14 and max(sizes) < 1000


def test_verify_in_one_shuffle(spark):
    docs = spark.createDataFrame([(1, "COMPLETED"), (2, "COMPLETED"), (3, "QUEUED"), (4, "COMPLETED")], "document_id long, status string")
    art = spark.createDataFrame([(1, "pdf", "x"), (2, "xml", "y"), (3, "pdf", "z"), (4, "pdf", "w"), (7, "pdf", "v")], "document_id long, kind string, sha256 string")
    files = spark.createDataFrame([(1, "pdf", "x"), (1, "json", "j"), (2, "xml", "other"), (4, "pdf", "w"), (9, "pdf", "q"), (None, "xml", "n")], "document_id long, kind string, sha256 string")
    out = audit.verify(docs, art, files)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [(2, "json", "missing sidecar"), (2, "pdf", "completed without pdf"), (2, "xml", "sha256 mismatch"), (3, "pdf", "missing file"), (4, "json", "missing sidecar"), (7, "pdf", "missing file"), (9, "pdf", "orphan"), (None, "xml", "orphan")], key=str
    )
    at = scratch(spark)
    for name, df in (("d", docs), ("a", art), ("f", files)):
        df.write.parquet(f"{at}/{name}")
    plan = audit.verify(*[spark.read.parquet(f"{at}/{n}") for n in "daf"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
