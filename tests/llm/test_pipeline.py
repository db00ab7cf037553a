"""The pipeline: each stage against what it must keep."""

import re
from collections import Counter

import corpus_pipeline
from provengine.llm import mixing
from provengine.llm.common import stash
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def words(t, pattern="[^\x20\x09-\x0d]+"):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        taken = {r.row_key: r for r in mixing.mix_sources(docs).collect()} if name == "mixing" else {}
        docs = stash(stage(spark, docs, SF))
        assert docs.columns == columns
        rows = docs.collect()
        assert all(before[r.doc_id] == r for r in rows)
        kept[name] = Counter(r.doc_id for r in rows)
        assert name == "mixing" or max(kept[name].values()) == 1
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    wrong = sum((d in kept["quality"]) != bool(q) for d, q in labels.items())
    assert wrong <= 0.05 * len(labels)

    sets = {}
    for d in kept["quality"]:
        w = words(before[d].text)
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    up = {d: d for d in sets}
    root = lambda x: x if up[x] == x else root(up[x])
    every = sorted(sets)
    for i, a in enumerate(every):
        for b in every[:i]:
            if near(a, b):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    assert set(kept["near duplicates"]) == {root(d) for d in sets}  # the least id of each component

    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text, "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    clean = set()
    for d in kept["near duplicates"]:
        w = words(before[d].text, "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
        if not any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1)):
            clean.add(d)
    assert set(kept["decontamination"]) == clean

    want = {r.doc_id: int(r.taken / r["size"] + 0.5) for r in taken.values() if r["size"]}
    assert kept["mixing"] == Counter({d: n for d, n in want.items() if n}) and max(kept["mixing"].values()) <= 3
    emitted, target, largest = Counter(), {}, Counter()
    for r in taken.values():
        emitted[r.source] += r["size"] * kept["mixing"][r.doc_id]
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r["size"])
    total = sum(target.values())
    for s, t in target.items():  # documents are whole: near the target up to a few of them
        assert abs(emitted[s] - t) <= max(0.05 * total, 3 * largest[s])

    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert Counter(r.doc_id for r in out.collect()) == kept["mixing"]
    again = corpus_pipeline.run(spark, SF)
    assert again.columns == out.columns and Counter(map(tuple, again.collect())) == Counter(map(tuple, out.collect()))


def test_clashing_columns(spark):
    """Stages keep all columns, whatever their names."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    clash = ["quality_score", "__row_key", "__row_key_copies", "row_key", "node", "label", "component", "taken", "size", "copies", "words", "place", "part", "doc"]
    for k, name in enumerate(clash):
        docs = docs.withColumn(name, F.concat(F.lit(f"{k}-"), F.col("doc_id").cast("string")))
    docs = stash(docs)
    before = {tuple(r) for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stash(stage(spark, docs, SF))
        rows = docs.collect()
        assert docs.columns[5:] == clash and rows and {tuple(r) for r in rows} <= before
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows)


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_null_and_repeated_rows(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(None, text, "en", "s", 1), (None, "other words stand here for once", "en", None, 1), (4, text, "en", "s", 1), (4, text, "en", "s", 1), (5, None, "en", "s", 0), (5, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    one = corpus_pipeline.keep_one_of_each_group(spark, docs, SF)
    assert Counter((r.doc_id, r.text) for r in one.collect()) == Counter([(4, text), (None, rows[1][1]), (5, None), (5, "")])
    assert corpus_pipeline.mix(spark, docs, SF).columns == docs.columns
    assert corpus_pipeline.keep_good(spark, docs.limit(0), SF).count() == 0
