"""The registered queries of the subpackage over the smallest tables: against DuckDB where SQL can express them, else against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from provengine.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def plain(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == names
    place = [columns.index(n) for n in names]
    assert Counter(tuple(map(plain, r)) for r in got.select(names).collect()) == Counter(tuple(plain(r[i]) for i in place) for r in want.fetchall())


def test_sharding(spark, texts):
    got = QUERIES["op1_sharding"](spark, SF).collect()
    raw = {d: (t or "").encode() for d, t in texts.items()}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in got} == {d: (len(b) + 8, zlib.crc32(b)) for d, b in raw.items()} and len(got) == len(raw)
    ordered = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert ordered == sorted(raw) and {r.shard for r in got} <= set(range(24))
    total = sum(r["size"] for r in got)
    for s in range(24):
        own = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 24) <= max(r["size"] for r in got)


def test_quality(spark, texts):
    got = QUERIES["op4_quality"](spark, SF).collect()
    assert {r.doc_id for r in got} == set(texts) and all(r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [r for r in got if r.held_out and r.doc_id in quality]
    assert np.mean([r.predicted == quality[r.doc_id] for r in held]) >= 0.95


def test_exact_substrings(spark, texts):
    raw = {d: (t or "").encode() for d, t in texts.items()}
    seen = Counter(hash(b[i : i + 400]) for b in raw.values() for i in range(len(b) - 399))
    got = {r.doc_id: r for r in QUERIES["op6_exact_substrings"](spark, SF).collect()}
    for d, b in raw.items():
        gone = np.zeros(len(b) + 1, dtype=int)
        for i in range(len(b) - 399):
            if seen[hash(b[i : i + 400])] > 1:
                gone[i], gone[i + 400] = gone[i] + 1, gone[i + 400] - 1
        gone = np.cumsum(gone)[:-1] > 0
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(b, dtype=np.uint8)[~gone])
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    assert len(got) == len(raw)


def test_exact_substrings_short_passages(spark, tmp_path):
    """A repeated passage of just over 50 words has less than 400 bytes: it is found, and nothing is removed."""
    rng = np.random.default_rng(4)
    make = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, rng.integers(2, 8)))) for _ in range(n))
    rows, want = [], {}
    for k in range(60):
        n = 51 + k % 10
        passage = make(n)
        assert len(passage) < 400
        for _ in range(2):
            want[len(rows)] = n
            rows.append((len(rows), f"{make(k)} {passage}\n{make(90 - k)}"))
        want[len(rows)] = 0
        rows.append((len(rows), make(150)))
        shared = make(50)  # one word too few
        for _ in range(2):
            want[len(rows)] = 0
            rows.append((len(rows), f"{make(20)} {shared} {make(20)}"))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op6_exact_substrings"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.repeated_words for r in got} == want and len(got) == len(rows)
    assert not any(r.n_removed or r.repeats for r in got)


def test_tokens(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op7_tokens"](spark, SF).collect()}
    want, start = {}, 0
    for d in sorted(texts):
        ids = [*library.encode(texts[d] or "", add_special_tokens=False).ids, 2]
        want[d] = start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)
    assert got == want


def test_fuzzy_substrings(spark, texts):
    got = QUERIES["op8_fuzzy_substrings"](spark, SF).collect()
    words = {d: re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for d, t in texts.items()}
    pairs, holders = set(), {}
    for r in got:
        a, b = words[r.doc_id][r.start : r.end], words[r.ref_doc_id][r.ref_start : r.ref_end]
        assert r.ref_doc_id != r.doc_id and r.n_columns >= 50 and r.n_equal >= 0.8 * r.n_columns
        assert max(len(a), len(b)) <= r.n_columns <= len(a) + len(b) - r.n_equal and r.n_equal <= longest_common(a, b)
        pairs.add((r.doc_id, r.ref_doc_id))
    for d, w in words.items():
        for i in range(len(w) - 49):
            holders.setdefault(tuple(w[i : i + 50]), set()).add(d)
    spans = [(r.doc_id, r.start, r.end, r.ref_doc_id, r.ref_start, r.ref_end, r.n_columns, r.n_equal) for r in got]
    assert sorted(spans) == sorted((*s[3:6], *s[:3], *s[6:]) for s in spans)  # each passage from both of its documents
    up = {d: d for d in words}
    root = lambda x: x if up[x] == x else root(up[x])
    for a, b in pairs:
        up[root(a)] = root(b)
    shared = [h for h in holders.values() if len(h) > 1]
    assert shared and all(len({root(d) for d in h}) == 1 for h in shared)  # every exact run of 50 words is linked


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_media(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op10_media"](spark, SF).collect()}
    assert set(got) == set(texts)
    for d, t in texts.items():
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64) if b else bytes(64)
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
