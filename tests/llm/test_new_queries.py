"""Whitening, periodic runs and chunked BPE: the registered queries against brute force on the smallest tables, and odd inputs."""

import base64
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from provengine.llm import chunked_bpe, periodic_runs, whitening
from provengine.llm.common import mix
from provengine.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


# --- whitening ---------------------------------------------------------------------------------


def whitened_by_hand(rows):
    """{(id, component): (n, deviation, whitened, explained)} with numpy's eigenvectors and Python's integers."""
    grid = [(i, [math.floor(64 * c) + 1000000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    each = sorted({tuple(x) for _, x in grid})
    n, sums = len(each), [sum(c) for c in zip(*each)]
    centred = np.array(each, dtype=float) - np.array(sums, dtype=float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    out = []
    for i, x in grid:
        apart = [n * c - s for c, s in zip(x, sums)]
        white = (np.array(apart, dtype=float) / n) @ vectors / np.sqrt(values)
        out.append((i, n, sum(c * c for c in apart), white, values / np.trace(centred.T @ centred / n)))
    return out


def test_whitening_query(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = {}
    for r in QUERIES["op11_whitening"](spark, SF).collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    want = whitened_by_hand(rows)
    assert len(got) == len(want) == len(rows)
    sign = np.sign([got[want[0][0]][k + 1].whitened * want[0][3][k] for k in range(16)])
    for i, n, deviation, white, explained in want:
        mine = [got[i][k + 1] for k in range(16)]
        assert all(r.n == n and r.deviation == deviation and r.identity_error <= 1e-9 for r in mine)
        assert np.allclose([r.whitened for r in mine], white * sign, rtol=1e-9, atol=1e-9)
        assert np.allclose([r.explained for r in mine], explained, rtol=1e-10)


def whiten(spark, rows, schema="id long, v array<double>, x string"):
    grid = whitening.on_grid(spark.createDataFrame(rows, schema), "v", "id")
    return whitening.whiten(grid, whitening.fit_whitening(grid)).collect()


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(c) for c in rng.normal(size=5) * [9, 5, 5, 2, 1]], "x") for i in range(40)]
    odd = [(90, None, None), (91, [], None), (92, [1.0, None, 2.0, 3.0, 4.0], None), (93, [math.nan] * 5, None), (94, [math.inf] * 5, None), (95, [1.0, 2.0], None)]
    again = [(None, good[0][1], None), (7, good[7][1], None)]
    got = whiten(spark, good + odd + again)
    want = whitened_by_hand([(i, v) for i, v, _ in good + again])
    assert len(got) == 5 * 42 and {r.n for r in got} == {40} and max(r.identity_error for r in got) < 1e-9
    assert sorted((r.id is None, r.id or 0, r.deviation) for r in got if r.component == 1) == sorted((i is None, i or 0, d) for i, _, d, _, _ in want)
    for k in range(5):
        mine = sorted(abs(r.whitened) for r in got if r.component == k + 1)
        assert np.allclose(mine, sorted(abs(w[3][k]) for w in want), atol=1e-9)


def test_whitening_degenerate(spark):
    assert whiten(spark, []) == [] and whiten(spark, [(1, None, None)]) == []
    assert whiten(spark, [(1, [1.0, 2.0], None), (2, [1.0, 2.0], None)]) == []  # one vector: no variance
    line = whiten(spark, [(i, [float(i), 2.0 * i, 0.0], None) for i in range(9)])  # one direction
    assert {r.component for r in line} == {1} and len(line) == 9 and abs(line[0].explained - 1) < 1e-12
    with pytest.raises(Exception, match="64 bits"):
        whiten(spark, [(1, [1e30], None), (2, [-1e30], None), (3, [0.0], None)])


@pytest.mark.parametrize("kind", range(5))
def test_leading_components(kind):
    rng = np.random.default_rng(kind)
    for n in (1, 2, 3, 8, 40):
        q = np.linalg.qr(rng.normal(size=(n, n)))[0]
        values = [rng.random(n) * 9 + 1, np.full(n, 3.0), 5 + 1e-10 * np.arange(n), np.arange(n) < 1, 2.0 ** -np.arange(n)][kind]
        matrix = (q * values) @ q.T
        matrix = (matrix + matrix.T) / 2
        got, vectors = whitening.leading_components(matrix, 16)
        want = np.linalg.eigvalsh(matrix)[::-1][:16]
        k = len(got)
        assert np.allclose(got, want[:k], atol=1e-13 * n) and (want[k:] < 1e-13 * n).all()
        assert np.abs(vectors @ vectors.T - np.eye(k)).max() < 1e-11 and np.abs(matrix @ vectors.T - vectors.T * got).max() < 1e-12 * n * values.max() + 1e-13


# --- periodic runs -----------------------------------------------------------------------------


def runs_by_hand(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] == w[i + q]:
                s = i
                while i + q < len(w) and w[i] == w[i + q]:
                    i += 1
                if i + q - s >= 2 * q:
                    found.setdefault((s, i + q), q)
            i += 1
    return sorted(((s, e, q) for (s, e), q in found.items() if e - s >= max(least, 2 * q)), key=lambda r: (r[0], r[2]))


def words_of(text):
    import re

    return re.findall("[^\x20\x09-\x0d]+", text or "")


def kept(w, runs):
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_query(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op12_runs"](spark, SF).collect()}
    assert set(got) == set(texts)
    planted = 0
    for d, t in texts.items():
        w, h = words_of(t), zlib.crc32(str(d).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = runs_by_hand(w) if n < 3000 or h % 10 == 0 else None
        if runs is None:
            continue
        r = got[d]
        planted += bool(runs)
        best = min(runs, key=lambda x: (x[0] - x[1], x[0], x[2]), default=None)
        assert r.n_runs == len(runs) and r.runs_sha256 == sha("".join(f"{s},{e - s},{q}\n" for s, e, q in runs))
        assert (r.start, r.length, r.period, r.exponent_milli) == ((best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4)
        assert r.collapsed_sha256 == sha(kept(w, runs))
    assert planted > 10


def sequences(seed, count):
    rnd = random.Random(seed)
    for _ in range(count):
        kind, n = rnd.randint(0, 5), rnd.choice([0, 1, 2, 5, 13, 40, 80, 150])
        out = []
        if kind == 0:
            out = [1] * n
        elif kind == 1:
            out = [rnd.randint(1, 2) for _ in range(n)]
        elif kind == 2:
            out = [rnd.randint(1, 3) for _ in range(rnd.randint(1, 20))] * 150
        elif kind == 3:
            while len(out) < n:
                out += [rnd.randint(1, 4) for _ in range(rnd.randint(1, 9))] * rnd.randint(1, 6)
        elif kind == 4:
            before, out = [1], [1, 2]
            while len(out) < n:
                before, out = out, out + before
        else:
            out = [bin(i).count("1") % 2 for i in range(n)]
        yield out[:n]


@pytest.mark.parametrize("seed", range(4))
def test_runs_appended_in_parts(seed):
    rnd, rows = random.Random(seed), list(sequences(seed, 120))
    while rows:
        some, rows = rows[: rnd.randint(1, 6)], rows[6:]
        names = mix(np.array([x for w in some for x in w], dtype=np.uint64) + np.uint64(7))
        counts = np.array([len(w) for w in some], dtype=np.int64)
        base = np.concatenate([[0], np.cumsum(counts)])
        least = rnd.choice([2, 12])
        want = [(s + b, e + b, q) for b, w in zip(base.tolist(), some) for s, e, q in runs_by_hand(w, least)]
        for part in (1 << 20, rnd.randint(1, 50), 1 if len(names) < 200 else 7):
            assert [tuple(r) for r in periodic_runs.runs_of_texts(names, counts, least, part).tolist()] == want


def test_runs_of_bit_parities():
    """The sequence of bit parities is known to hold squares but nothing longer; a repeat of it is one run."""
    w = np.array([bin(i).count("1") % 2 for i in range(1 << 13)], dtype=np.uint64)
    names = mix(w + np.uint64(5))
    runs = periodic_runs.runs_of_texts(names, np.array([len(w)]), 12)
    assert len(runs) and (runs[:, 1] - runs[:, 0] == 2 * runs[:, 2]).all()
    twice = np.concatenate([names[:5000], names[:5000]])
    assert [0, 10000, 5000] in periodic_runs.runs_of_texts(twice, np.array([10000]), 12).tolist()


def test_runs_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, " x " * 30, None), (3, "a b " * 9000, "b"), (3, "a b " * 9000, "b"), (4, "\tone\n two ", None), (5, "ä " * 11 + "é", None)]
    got = periodic_runs.find_runs(spark.createDataFrame(rows, "doc_id long, text string, id string")).collect()
    seen = sorted(((r.id or 0), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got)
    assert seen == [
        (0, 30, [(0, 30, 1)], "x"),
        (1, 0, [], ""),
        (2, 0, [], ""),
        (3, 18000, [(0, 18000, 2)], "a b"),
        (3, 18000, [(0, 18000, 2)], "a b"),
        (4, 2, [], "one two"),
        (5, 12, [], " ".join(["ä"] * 11 + ["é"])),
    ]
    empty = periodic_runs.find_runs(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.collect() == [] and empty.columns == ["id", "n_words", "runs", "collapsed"]


# --- chunked BPE -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_query(spark, texts, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op13_chunked_bpe"](spark, SF).collect()}
    want = {}
    for d, t in texts.items():
        ids = library[2].encode_ordinary(t or "")
        want[d] = len(ids), sha(",".join(map(str, ids))), sha(t or "")
    assert got == want


@pytest.mark.parametrize(("chunk", "overlap"), [(7, 3), (16, 5), (50, 20)])
def test_bpe_chunks(spark, library, chunk, overlap):
    path, pattern, whole = library
    rnd = random.Random(chunk)
    bits = ["a", "don't", "we're", "'", "'r", "l", " ", "  ", "\n", "\n\n ", "é", "漢字", "12", "😀", "...", " ", "x" * 30, " " * 30, "I'll", "\t"]
    rows = [(k, "".join(rnd.choices(bits, k=rnd.randint(0, 60))), "c") for k in range(150)]
    rows += [(150, None, None), (151, "", None), (None, "it's " * 40, None), (152, "y" * 500, None), (152, "y" * 500, None), (153, " " * 200 + "z", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = chunked_bpe.decode(chunked_bpe.encode(df, path, pattern, chunk, overlap), path).collect()
    assert sorted((r.id or 0, r.ids, bytes(r.decoded)) for r in got) == sorted((i or 0, whole.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows)


def test_bpe_empty(spark, library):
    path, pattern, _ = library
    df = spark.createDataFrame([], "doc_id string, text string")
    assert chunked_bpe.decode(chunked_bpe.encode(df, path, pattern), path).collect() == []
    with pytest.raises(ValueError, match="overlap"):
        chunked_bpe.encode(df, path, pattern, 10, 10)
    lost = spark.range(1).select(F.lit(None).cast("array<int>").alias("ids"))
    assert chunked_bpe.decode(lost, path).first().decoded is None
