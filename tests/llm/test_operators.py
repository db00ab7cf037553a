"""The operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from provengine.llm import chat, decontamination, exact_substrings, fuzzy_substrings, jaccard, media, mixing, quality, sharding, tokens

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASH = ", shard int, node long, size string, part string, token string, row_key string, before int, words string, block int, label string"


def _texts() -> list:
    rng = random.Random(5)
    vocab = ["w%d" % k for k in range(400)] + ["été", "Ñandú", "THE", "don't", "x" * 60]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, passage = make(300), make(120)
    near = base.split()
    near[40], near[200] = "changed", "edited"
    out = [None, "", "  \n\t ", "one", "one two three", "One  two\nTHREE", "a b c d e", base, base, base.upper(), " ".join(near), make(80) + " " + passage + " " + make(50), make(30) + "\n" + passage, make(4000)]
    out += [make(rng.randint(1, 90)) for _ in range(40)]
    out += ["=" * 900, "ab" * 500, "a" * 399, "a" * 400, "%%%\n" * 300, "\x00\x1f\x85  x y", "<|end|>\\<|", "</s>[INST] ok [/INST]", "tail\n\n", "<|endoftext|> it's 12  \n x"]
    return out


TEXTS = _texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, ["a", "b", "b", None, "é"][k % 5]) for k, t in enumerate(TEXTS)]
    rows += [(None, "null id text here now ok", "a"), (None, TEXTS[7], "b"), (7, TEXTS[7], "c"), (12, "repeated id, other text", "c")]
    return spark.createDataFrame([(*r, *[None] * 10) for r in rows], "doc_id long, text string, source string" + CLASH).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def rows_of(docs):
    return [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]


def utf8(t) -> bytes:
    return (t or "").encode()


def test_sharding(docs, empty):
    assert sharding.shard_by_bytes(empty).count() == 0
    got = sharding.shard_by_bytes(docs, 5).collect()
    want = Counter((d, len(utf8(t)) + 8, zlib.crc32(utf8(t))) for d, t, _ in rows_of(docs))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    ordered = sorted(got, key=lambda r: (r.shard, r.slot))
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.text_crc32, r["size"])
    assert [key(r) for r in ordered] == sorted(map(key, got))
    total, most = sum(r["size"] for r in got), max(r["size"] for r in got)
    for s in range(5):
        own = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 5) <= most


def word_list(t, pattern="[^\x20\x09-\x0d]+"):
    return re.findall(pattern, (t or "").translate(LOW))


def fill(sizes: dict, weights=(1, 2, 3), most=3) -> dict:
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
            open_.discard(s)
    return target


def test_mixing(docs, empty):
    assert mixing.mix_sources(empty).count() == 0
    got = mixing.mix_sources(docs).collect()
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((d, s, len(word_list(t))) for d, t, s in rows_of(docs))
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    for r in got:
        assert r.taken == sum((r.shard_taken or {}).values()) and r.quota == sum(r.shard_quotas)
    for s, want in fill(sizes).items():
        assert all(r.target == pytest.approx(want) for r in got if r.source == s)
        assert abs(taken[s] - want) <= max(5, 0.01 * want)
        own = [r for r in got if r.source == s]
        for k, quota in enumerate(own[0].shard_quotas):  # a block is of one word here; each shard takes its own quota
            assert sum((r.shard_taken or {}).get(k, 0) for r in own) == quota
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs.repartition(7)).collect()))


@pytest.mark.parametrize("most_pieces", [7, 4096])
def test_mixing_reaches_small_sources_beside_large_ones(spark, most_pieces):
    """Sources of 435, 954 and 66,833 words, and one of three: each comes within a few words of its target, however few pieces there are."""
    rng, rows = random.Random(1), []
    for source, words in (("a", 435), ("b", 954), ("c", 66_833), ("d", 3)):
        while words:
            n = min(words, rng.randint(1, 90))
            rows.append((len(rows), " ".join(["w"] * n), source))
            words -= n
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), most_pieces=most_pieces).collect()
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    targets = {r.source: r.target for r in got}
    assert targets["a"] == 1305 and targets["d"] == 9
    assert all(abs(taken[s] - targets[s]) <= 2 for s in targets)


def highest_quotients(targets: dict, most: dict, house: int) -> list:
    """The sources in the order in which they win seats."""
    seats, history = Counter(), []
    for _ in range(house):
        best = max((s for s in targets if seats[s] < most[s]), key=lambda s: (targets[s] / (2 * seats[s] + 1), -s))
        seats[best] += 1
        history.append(best)
    return history


@pytest.mark.parametrize("most", [{1: 99, 2: 99, 3: 99, 4: 99}, {1: 3, 2: 99, 3: 1, 4: 0}])
def test_sainte_lague_is_by_highest_quotients(spark, most):
    targets = {1: 53.0, 2: 24.0, 3: 23.0, 4: 0.0}
    df = spark.createDataFrame([(k, v, most[k], 10) for k, v in targets.items()], "source_rank int, target double, most_seats long, all_blocks long")
    got = {(r.source_rank, r.shard): r.quota for r in mixing.sainte_lague(df, "all_blocks", 5).collect()}
    history = highest_quotients(targets, most, 10)
    rng = random.Random(3)
    many = {k: rng.choice([0.5, 1.0, 3.0, 40.0, 900.0]) * rng.random() for k in range(1, 41)}
    df = spark.createDataFrame([(k, v, 60, 300) for k, v in many.items()], "source_rank int, target double, most_seats long, all_blocks long")
    own = {r.source_rank: r.seats for r in mixing.sainte_lague(df, "all_blocks", 2).where("shard = 1").collect()}
    assert own == {k: Counter(highest_quotients(many, dict.fromkeys(many, 60), 300))[k] for k in many}
    for shard in range(5):
        part = Counter(history[2 * shard : 2 * shard + 2])
        assert {s: got[s, shard] for s in targets} == {s: part[s] for s in targets}


def test_decontamination(spark, docs, empty):
    rng = random.Random(1)
    items = [(1, TEXTS[11][400:700]), (2, "one TWO three"), (3, ""), (4, None), (5, " ".join(TEXTS[13].split()[100:130])), (6, "nowhere to be found at all"), (7, "ab"), (1, " ".join(rng.sample(TEXTS[7].split(), 12)))]
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, n_words int")
    got = decontamination.find_contamination(docs, bench).collect()
    pattern = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    windows = defaultdict(set)
    for i, t in items:
        w = word_list(t, pattern)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[s : s + n])].add(str(i))
    want = Counter()
    for d, t, _ in rows_of(docs):
        w, hit, own = word_list(t, pattern), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    own |= windows[tuple(w[s : s + n])]
        want[d, len(w), len(hit), ",".join(sorted(own)), bool(hit)] += 1
    assert Counter((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in got) == want
    assert sum(k[4] for k in want) >= 3
    assert decontamination.find_contamination(empty, bench).count() == 0
    assert not any(r.contaminated for r in decontamination.find_contamination(docs, bench.limit(0)).collect())


def shingles(t, k=5):
    w = word_list(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize("tile", [4_000_000, 300])
def test_jaccard(docs, empty, tile):
    got = jaccard.near_duplicates(docs, tile_tokens=tile).collect()
    rows = [(d, shingles(t)) for d, t, _ in rows_of(docs)]
    up = list(range(len(rows)))
    root = lambda x: x if up[x] == x else root(up[x])
    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    want = Counter((d, len(a), least.get(root(i)) if a else d) for i, (d, a) in enumerate(rows))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert jaccard.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("tile", [4_000_000, 250])
def test_jaccard_header_makes_no_block(spark, tile):
    """Otherwise unrelated texts that begin with the same 30 words share no block; real near copies with that header are still found."""
    rng = random.Random(8)
    header = " ".join(f"licence{k}" for k in range(30))
    body = lambda: " ".join(f"w{rng.randint(0, 10**9)}" for _ in range(70))
    texts = [f"{header} {body()}" for _ in range(1500)]
    texts += [t + " more" for t in texts[:5]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = df.withColumn("row_key", F.col("doc_id"))
    counted = jaccard._nodes(docs, 5, 1024).cache()
    nodes = counted.where("node IS NOT NULL").select("node", "n").distinct()
    fullness = jaccard._fullness(counted.where("n < 0").select("counts"))
    members = jaccard._members(jaccard._prefixes(docs, 5, 80, fullness), nodes)
    assert members.groupBy("block").count().agg(F.max("count")).first()[0] <= 4
    got = jaccard.near_duplicates(df, tile_tokens=tile).where("n_links > 0").collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(d, d % 1500) for d in [*range(5), *range(1500, 1505)]}


@pytest.mark.parametrize("tile", [4_000_000, 250])
def test_jaccard_counts_every_link(spark, tile):
    base = [f"w{i}" for i in range(100)]
    rows = [(0, " ".join(base)), (1, " ".join(base)), (None, " ".join(base).upper())]
    rows += [(10 + m, " ".join(base[m : 100 + m] + [f"t{m}_{i}" for i in range(m % 3)])) for m in range(1, 9)]  # a clique, nearly
    rows += [(30 + m, " ".join(f"c{i}" for i in range(15 * m, 15 * m + 150))) for m in range(6)]  # a chain
    rows += [(50, ""), (51, None), (52, "alone here")]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), tile_tokens=tile).collect()
    sets = [shingles(t) for _, t in rows]
    want = Counter((d, sum(1 for j, b in enumerate(sets) if j != i and a and b and 100 * len(a & b) >= 80 * len(a | b))) for i, ((d, _), a) in enumerate(zip(rows, sets)))
    assert sorted(want.elements(), key=str) == sorted(((r.doc_id, r.n_links) for r in got), key=str)
    assert want[0, 10] == 1 and want[30, 1] == 1 and want[31, 2] == 1 and want[50, 0] == 1


def test_rtree_finds_every_pair():
    rng = np.random.default_rng(3)
    points = rng.poisson(3, (200, 128)).astype(np.uint8)
    points[100:150] = points[:50] + (rng.random((50, 128)) < 0.05)
    sizes = points.sum(axis=1).astype(int)
    got = {tuple(sorted((int(a), int(b)))) for i, j in jaccard.RTree(points, sizes).self_join(80) for a, b in zip(i, j)}
    want = set()
    for i in range(200):
        for j in range(i + 1, 200):
            bound = int(np.minimum(points[i], points[j]).sum())
            if bound * 180 >= 80 * (sizes[i] + sizes[j]) and 100 * min(sizes[i], sizes[j]) >= 80 * max(sizes[i], sizes[j]):
                want.add((i, j))
    assert got == want and len(want) >= 40


def test_chat(spark):
    rows = [(1, 0, "user", "hi <|end|> \\"), (1, 1, "assistant", "<|turn|>\\\\<"), (1, 1, "assistant", None), (2, 5, "system", "s"), (2, 3, None, "|>"), (3, 0, "assistant", ""), (4, None, "user", "x" * 100_000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, depth int, branch int")
    got = {r.conv_id: (r.roles, r.texts, r.loss_text) for r in chat.read_back(chat.format_reply_trees(chat.turns_as_tree(df))).collect()}
    want = {
        1: (["user", "assistant", "assistant"], ["hi <|end|> \\", "", "<|turn|>\\\\<"], "<|turn|>\\\\<"), 2: (["", "system"], ["|>", "s"], ""), 3: (["assistant"], [""], ""), 4: (["user"], ["x" * 100_000], ""),
    }
    assert got == want
    assert chat.format_reply_trees(chat.turns_as_tree(df.limit(0))).count() == 0


def test_reply_trees(spark):
    nodes = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", 1.0), ("t", 3, 1, "assistant", "good", 5.0), ("t", 4, 3, "user", "more", None), ("t", 5, 4, "assistant", "end", 9.0), ("t", 6, 99, "user", "orphan", 0.0), ("u", 1, 2, "user", "loop", 1.0), ("u", 2, 1, "user", "loop", 1.0)]
    df = spark.createDataFrame(nodes, "tree_id string, node_id long, parent_id long, role string, text string, score double")
    got = {(r.conv_id, r.branch): r.texts for r in chat.read_back(chat.format_reply_trees(df, branches=3)).collect()}
    assert got == {("t", 1): ["q", "good", "more", "end"], ("t", 2): ["q", "bad"], ("t", 3): ["orphan"]}


def test_chat_with_null_ids(spark):
    rows = [(None, 0, "user", "hi"), (None, 1, "assistant", "yes"), (1, None, "user", "a"), (1, 2, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.texts, r.loss_text) for r in chat.read_back(chat.format_reply_trees(chat.turns_as_tree(df))).collect()}
    assert got == {None: (["hi", "yes"], "yes"), 1: (["a", "b"], "b")}
    nodes = [(None, 1, None, "user", "q", 0.0), (None, 2, 1, "assistant", "a", 2.0), ("t", None, None, "user", "no id", 0.0), ("t", 1, None, "user", "root", 1.0), ("t", 2, 1, "user", "leaf", 1.0)]
    df = spark.createDataFrame(nodes, "tree_id string, node_id long, parent_id long, role string, text string, score double")
    got = {(r.conv_id, r.branch, r.leaf_id): r.texts for r in chat.read_back(chat.format_reply_trees(df, branches=3)).collect()}
    assert got == {(None, 1, 2): ["q", "a"], ("t", 1, 2): ["root", "leaf"], ("t", 2, None): ["no id"]}
    assert {(r.tree_id, r.leaf_id, r.node_id, r.depth) for r in chat.chosen_paths(df).collect()} == {(None, 2, 1, 0), (None, 2, 2, 1), ("t", 2, 1, 0), ("t", 2, 2, 1)}


def test_exact_substrings(docs, empty):
    size = 400
    rows = rows_of(docs)
    seen = Counter(utf8(t)[i : i + size] for _, t, _ in rows for i in range(len(utf8(t)) - size + 1))
    want = Counter()
    for d, t, _ in rows:
        b = utf8(t)
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()] += 1
    got = exact_substrings.remove_repeats(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert exact_substrings.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("size", [2, 5, 51])
def test_exact_passages(docs, empty, size):
    rows = [(d, re.findall(rb"[^\x20\x09-\x0d]+", utf8(t))) for d, t, _ in rows_of(docs)]
    seen = Counter(tuple(w[i : i + size]) for _, w in rows for i in range(len(w) - size + 1))
    want = Counter((d, len({k for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for k in range(i, i + size)})) for d, w in rows)
    got = exact_substrings.remove_repeats(docs, passage=size).collect()
    assert Counter((r.doc_id, r.repeated_words) for r in got) == want and max(want.values()) and max(n for _, n in want)
    plain = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(tuple(r[c] for c in plain) for r in got) == Counter(map(tuple, exact_substrings.remove_repeats(docs).select(*plain).collect()))
    assert exact_substrings.remove_repeats(empty, passage=size).count() == 0


def test_fuzzy_substrings(docs, empty):
    got = fuzzy_substrings.shared_passages(docs).collect()
    words = defaultdict(list)
    for d, t, _ in rows_of(docs):
        if d is not None:
            words[d].append(word_list(t))
    owners = defaultdict(set)
    for d, all_ in words.items():
        for w in all_:
            for i in range(len(w) - 49):
                owners[tuple(w[i : i + 50])].add(d)
    must = {d for own in owners.values() if len(own) > 1 for d in own}
    found = {r.doc_id for r in got} | {r.ref_doc_id for r in got}
    assert must and must <= found
    assert found - must <= {k for k, t in enumerate(TEXTS) if len(set(word_list(t))) > 40}
    for r in got:
        assert r.ref_doc_id < r.doc_id and r.n_equal >= 0.8 * r.n_columns and r.n_columns >= 50
    assert fuzzy_substrings.shared_passages(empty).count() == 0


def test_fuzzy_passages_of_one_chain(spark):
    rng = random.Random(11)
    make = lambda n: ["v%d" % rng.randrange(10**6) for _ in range(n)]
    text, head, foot = make(300), make(60), make(60)
    rows = [(1, text), (2, text[:150] + make(150) + text[150:]), (3, head + make(250) + foot), (4, head + make(240) + foot)]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    got = sorted((r.doc_id, r.ref_doc_id, r.start, r.end, r.ref_start, r.ref_end, r.n_columns, r.n_equal) for r in fuzzy_substrings.shared_passages(df).collect())
    assert got == [(2, 1, 0, 150, 0, 150, 150, 150), (2, 1, 300, 450, 150, 300, 150, 150), (4, 3, 0, 60, 0, 60, 60, 60), (4, 3, 300, 360, 310, 370, 60, 60)]


def scattered(rng):
    """Two texts with the same 80 words, each 20 of which stand in an earlier text too, many times over."""
    make = lambda n: ["v%d" % rng.randrange(10**6) for _ in range(n)]
    passage = make(80)
    rows = [(k, make(100) + passage[5 * k % 61 : 5 * k % 61 + 20] + make(100)) for k in range(16)]
    rows += [(20, make(90) + passage + make(70)), (21, make(40) + passage + make(120))]
    return [(d, " ".join(w)) for d, w in rows]


@pytest.mark.parametrize("seed", range(3))
def test_fuzzy_exact_passage_among_its_parts(spark, seed):
    """Two texts share 60 words; 90 others hold 35 of those in a row each, ten at each of nine places."""
    rng = random.Random(seed)
    make = lambda n: ["v%d" % rng.randrange(10**6) for _ in range(n)]
    passage = make(60)
    texts = [make(40) + passage + make(40) for _ in range(2)] + [make(40) + passage[3 * k : 3 * k + 35] + make(40) for k in range(9) for _ in range(10)]
    rng.shuffle(texts)
    held = [k for k, t in enumerate(texts) if t[40:100] == passage]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = fuzzy_substrings.shared_passages(df).collect()
    assert [(r.doc_id, r.ref_doc_id, r.start, r.end, r.n_equal) for r in got if {r.doc_id, r.ref_doc_id} == set(held)] == [(held[1], held[0], 40, 100, 60)]


def test_fuzzy_passage_of_scattered_seeds(spark):
    rows = scattered(random.Random(12))
    got = [(r.doc_id, r.ref_doc_id, r.start, r.end, r.ref_start, r.ref_end, r.n_equal) for r in fuzzy_substrings.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert got == [(21, 20, 40, 120, 90, 170, 80)]


def brute_passages(a: list, b: list, share: float = 0.8, least: int = 50) -> bool:
    """Is there a stretch along a diagonal (substitutions alone) of `least` words or more with `share` equal?"""
    for shift in range(-len(b) + least, len(a) - least + 1):
        x, y = max(shift, 0), max(-shift, 0)
        hit = np.array([p == q for p, q in zip(a[x:], b[y:])], dtype=float)
        if len(hit) >= least and hit.sum() >= share * least:
            total = np.concatenate([[0], np.cumsum(hit - share)])
            if (total[least:] - np.minimum.accumulate(total)[: len(total) - least] >= -1e-9).any():
                return True
    return False


@pytest.mark.parametrize(("identity", "recall"), [(1.0, 1.0), (0.95, 0.97), (0.9, 0.9), (0.85, 0.65)])
def test_fuzzy_recall(spark, identity, recall):
    """Passages of 60 to 120 words with words replaced, against every diagonal of the two texts."""
    rng = random.Random(int(identity * 100))
    make = lambda n: ["v%d" % rng.randrange(10**6) for _ in range(n)]
    rows, want = [], set()
    for k in range(60):
        n = rng.choice([60, 80, 120])
        passage = make(n)
        changed = passage.copy()
        for at in rng.sample(range(n), round(n * (1 - identity))):
            changed[at] = make(1)[0]
        a, b = make(rng.randrange(80)) + passage + make(50), make(rng.randrange(80)) + changed + make(50)
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        if brute_passages(b, a):
            want.add((2 * k + 1, 2 * k))
    got = fuzzy_substrings.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {(r.doc_id, r.ref_doc_id) for r in got}
    assert len(want) >= 55 and len(found & want) >= recall * len(want) and all(d == r + 1 for d, r in found)
    texts = dict(rows)
    for r in got:  # each reported span against the texts
        a, b = texts[r.doc_id].split()[r.start : r.end], texts[r.ref_doc_id].split()[r.ref_start : r.ref_end]
        assert len(a) == len(b) == r.n_columns and sum(x == y for x, y in zip(a, b)) == r.n_equal


@pytest.mark.parametrize("most", [200_000, 7])
def test_met_is_the_same_in_any_chunks(spark, most):
    rng = np.random.default_rng(2)
    rows = sorted({(int(s), int(c), int(n), int(p)) for s, c, n, p in zip(rng.integers(0, 6, 80), rng.integers(0, 3, 80), rng.integers(0, 9, 80), rng.integers(0, 50, 80))} | {(9, 0, n, 1) for n in range(30)})
    df = spark.createDataFrame(rows, "seed long, ahead long, node long, place int").withColumns({c: F.lit(0).cast("long") for c in ("ahead2", "ahead3")})
    order = ["seed", *fuzzy_substrings.CONTEXT, "node", "place"]
    df = df.select(order)
    dealt = fuzzy_substrings.stash(fuzzy_substrings._matches(df.repartitionByRange(3, *order).sortWithinPartitions(*order), most))
    cross = fuzzy_substrings._across(dealt).collect()
    got = {(r.node, r.place, r.other, r.other_place) for r in dealt.where("rim = 0").collect() + cross}
    seeds = defaultdict(set)
    for s, _, n, p in rows:
        seeds[n, p].add(s)
    assert all(a < b and seeds[a, p] & seeds[b, q] for a, p, b, q in got)
    links = defaultdict(set)  # by seed, all nodes hang together
    for a, p, b, q in got:
        for s in seeds[a, p] & seeds[b, q]:
            links[s].add((a, b))
    for s in {r[0] for r in rows}:
        group, nodes = {min(r[2] for r in rows if r[0] == s)}, {r[2] for r in rows if r[0] == s}
        for _ in nodes:
            group |= {x for pair in links[s] if set(pair) & group for x in pair}
        assert group == nodes


def test_minimizers_by_stretches():
    codes = np.random.default_rng(7).integers(0, 1 << 62, 5000).astype(np.uint64)
    for a, b in zip(fuzzy_substrings.minimizers(codes, 5, 12), fuzzy_substrings.minimizers(codes, 5, 12, 300)):
        assert (a == b).all()


def test_fuzzy_alignment_is_exact():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 30)), rng.integers(0, 4, rng.integers(1, 30))
        want = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row = [i + 1]
            for j, y in enumerate(b):
                row.append(min(want[j] + int(x != y), want[j + 1] + 1, row[j] + 1))
            want = row
        got = fuzzy_substrings._edits(a, b)
        assert got[:, 0].sum() == len(a) and got[:, 1].sum() == len(b) and (got[:, 2] == 0).sum() == want[-1]
    hit = np.array([True] * 60 + [False] * 200 + [True] * 55 + [False] * 30)
    assert fuzzy_substrings.stretches(hit, 50, 0.8) == [(0, 60), (260, 315)]


def test_fuzzy_query_names_both_holders(spark, tmp_path):
    """Passages of 51 to 80 words, planted in two texts each, and texts that hold none."""
    from provengine.llm.queries import QUERIES

    rng = random.Random(17)
    make = lambda n: ["v%d" % rng.randrange(10**6) for _ in range(n)]
    rows = [(100 + k, make(rng.randrange(60, 200))) for k in range(40)]
    for k in range(20):
        passage = make(rng.randrange(51, 81))
        rows += [(2 * k + side, make(rng.randrange(70)) + passage + make(60)) for side in (0, 1)]
    spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op8_fuzzy_substrings"](spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(range(40)) and all(r.doc_id // 2 == r.ref_doc_id // 2 for r in got)


def test_fuzzy_alignment_along_a_diagonal():
    """A chain on one diagonal is its words side by side, unless a gap has a cheaper alignment."""
    a = np.arange(200, dtype=np.uint32)
    b = a.copy()
    b[[20, 40, 42]] = 999
    xs = np.array([0, 5, 30, 60, 90])
    [(x, y, columns)] = fuzzy_substrings.align(a, b, xs, xs, 5)
    assert (x, y, len(columns)) == (0, 0, 200) and (columns[:, :2] == 1).all() and np.flatnonzero(columns[:, 2] == 0).tolist() == [20, 40, 42]
    b[35:60] = [*a[36:60], 999]  # a word left out and another put in
    [(x, y, columns)] = fuzzy_substrings.align(a, b, xs, xs, 5)
    assert len(columns) == 201 and columns[:, :2].sum(axis=0).tolist() == [200, 200] and (columns[:, 2] == 0).sum() == 3


def test_chain_is_collinear_and_best():
    x, y = np.array([0, 5, 10, 15, 7, 20]), np.array([100, 105, 110, 115, 3, 120])
    best = fuzzy_substrings.chains(x, y, 5)[0]
    assert x[best].tolist() == [0, 5, 10, 15, 20] and y[best].tolist() == [100, 105, 110, 115, 120]


def test_tokens(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = sorted(rows_of(docs), key=lambda r: (r[0] is not None, r[0] or 0, utf8(r[1])))
    want, start = Counter(), 0
    for d, t, _ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want[d, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()), ids.count(2)] += 1
        start += len(ids)
    got = tokens.read_shards(tokens.write_shards(docs, "byte_bpe_50k.json", 2, shard_tokens=700), 2).collect()
    assert Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.end_ids) for r in got) == want
    assert tokens.read_shards(tokens.write_shards(empty, "byte_bpe_50k.json", 2), 2).count() == 0


def test_pieces_are_the_librarys():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, rng = Tokenizer.from_file(path), random.Random(8)
    signs = ["a", "b", "Z", "é", "Ж", "7", "٣", " ", " ", "  ", "\n", "\t", "\xa0", "\x85", "\u2014", "\u2019", "'", "'s", "'x", ".", "#", "\x1c", "漢", "<|endoftext|>", "\r\n", "\u0300"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(12))) for _ in range(3000)] + ["", " ", "\xa0", "\n\n"]
    raw = [t.encode() for t in texts]
    encode = tokens.PieceEncoder(path, 2)
    encode.MOST = 500
    ids, sizes = encode(np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), dtype=np.uint8))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    # a tokenizer of another form is asked for whole texts
    other = tokens.PieceEncoder(public_tokenizers.path("word_bpe_49k.json"), 2)
    assert not other.known_form
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    raw = [b"Some Words here", b"", b"more"]
    ids, sizes = other(np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), dtype=np.uint8))
    assert ids.tolist() == [i for t in raw for i in [*library.encode(t.decode(), add_special_tokens=False).ids, 2]]


def test_wavelet_matrix():
    ids = np.random.default_rng(0).integers(0, 50257, 300_000).astype(np.uint32)
    ids[::7] = 11
    file = tokens.pack([None, 5], [100_000, 200_000], ids)
    m = tokens.TokenShard(file)
    assert m.documents()[0] == [None, 5] and m.documents()[1].tolist() == [100_000, 200_000]
    assert m.access(123_456) == ids[123_456] and len(m.opened) == m.bits < m.bits * m.chunks  # one chunk a plane
    assert [m.access(i) for i in (0, 7, 131_071, 131_072, 299_999)] == ids[[0, 7, 131_071, 131_072, 299_999]].tolist()
    places = np.array([0, 1, 511, 512, 1500, 131_072, 200_001, 300_000])
    for token in (11, int(ids[5]), 50_300):
        assert m.ranks(token, places).tolist() == [int((ids[:i] == token).sum()) for i in places]
        assert m.count(token) == int((ids == token).sum())
    where = np.flatnonzero(ids == 11)
    fresh = tokens.TokenShard(file)
    assert [fresh.select(11, k) for k in (0, 5, 20_000, len(where) - 1, len(where))] == [where[0], where[5], where[20_000], where[-1], -1]
    assert fresh.select(int(ids[5]), 0) == np.flatnonzero(ids == ids[5])[0] and fresh.count(70_000) == 0
    assert (tokens.TokenShard(file).decode() == ids).all()
    assert tokens.TokenShard(tokens.pack([], [], np.zeros(0, np.uint32))).decode().tolist() == []
    with pytest.raises(ValueError):
        tokens.pack([1], [1], np.array([65_536]))


def test_media(docs, empty):
    got = media.media_features(docs).collect()
    want = Counter()
    for d, t, _ in rows_of(docs):
        b = utf8(t)
        p = b + bytes(-len(b) % 64) if b else bytes(64)
        want[d, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert media.media_features(empty).count() == 0


def test_jpeg_parts():
    payload = bytes(random.Random(2).randrange(256) for _ in range(64 * 70)) + b" " * 64 + b" " * 63 + b"e" + b"e" + b" " * 40 + b"x" + b" " * 22
    data = media.encode(payload)
    image = media.parse(data)
    assert (image["width"], image["height"]) == (512, 16) and media.payload_of(image, media.coefficients(image)) == payload
    assert (scalar(image)[0] == media.coefficients(image)).all()
    texts = [b"a" * 64, payload, b"plain words of a text go here. " * 20 + b" " * 20]
    files = media.encode_all(texts)
    assert files[1] == data and [media.payload_of(i, c) for i, c in zip(map(media.parse, files), media.restarted([media.parse(f) for f in files]))] == texts
    for damaged in (data[:-40] + data[-2:], data.replace(b"\xff\xd1", b"\xff\x00", 1)):
        with pytest.raises((ValueError, IndexError)):
            media.coefficients(media.parse(damaged))


def scalar(image: dict) -> list[np.ndarray]:
    """All components' coefficients, bit by bit, as the standard words it."""
    parts, scan = image["parts"], image["scan"]
    h, v = (max(p[k] for p in parts) for k in (1, 2))
    if len(parts) == 1:
        h = v = 1
    across, down = -(-image["width"] // (8 * h)), -(-image["height"] // (8 * v))
    shape = [(1, 1)] if len(parts) == 1 else [p[1:3] for p in parts]
    out = [np.zeros((down * b, across * a, 64), dtype=int) for a, b in shape]
    stretches = [x.replace(b"\xff\x00", b"\xff") for x in re.split(b"\xff[\xd0-\xd7]", scan)]
    tables = {}
    for k, (counts, symbols) in image["huffman"].items():
        code, at, tables[k] = 0, 0, {}
        for n in range(1, 17):
            for _ in range(counts[n - 1]):
                tables[k][f"{code:0{n}b}"] = symbols[at]
                code, at = code + 1, at + 1
            code *= 2
    bits, at, last = "", 0, []
    for unit in range(across * down):
        if unit == 0 or image["restart"] and unit % image["restart"] == 0:
            bits, at, last = "".join(f"{x:08b}" for x in stretches.pop(0)), 0, [0] * len(parts)
        for k, (a, b) in enumerate(shape):
            dc, ac = image["tables"][parts[k][0]]
            for y in range(b):
                for x in range(a):
                    block, place = out[k][unit // across * b + y, unit % across * a + x], 0
                    while place < 64:
                        n = 1
                        table = tables[dc if place == 0 else 16 | ac]
                        while bits[at : at + n] not in table:
                            n += 1
                            assert n <= 16
                        symbol = table[bits[at : at + n]]
                        run, size = symbol >> 4, symbol & 15
                        value = bits[at + n : at + n + size]
                        at += n + size
                        number = 0 if not size else int(value, 2) if value[0] == "1" else int(value, 2) - (1 << size) + 1
                        if place == 0:
                            last[k] += number
                            block[0], place = last[k], 1
                        elif symbol == 0:
                            break
                        else:
                            place += run
                            block[place] = number
                            place += 1
    return out


@pytest.mark.parametrize("restart", [0, 1, 3])
@pytest.mark.parametrize("shape", [[(1, 1)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 2), (1, 1)]])
def test_jpeg_of_any_form(restart, shape):
    """Random scans: several components, subsampling, restarts, stuffing, codes of every length."""
    rng = random.Random(restart)
    dc_table = media.huffman_table({s: rng.random() for s in range(12)})
    ac_table = media.huffman_table({r << 4 | s: rng.random() ** 3 + 1e-2 for r in range(16) for s in range(1, 11)} | {0: 0.3, 0xF0: 0.01})
    dc, ac = media.codes(dc_table), media.codes(ac_table)
    width, height = 45, 37
    h, v = (max(s[k] for s in shape) for k in (0, 1)) if len(shape) > 1 else (1, 1)
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    scan, bits, last = b"", "", [0] * len(shape)
    put = lambda table, s, value: format(table[s][1], f"0{table[s][0]}b") + (format(value if value > 0 else value + (1 << (s & 15)) - 1, f"0{s & 15}b") if s & 15 else "")
    want = [np.zeros((down * b, across * a, 64), dtype=int) for a, b in (shape if len(shape) > 1 else [(1, 1)])]
    pad = lambda bits: int(bits + "1" * (-len(bits) % 8), 2).to_bytes(-(-len(bits) // 8), "big").replace(b"\xff", b"\xff\x00")
    for unit in range(across * down):
        if restart and unit and unit % restart == 0:
            scan += pad(bits) + bytes([0xFF, 0xD0 + (unit // restart - 1) % 8])
            bits, last = "", [0] * len(shape)
        for k, (a, b) in enumerate(shape if len(shape) > 1 else [(1, 1)]):
            for y in range(b):
                for x in range(a):
                    block = [rng.randrange(-1000, 1000)] + [rng.choice([0, 0, 0, 0, 1, -1, 7, -300]) if rng.random() < 0.3 else 0 for _ in range(63)]
                    want[k][unit // across * b + y, unit % across * a + x] = block
                    diff, last[k] = block[0] - last[k], block[0]
                    bits += put(dc, abs(diff).bit_length(), diff)
                    run = 0
                    end = max([i for i in range(1, 64) if block[i]], default=0)
                    for i in range(1, end + 1):
                        if not block[i]:
                            run += 1
                            continue
                        while run > 15:
                            bits, run = bits + put(ac, 0xF0, 0), run - 16
                        bits, run = bits + put(ac, run << 4 | abs(block[i]).bit_length(), block[i]), 0
                    if end < 63:
                        bits += put(ac, 0, 0)
    scan += pad(bits)
    seg = media._segment
    parts = b"".join(bytes([k + 1, a << 4 | b, 0]) for k, (a, b) in enumerate(shape))
    data = b"\xff\xd8" + seg(0xDB, b"\x00" + bytes([3] + [1] * 63)) + seg(0xC0, bytes([8, 0, height, 0, width, len(shape)]) + parts)
    data += seg(0xC4, b"\x01" + dc_table[0] + dc_table[1]) + seg(0xC4, b"\x12" + ac_table[0] + ac_table[1])
    data += (seg(0xDD, bytes([0, restart])) if restart else b"") + seg(0xDA, bytes([len(shape)]) + b"".join(bytes([k + 1, 0x12]) for k in range(len(shape))) + bytes([0, 63, 0])) + scan + b"\xff\xd9"
    image = media.parse(data)
    got = media.coefficients(image)
    assert (got == want[0]).all() and all((a == b).all() for a, b in zip(scalar(image), want))
    thumb = media.thumbnail(image, got)
    for y in range(thumb.shape[0]):
        for x in range(thumb.shape[1]):
            assert thumb[y, x] == min(max((want[0][y, x, 0] * 3 + 4) // 8 + 128, 0), 255)
    rows, cols = [r * thumb.shape[0] // 8 for r in range(8)], [c * thumb.shape[1] // 8 for c in range(8)]
    small = [int(thumb[r, c]) for r in rows for c in cols]
    word = "".join("1" if 64 * x > sum(small) else "0" for x in small)
    assert media.feature(image, thumb) == f"{width}x{height}:{int(word, 2):016x}:{zlib.crc32(thumb.tobytes()):08x}"


def test_quality(spark, docs, empty):
    rng = random.Random(9)
    good = lambda: ". ".join(" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(8)).capitalize() for _ in range(5)) + ".\n" + "Plain words go on here."
    bad = lambda: "\n".join(" ".join(rng.choice(["BUY!!", "NOW!!", "###", "$$$ WIN"]) for _ in range(9)) for _ in range(4))
    rows = [(k, good() if k % 3 else bad()) for k in range(240)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k, _ in rows] + [(5000, 1, 0), (3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(table, labels)
    held = [r for r in quality.score_quality(table, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([(r.quality_score >= 0.5) == (r.doc_id % 3 > 0) for r in held]) > 0.97
    foreign = labels.unionByName(spark.range(10_000, 40_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic")))
    same = quality.train(table, foreign)  # labels of other documents don't count against the bound
    assert np.array_equal(same["weights"], model["weights"])
    few = quality.train(table, foreign, fit_docs=50, fit_lines=120)
    assert few is not None and not np.array_equal(few["weights"], model["weights"])
    assert quality.train(table, labels, fit_lines=0) is None
    scored = quality.score_quality(docs, model)
    assert scored.count() == docs.count() and scored.where("quality_score < 0 OR quality_score > 1 OR quality_score IS NULL").count() == 0
    assert quality.train(table, labels.limit(0)) is None and quality.score_quality(empty, None).count() == 0


def test_score_is_the_weighted_mean_of_marginals():
    rng = np.random.default_rng(6)
    texts = ["A plain line.\nBUY!! NOW 123\n\nA plain line.", "", None, "\n\n", "one", "é ü\n" * 5]
    model = {"mean": rng.normal(size=quality.FEATURES), "scale": rng.random(quality.FEATURES) + 0.5, "weights": rng.normal(size=3 * quality.FEATURES + 1), "moves": rng.normal(size=(2, 2))}
    got = quality.score_texts(texts, model)
    for text, score in zip(texts, got):
        lines = (text or "").encode().split(b"\n")
        x, _, n = quality.line_features(np.array([0, len((text or "").encode())]), np.frombuffer((text or "").encode(), dtype=np.uint8))
        assert n.tolist() == [len(lines)]
        z = (x - model["mean"]) / model["scale"]
        none = np.zeros(quality.FEATURES)
        emit = [np.concatenate([z[t], z[t - 1] if t else none, z[t + 1] if t + 1 < len(z) else none, [1]]) @ model["weights"] for t in range(len(z))]
        total, good = 0.0, np.zeros(len(z))
        for path in np.ndindex(*[2] * len(z)):
            w = np.exp(sum(e * c for e, c in zip(emit, path)) + sum(model["moves"][a, b] for a, b in zip(path, path[1:])))
            total, good = total + w, good + w * np.array(path)
        weight = np.array([len(line) for line in lines]) if any(lines) else np.ones(len(lines))
        assert score == pytest.approx(float((good / total * weight).sum() / weight.sum()), abs=1e-5)


def test_marginals_are_exact():
    rng = np.random.default_rng(1)
    lines, moves = np.array([3, 1, 4]), rng.normal(size=(2, 2))
    score = rng.normal(size=8)
    got, at = quality.marginals(score, lines, moves), 0
    for n in lines:
        total = np.zeros(n)
        z = 0.0
        for path in np.ndindex(*[2] * n):
            w = np.exp(sum(score[at + t] * c for t, c in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            z += w
            total += w * np.array(path)
        assert got[at : at + n] == pytest.approx(total / z)
        at += n
