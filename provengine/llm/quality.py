"""Quality classifier: a linear-chain conditional random field over a document's lines.

Every line has features (case, symbols, digits, punctuation, lengths, repetition inside the document) and
those of the lines before and after it; the field labels each line good or bad, and a document's score is
the mean of the lines' forward-backward marginals, weighted by line length. In training each line takes
its document's label; a document's lines weigh one together.

The field is fitted on at most `fit_docs` labelled documents, those first in the order of a hash of their
id (a documented bound; the features come from executors, the fit is on the driver). Every document is
scored, whole. Labels, language, source and id are no inputs of a score.

A null or empty text is one empty line; lines of length zero weigh nothing unless all are; rows with null
or repeated ids are scored row by row; labels that are null, or of ids that aren't there, are left out;
without any label every score is 0.5; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, prefix_hash, span_hash, stash, text_chunks

FEATURES = 12


def _class_table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=np.int32)
    out[np.frombuffer(chars, dtype=np.uint8)] = 1
    return out


_UPPER = _class_table(bytes(range(65, 91)))
_ALPHA = _UPPER + _class_table(bytes(range(97, 123)))
_DIGIT = _class_table(b"0123456789")
_PLAIN = _class_table(b".,;:'\"()?-")
_SHOUT = _class_table(b"!")
_BLANK = _class_table(b" \t\x0b\x0c\r")
_HIGH = _class_table(bytes(range(128, 256)))
_OTHER = 1 - np.minimum(_ALPHA + _DIGIT + _PLAIN + _SHOUT + _BLANK + _HIGH, 1)


def line_features(offsets: np.ndarray, data: np.ndarray):
    """(features, lengths in bytes, lines of each text): lines end at line feeds or at the text's end."""
    breaks = np.flatnonzero(data == 10)
    ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    # a text's last line ends at its end; a line feed just before an end leaves an empty last line
    owner = np.concatenate([np.searchsorted(offsets, breaks, side="right") - 1, np.arange(len(offsets) - 1)])
    order = np.lexsort((np.concatenate([breaks, offsets[1:]]), owner))
    ends, owner, is_break = np.concatenate([breaks, offsets[1:]])[order], owner[order], np.concatenate([np.ones(len(breaks), bool), np.zeros(len(offsets) - 1, bool)])[order]
    starts = np.empty_like(ends)
    starts[0] = 0
    starts[1:] = ends[:-1] + is_break[:-1]
    length = ends - starts
    sums = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[data])])[np.stack([starts, ends])], axis=0)[0]
    upper, alpha, digit, plain, shout, blank, high, other = map(sums, (_UPPER, _ALPHA, _DIGIT, _PLAIN, _SHOUT, _BLANK, _HIGH, _OTHER))
    size = np.maximum(length, 1)
    hashes = span_hash(prefix_hash(data), starts, ends) if len(data) else np.zeros(len(starts), np.uint64)
    key = mix(hashes ^ mix(owner.astype(np.uint64)))
    _, code, times = np.unique(key, return_inverse=True, return_counts=True)
    last = np.where(length > 0, data[np.maximum(ends - 1, 0)] if len(data) else 0, 0)
    x = np.stack([
        np.log1p(length) / 5, upper / np.maximum(alpha, 1), other / size, digit / size, plain / size, shout / size, high / size,
        blank / size, np.minimum(size / (blank + 1) / 10, 3), (times[code] > 1) & (length > 0), np.isin(last, (46, 63)), length == 0,
    ], axis=1).astype(np.float32)
    return x, length, np.bincount(owner, minlength=len(offsets) - 1)


def with_neighbours(x: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Each line's features, those of the lines before and after it in its text (zeros at the ends), and a constant."""
    out = np.zeros((len(x), 3 * x.shape[1] + 1), dtype=np.float32)
    k = x.shape[1]
    first = np.cumsum(lines) - lines
    out[:, :k], out[1:, k : 2 * k], out[:-1, 2 * k : 3 * k], out[:, -1] = x, x[:-1], x[1:], 1
    out[first, k : 2 * k] = 0
    out[first + lines - 1, 2 * k : 3 * k] = 0
    return out


def marginals(good: np.ndarray, lines: np.ndarray, moves: np.ndarray, pairs: bool = False):
    """P(line is good) of every line, from emission scores `good` (bad has 0) and transition scores (2, 2);
    with `pairs`, also the expected transitions of each text. All texts step together, line by line."""
    order = np.argsort(-lines, kind="stable")
    first, size = (np.cumsum(lines) - lines)[order], lines[order]
    p = 1 / (1 + np.exp(-np.clip(good, -30, 30)))
    emit = np.stack([1 - p, p], axis=1)
    step = np.exp(moves - moves.max())
    alpha, beta = np.empty_like(emit), np.ones_like(emit)
    live = [int(np.searchsorted(-size, -t, side="left")) for t in range(int(size[0]) if len(size) else 0)]  # texts with more than t lines
    for t, n in enumerate(live):
        at = first[:n] + t
        a = emit[at] if t == 0 else (alpha[at - 1] @ step) * emit[at]
        alpha[at] = a / a.sum(axis=1, keepdims=True)
    expected = np.zeros((len(lines), 2, 2))
    for t in range(len(live) - 1, 0, -1):
        n = live[t]
        at = first[:n] + t
        ahead = emit[at] * beta[at]
        if pairs:
            both = alpha[at - 1][:, :, None] * step * ahead[:, None, :]
            expected[order[:n]] += both / both.sum(axis=(1, 2), keepdims=True)
        b = ahead @ step.T
        beta[at - 1] = b / b.sum(axis=1, keepdims=True)
    joint = alpha * beta
    prob = joint[:, 1] / joint.sum(axis=1)
    return (prob, expected) if pairs else prob


def fit(x: np.ndarray, lines: np.ndarray, label: np.ndarray, rounds: int = 200, rate: float = 0.1, ridge: float = 1e-3) -> dict:
    """Maximum conditional likelihood of the lines' labels, by Adam on the exact gradient."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = with_neighbours((x - mean) / scale, lines)
    text = np.repeat(np.arange(len(lines)), lines)
    y, weight = label[text].astype(float), (1 / lines)[text] / len(lines)
    seen = np.zeros((2, 2))
    for c in (0, 1):
        seen[c, c] = ((lines - 1) / lines)[label == c].sum() / len(lines)
    theta, first, second = np.zeros(z.shape[1] + 4), 0.0, 0.0
    for k in range(1, rounds + 1):
        prob, pairs = marginals(z @ theta[:-4], lines, theta[-4:].reshape(2, 2), pairs=True)
        grad = np.concatenate([z.T @ (weight * (y - prob)), (seen - (pairs / lines[:, None, None]).sum(axis=0) / len(lines)).ravel()]) - ridge * theta
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        theta = theta + rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    return {"mean": mean, "scale": scale, "weights": theta[:-4], "moves": theta[-4:].reshape(2, 2)}


def score_texts(texts: list, model: dict | None) -> np.ndarray:
    out = np.full(len(texts), 0.5)
    if model is None:
        return out
    for first, offsets, data in text_chunks(texts):
        x, length, lines = line_features(offsets, data)
        prob = marginals(with_neighbours((x - model["mean"]) / model["scale"], lines) @ model["weights"], lines, model["moves"])
        at = np.cumsum(lines) - lines
        total = np.add.reduceat(length, at)
        weight = np.where(np.repeat(total, lines) > 0, length, 1)
        out[first : first + len(lines)] = np.clip(np.add.reduceat(prob * weight, at) / np.add.reduceat(weight, at), 0, 1)
    return out


def train(
    df: DataFrame, labels: DataFrame, fit_docs: int = 3000, fit_lines: int = 500_000, id_col: str = "doc_id", text_col: str = "text", held_out_fold: int = 1, folds: int = 3
) -> dict | None:
    """Fit on a bounded sample: of the labelled documents of `df` outside the held-out fold of crc32(id as text), in an order drawn
    from their ids, the first `fit_docs`, as long as their lines together are no more than `fit_lines` (48 bytes each).
    Labels of other documents don't count. None if no document is labelled."""
    usable = labels.where(F.col("quality").isin(0, 1) & (F.crc32(F.col(id_col).cast("string").cast("binary")) % folds != held_out_fold))
    usable = usable.groupBy(F.col(id_col).alias("label_id")).agg(F.min("quality").cast("int").alias("quality"))
    here = usable.join(df.select(F.col(id_col).alias("label_id")).distinct(), "label_id", "left_semi")
    picked = here.orderBy(F.md5(F.col("label_id").cast("string")), "label_id").limit(fit_docs)

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = []
            for _, offsets, data in text_chunks(texts):
                x, _, lines = line_features(offsets, data)
                rows += [part.tobytes() for part in np.split(x, np.cumsum(lines)[:-1])]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(rows, pa.binary())], names=["doc_id", "quality", "x"])

    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    joined = docs.join(F.broadcast(picked), F.col("doc_id") == F.col("label_id"))  # `fit_docs` rows at most
    rows = joined.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "quality").mapInArrow(run, "doc_id long, quality int, x binary")
    rows = stash(rows.groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min("x").alias("x")))  # `fit_docs` rows at most
    drawn = Window.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("lines", F.sum(F.length("x") / (4 * FEATURES)).over(drawn)).where(F.col("lines") <= fit_lines)
    rows = rows.orderBy("doc_id").select("quality", "x").collect()
    if not rows:
        return None
    parts = [np.frombuffer(r["x"], dtype=np.float32).reshape(-1, FEATURES) for r in rows]
    return fit(np.concatenate(parts), np.array([len(p) for p in parts]), np.array([r["quality"] for r in rows]))


def score_quality(df: DataFrame, model: dict | None, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """All of `df`'s columns with `score_col` added, in the place of one of that name."""
    df = df.drop(score_col)
    fields = df.schema.fields

    def run(batches):
        for batch in batches:
            scores = score_texts(batch.column(batch.schema.get_field_index(text_col)).to_pylist(), model)
            yield pa.record_batch([*batch.columns, pa.array(scores)], names=[*batch.schema.names, score_col])

    schema = type(df.schema)([*fields]).add(score_col, "double")
    return df.mapInArrow(run, schema)
