"""Quality rules: base rules and a calibrated hashed n-gram classifier.

Features of a text are hashed word unigrams and bigrams and character 4-grams, as
frequencies within the text. A logistic regression is trained on labelled rows
(quality 1 or 0), then a Platt scale is fitted on a held-out fifth, so scores are
probabilities. Scoring is one pass over Arrow batches: hashes, a table look-up
and a sum by document, against a fixed threshold.

Defined results: a null or empty text has no words and fails the base rules.
Labels and documents that repeat are trained on once; labels with a null doc_id or
quality, or of unknown or empty documents, are left out. Without rows of both classes
there is no model and base rules alone decide. Repeated rows are scored each.
Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillon.llm.common import NOT_SPACE, Texts, U, in_small_batches, mixed, pick, released, word_hashes, words

BITS = 16
WORDS, PAIRS, GRAMS = 0, 1 << BITS, 2 << BITS  # three tables, one after the other
#: Labelled rows used in training at most, those with the smallest hashes of doc_id; it bounds the training task.
MAX_TRAIN_ROWS = 3000
THRESHOLD = 0.5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[*b"#*$%&|<>"]] = True


def _features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, offsets: np.ndarray):
    """(row, feature) arrays for each of the three tables."""
    h = word_hashes(data, starts, ends)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    shift = U(64 - BITS)
    yield row, (h >> shift).astype(np.int32) + WORDS
    same = row[1:] == row[:-1]
    yield row[1:][same], (mixed(h[:-1] * U(3) + h[1:])[same] >> shift).astype(np.int32) + PAIRS
    c = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)  # code points
    if len(c) > 3:
        k = np.uint32(2654435761)
        grams = ((c[:-3] * k + c[1:-2]) * k + c[2:-1]) * k + c[3:]
        grams = ((grams ^ grams >> np.uint32(15)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)
        lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        point_row = np.repeat(np.arange(len(offsets) - 1), np.diff(lead[offsets]))
        same = point_row[3:] == point_row[:-3]
        yield point_row[3:][same], grams[same].astype(np.int32) + GRAMS


def _scores(weights: np.ndarray, data, starts, ends, first, offsets) -> np.ndarray:
    """Sum over the tables of the mean weight of a row's features, plus the intercept."""
    n = len(offsets) - 1
    out = np.full(n, weights[-1], np.float64)
    for row, feature in _features(data, starts, ends, first, offsets):
        count = np.bincount(row, minlength=n)
        out += np.bincount(row, weights[feature], n) / np.maximum(count, 1)
    return out


def _fit(batch: pa.RecordBatch, epochs: int = 300, rate: float = 0.05) -> np.ndarray | None:
    """Weights, intercept, then Platt's two numbers; full-batch Adam over the sample, so the order of rows has no effect."""
    order = np.lexsort((batch["hash"].to_numpy(), batch["quality"].to_numpy(), batch["doc_id"].to_numpy()))
    batch = batch.take(pa.array(order))
    y = batch["quality"].to_numpy().astype(np.float64)
    held = mixed(batch["doc_id"].to_numpy().astype(np.uint64)) % U(5) == 0
    if len(set(y[~held])) < 2:
        held[:] = False
    if len(set(y)) < 2:
        return None
    t = Texts(batch["text"])
    n, size = len(y), 3 << BITS
    rows, cols, values = [], [], []
    for i, _, data, offsets in t.chunks():
        for row, feature in _features(data, *words(data, offsets, NOT_SPACE), offsets):
            key, count = np.unique(row.astype(np.int64) * size + feature, return_counts=True)
            r = key // size
            rows.append((r + i).astype(np.int32)), cols.append((key % size).astype(np.int32))
            values.append((count / np.maximum(np.bincount(row), 1)[r]).astype(np.float32))
    rows, cols, values = (np.concatenate(x) for x in (rows, cols, values))
    used = np.flatnonzero(np.bincount(cols, minlength=size))
    place = np.zeros(size, np.int32)
    place[used] = np.arange(len(used))
    cols = place[cols]
    blocks = [slice(k, k + 500_000) for k in range(0, len(cols), 500_000)]  # entries worked on at a time

    def by_row(w: np.ndarray) -> np.ndarray:
        return sum((np.bincount(rows[b], w[cols[b]] * scaled[b], n) for b in blocks), np.zeros(n))

    def by_feature(g: np.ndarray) -> np.ndarray:
        return sum((np.bincount(cols[b], g[rows[b]] * scaled[b], len(used)) for b in blocks), np.zeros(len(used)))

    spread = np.sqrt(np.maximum(np.bincount(cols, values**2) / n, 1e-12))  # rare features need larger weights
    scaled = values  # in place
    for b in blocks:
        scaled[b] = values[b] / spread[cols[b]] * 0.02
    balance = np.where(y == 1, 0.5 / max(1, (y[~held] == 1).sum()), 0.5 / max(1, (y[~held] == 0).sum())) * ~held
    w, m, v = np.zeros((3, len(used) + 1))
    for step in range(1, epochs + 1):
        z = by_row(w[:-1]) + w[-1]
        g = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.append(by_feature(g) + 1e-4 * w[:-1], g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    z = by_row(w[:-1]) + w[-1]
    on = held if len(set(y[held])) == 2 else ~held
    a, b, x, target = 1.0, 0.0, z[on], np.where(y[on] == 1, ((y[on] == 1).sum() + 1) / ((y[on] == 1).sum() + 2), 1 / ((y[on] == 0).sum() + 2))
    for _ in range(50):  # Newton's method for the two numbers of the calibration
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        q = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - target) * x).sum() + 1e-3 * (a - 1), (p - target).sum()])
        hess = np.array([[(q * x * x).sum() + 1e-3, (q * x).sum()], [(q * x).sum(), q.sum() + 1e-6]])
        da, db = np.linalg.solve(hess, g)
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    out = np.zeros(size + 3)
    out[used], out[-3:] = w[:-1] * 0.02 / spread, (w[-1], a, b)
    return out


def train(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> np.ndarray | None:
    """Fit on at most max_rows labelled rows, in one task on an executor; a model has a fixed size (1.5 MB).

    The sample is drawn from what labels and documents share, before any text is moved.
    """
    chosen = pick(labels, "doc_id", "quality").dropna().filter(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("long").alias("quality")).distinct()
    texts = pick(documents, "doc_id", "text").filter("text != ''").withColumn("hash", F.xxhash64("text"))
    sample = chosen.join(texts.select("doc_id", "hash").distinct(), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "hash").limit(max_rows)
    sample = texts.join(F.broadcast(sample), ["doc_id", "hash"]).dropDuplicates(["doc_id", "quality", "hash"]).select("doc_id", "quality", "hash", "text")  # max_rows rows

    def fit(batches):
        table = pa.Table.from_batches(list(batches))
        model = _fit(table.combine_chunks().to_batches()[0]) if table.num_rows else None
        if model is not None:
            yield pa.RecordBatch.from_pydict({"model": pa.array([model.tobytes()], pa.binary())})
        released()

    row = sample.coalesce(1).mapInArrow(fit, "model binary").head()
    return np.frombuffer(row[0]) if row else None


def base_counts(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of the base rules for each row."""
    n = len(offsets) - 1
    by_row = lambda at: np.diff(np.searchsorted(at, offsets))
    n_words = np.diff(first)
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # bytes that begin a code point
    chars = np.concatenate(([0], np.cumsum(lead[ends] - lead[starts])))
    # 8-word windows: ranks of 1, 2, 4 and 8 words, each from pairs of the rank before, so equal ranks are equal words
    row = np.repeat(np.arange(n), n_words)
    h = word_hashes(data, starts, ends)
    rank = np.unique(mixed(h) ^ mixed(row.astype(np.uint64) * U(0x9E3779B97F4A7C15)), return_inverse=True)[1].astype(np.int64)
    for step in (1, 2, 4):
        if len(rank) <= step:
            rank = rank[:0]
            break
        rank = np.unique(rank[:-step] * len(h) + rank[step:], return_inverse=True)[1].astype(np.int64)
    repeat = np.zeros(len(h) + 1, np.int64)
    if len(rank):
        inside = row[: len(rank)] == row[7 : 7 + len(rank)]
        at = np.flatnonzero(inside)
        found = np.bincount(rank[at], minlength=len(rank))
        again = at[found[rank[at]] > 1]
        np.add.at(repeat, again, 1)
        np.add.at(repeat, again + 8, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(repeat)[:-1] > 0)))
    # lines with a word
    cut = np.union1d(np.flatnonzero(data == 10) + 1, offsets)
    begin, end = cut[:-1], cut[1:] - (data[cut[1:] - 1] == 10) if len(cut) > 1 else cut[1:]
    has = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end = begin[has], end[has]
    line_row = np.searchsorted(offsets, begin, "right") - 1
    key = np.stack((line_row.astype(np.uint64), word_hashes(data, begin, end)), 1)
    _, at = np.unique(key, axis=0, return_index=True)
    later = np.ones(len(begin), bool)
    later[at] = False
    return {
        "n_words": n_words, "word_chars": np.diff(chars[first]), "n_symbols": by_row(np.flatnonzero(SYMBOLS[data])),
        "n_dup_lines": np.bincount(line_row[later], minlength=n), "n_repeat_words": np.diff(covered[first]),
    }


def quality(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """documents with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality_score and kept added."""
    model = train(documents, labels, max_rows)
    sent = documents.sparkSession.sparkContext.broadcast(model)  # fixed size
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality_score", "kept"]
    documents = documents.drop(*[c for c in documents.columns if c in made])
    names = documents.columns  # numbered inside, whatever they are called
    documents = documents.toDF(*[f"_{k}" for k in range(len(names))])
    text = f"_{names.index('text')}"
    schema = StructType(list(documents.schema.fields))
    for name in made:
        schema = schema.add(name, {"base_failed": "boolean", "kept": "boolean", "quality_score": "double"}.get(name, "long"))

    def run(batches):
        model = sent.value
        for batch in batches:
            t, parts = Texts(batch[text]), []
            for _, _, data, offsets in t.chunks():
                starts, ends, first = words(data, offsets, NOT_SPACE)
                c = base_counts(data, offsets, starts, ends, first)
                c["base_failed"] = (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])
                z = np.zeros(len(offsets) - 1) if model is None else model[-2] * _scores(model[:-2], data, starts, ends, first, offsets) + model[-1]
                c["quality_score"] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                c["kept"] = ~c["base_failed"] & (c["quality_score"] >= threshold)
                parts.append(c)
            if parts:
                new = [pa.array(np.concatenate([p[k] for p in parts])) for k in made]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *made])
        released()

    return in_small_batches(documents).mapInArrow(run, schema).toDF(*names, *made)


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality(documents, labels).drop("text")
