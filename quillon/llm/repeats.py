"""What suffix-array dedup and substring dedup share: bringing equal windows together.

A window is `w` consecutive elements (bytes or words) of one document. Among the
`k`-grams of a window the one with the smallest hash is its anchor, so equal
windows have equal anchors at the same place, and successive windows mostly share
one. The windows of a document fall into runs with a common anchor, one run in about
(w - k) / 2 elements, and only runs are shuffled:

1. Runs with equal text form a class, counted before the shuffle; from here on one
   text stands for the class, with its number of runs and its smallest doc. This
   only shrinks what follows: with `merge` off every run is a class of its own, and
   results are the same.
2. The texts of an anchor's classes go to one task, where `compare`, the method of
   the operator, finds the windows that repeat. What it finds for a class holds for
   all its runs, or, where only earlier documents count and the class itself is the
   earlier one, for its runs in later documents.
3. An anchor with more than `crowd` classes is not put in one task: its texts are cut
   into blocks of windows, keyed by the elements that all windows of the block have
   in common, and the blocks go through the same steps; what is still crowded then
   is cut into single windows, whose anchors have one class each. What is found
   for blocks goes back to the classes they were cut from.

Nothing is dropped or capped on the way. Anchors and classes are recognised by
64-bit hashes, windows in step 2 by their elements.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Rolling, Texts, U, arrow_map, dropped, mixed, released, squeezed, stored, unsqueezed

TASK_BYTES = 4 << 20
_AT = U((1 << 34) - 1)
RUNS = "h long, sp long, doc long, tid long, a long, t int, m int"
CUT = f"{RUNS}, n long, ph long, psp long, pa long"  # with the number of runs and the class and place it was cut from
NO_DOC = -(1 << 63)


def _smallest(v: np.ndarray, q: int) -> np.ndarray:
    """The minimum of each q consecutive values."""
    n = len(v)
    wide = np.full(-(-n // q) * q, np.iinfo(np.uint64).max, np.uint64)
    wide[:n] = v
    blocks = wide.reshape(-1, q)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - q + 1], before[q - 1 : n])


def runs(values: np.ndarray, first: np.ndarray, w: int, k: int):
    """(row, first window's start, anchor, last window's start, hash of the anchor, hash of the run) of the runs; places are in the chunk."""
    n = len(values)
    if n < w:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    roll = Rolling(values)
    at = np.arange(n - k + 1)
    grams = roll.hashes(at, at + k)
    p = (_smallest((grams & ~_AT) | at.astype(np.uint64), w - k + 1) & _AT).astype(np.int64)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[: n - w + 1]
    s = np.flatnonzero(np.arange(n - w + 1) + w <= first[1:][row])
    p, row = p[s], row[s]
    new = np.ones(len(s) + 1, bool)
    new[1:-1] = (p[1:] != p[:-1]) | (row[1:] != row[:-1])
    a, b = s[new[:-1]], s[new[1:]]
    p, row = p[new[:-1]], row[new[:-1]]
    sp = mixed(roll.hashes(a, b + w) + U(0x9E3779B97F4A7C15) * ((p - a) * 2 * w + (b - a)).astype(np.uint64))
    return row, a, p, b, mixed(grams[p] + U(k)), sp


class Windows:
    """How documents become elements. split(Texts) yields (first row, row after the last, values, offsets in elements, elements as bytes of `width` each).

    compare(h, doc, n, t, m, data) yields (row, start, end, others) of what repeats in texts of m + w elements whose anchor begins at t.
    """

    def __init__(self, w: int, k: int, block: int, width: int, split: Callable[[Texts], Iterator], compare: Callable, earlier: bool, crowd: int, merge: bool = True):
        self.w, self.k, self.block, self.width, self.split, self.compare, self.earlier, self.crowd, self.merge = w, k, block, width, split, compare, earlier, crowd, merge


def _keyed(documents: DataFrame) -> DataFrame:
    """doc, tid, text. tid tells rows of one doc_id apart by their text, and is 0 where ids don't repeat; a null id counts as the smallest."""
    text = F.coalesce(F.col("`text`"), F.lit(""))
    repeat = documents.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    return documents.select(F.coalesce(F.col("`doc_id`"), F.lit(NO_DOC)).alias("doc"), (F.lit(0).cast("long") if repeat else F.xxhash64(text)).alias("tid"), text.alias("text"))


def _all_runs(documents: DataFrame, how: Windows) -> DataFrame:
    def work(batch):
        doc, tid = batch["doc"].to_numpy(), batch["tid"].to_numpy()
        for i, _, values, first, _ in how.split(Texts(batch["text"])):
            row, a, p, b, h, sp = runs(values, first, how.w, how.k)
            if len(row):
                yield {"h": h.view(np.int64), "sp": sp.view(np.int64), "doc": doc[i + row], "tid": tid[i + row], "a": a - first[row], "t": (p - a).astype(np.int32), "m": (b - a).astype(np.int32)}

    return arrow_map(documents, work, RUNS)


def _with_texts(documents: DataFrame, reps: DataFrame, how: Windows, make: Callable, schema: str) -> DataFrame:
    """make(row's runs, values, elements' bytes) for the documents of reps (doc, tid, h, sp, a, t, m, n)."""
    per = reps.groupBy("doc", "tid").agg(F.collect_list(F.struct("h", "sp", "a", "t", "m", "n")).alias("runs"))  # some runs of one document
    texts = documents.join(per.hint("merge"), ["doc", "tid"])  # a repeated row gives its runs again, which changes no result

    def work(batch):
        doc, tid = batch["doc"].to_numpy(), batch["tid"].to_numpy()
        found = batch["runs"]
        flat, ends = found.flatten(), found.offsets.to_numpy() - found.offsets[0].as_py()
        columns = {n: flat.field(n).to_numpy() for n in ("h", "sp", "a", "t", "m", "n")}
        for i, j, values, first, raw in how.split(unsqueezed(batch["z"], batch["size"])):
            lo, hi = ends[i], ends[j]
            row = np.repeat(np.arange(j - i), np.diff(ends[i : j + 1]))
            r = {n: c[lo:hi] for n, c in columns.items()}
            r |= {"doc": doc[i + row], "tid": tid[i + row], "at": r["a"] + first[row]}
            yield from make(r, values, raw)

    return arrow_map(texts, work, schema)


def _spans(documents: DataFrame, reps: DataFrame, how: Windows) -> DataFrame:
    def make(r, values, raw):
        for lo in range(0, len(r["h"]), 4000):
            part = {n: c[lo : lo + 4000] for n, c in r.items()}
            begin, end = part["at"] * how.width, (part["at"] + part["m"] + how.w) * how.width
            yield {n: part[n] for n in ("h", "sp", "doc", "t", "m", "n")} | {"span": [raw[x:y] for x, y in zip(begin.tolist(), end.tolist(), strict=True)]}

    return _with_texts(documents, reps, how, make, "h long, sp long, doc long, t int, m int, n long, span binary")


def _cut(documents: DataFrame, reps: DataFrame, how: Windows, block: int) -> DataFrame:
    """Each run cut into blocks of at most `block` windows, keyed by what the block's windows have in common."""

    def make(r, values, raw):
        roll = Rolling(values)
        p, tmax, tmin = r["at"] + r["t"], r["t"].astype(np.int64), (r["t"] - r["m"]).astype(np.int64)
        low, high = tmin // block, tmax // block
        n = high - low + 1
        of = np.repeat(np.arange(len(p)), n)
        j = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + low[of]
        core = roll.hashes(p[of] - block * j, p[of] - block * j - (block - 1) + how.w)
        t0, t1 = np.maximum(block * j, tmin[of]), np.minimum(block * j + block - 1, tmax[of])
        a, b = p[of] - t1, p[of] - t0
        h = mixed(core + r["h"][of].view(np.uint64) * U(3) + j.astype(np.uint64) * U(0x9E3779B97F4A7C15))
        sp = mixed(roll.hashes(a, b + how.w) + U(0x9E3779B97F4A7C15) * (t1 * 2 * how.w + t1 - t0).astype(np.uint64))
        yield {"h": h.view(np.int64), "sp": sp.view(np.int64), "doc": r["doc"][of], "tid": r["tid"][of], "a": r["a"][of] + a - r["at"][of], "t": t1.astype(np.int32), "m": (t1 - t0).astype(np.int32), "n": r["n"][of], "ph": r["h"][of], "psp": r["sp"][of], "pa": r["a"][of]}

    return _with_texts(documents, reps, how, make, CUT)


FOUND = "h long, sp long, least long, start long, end long, others boolean"


def _compared(spans: DataFrame, how: Windows) -> DataFrame:
    """how.compare over whole anchors, as many at a time as TASK_BYTES hold: pieces of classes, from their run's first window on; others: only of runs in docs after least."""
    limit = TASK_BYTES
    made = pa.schema([*((n, pa.int64()) for n in ("h", "sp", "least", "start", "end")), ("others", pa.bool_())])

    def judged(table: pa.Table):
        c = {n: table[n].to_numpy() for n in ("h", "sp", "doc", "t", "m", "n")}
        data = np.frombuffer(b"".join(table["span"].to_pylist()), np.uint8)
        row, s, e, others = how.compare(c["h"], c["doc"], c["n"], c["t"].astype(np.int64), c["m"].astype(np.int64), data)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (c["h"][row], c["sp"][row], c["doc"][row], s, e, others)], schema=made)

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                held.append(part)
                size += part.nbytes
                if size > limit:
                    table = pa.Table.from_batches(held)
                    h = table["h"].to_numpy()
                    whole = int(np.searchsorted(h, h[-1]))  # the last anchor may go on
                    if whole:
                        yield judged(table.slice(0, whole))
                        rest = table.slice(whole)
                        held, size = rest.combine_chunks().to_batches(), rest.nbytes
        if held:
            yield judged(pa.Table.from_batches(held))
        released()

    return spans.repartition(F.col("h")).sortWithinPartitions("h").mapInArrow(run, FOUND)


def repeated(documents: DataFrame, how: Windows) -> tuple[DataFrame, DataFrame]:
    """Documents (doc, tid, z, size) and pieces (doc, tid, start, end) that cover exactly the elements of repeated windows (for `earlier`: of windows that also start in a smaller doc)."""
    keyed = _keyed(documents)
    docs = squeezed(keyed)
    rows = stored(_all_runs(keyed, how), "runs")
    levels = []
    for block in (how.block, 1, 0):
        if not how.merge:
            rows = rows.withColumn("sp", F.xxhash64("sp", "doc", "tid", "a"))
        n = F.sum("n") if levels else F.count(F.lit(1))
        classes = stored(rows.groupBy("h", "sp").agg(n.alias("n"), F.min(F.struct("doc", "tid", "a", "t", "m")).alias("rep")).select("h", "sp", "n", "rep.*"), "classes")
        anchors = classes.groupBy("h").agg(F.count(F.lit(1)).alias("classes"), F.max("n").alias("most")).filter("classes > 1 or most > 1")
        live = stored(classes.join(anchors.select("h", "classes").hint("merge"), "h"), "anchors")
        dropped(classes)
        crowded = live.filter(F.col("classes") > how.crowd) if block else live.limit(0)
        found = stored(_compared(_spans(docs, live.filter(F.col("classes") <= how.crowd) if block else live, how), how), "found")
        levels.append((rows, found))
        if crowded.isEmpty():
            break
        rows = stored(_cut(docs, crowded, how, block), "runs")
    rows, found = levels.pop()
    while levels:
        # a piece of a block goes to the class it was cut from: to all its runs, or, where the class has the smallest doc itself, to its others
        up = rows.join(found.hint("merge"), ["h", "sp"]).filter("not others or doc > least or n > 1")
        up = up.select(F.col("ph").alias("h"), F.col("psp").alias("sp"), F.col("doc").alias("least"), (F.col("start") + F.col("a") - F.col("pa")).alias("start"), (F.col("end") + F.col("a") - F.col("pa")).alias("end"), (F.col("others") & (F.col("doc") == F.col("least"))).alias("others"))
        rows, before = levels.pop()
        found = before.unionByName(up)
    pieces = rows.join(found.hint("merge"), ["h", "sp"]).filter("not others or doc > least")
    return docs, pieces.select("doc", "tid", (F.col("start") + F.col("a")).alias("start"), (F.col("end") + F.col("a")).alias("end"))


def with_pieces(documents: DataFrame, pieces: DataFrame) -> DataFrame:
    """documents with their pieces in start and end, arrays that are null where there are none."""
    per = pieces.groupBy("doc", "tid").agg(F.collect_list("start").alias("start"), F.collect_list("end").alias("end"))
    return documents.join(per.hint("merge"), ["doc", "tid"], "left")


def doc_ids(batch: pa.RecordBatch) -> pa.Array:
    doc = batch["doc"].to_numpy()
    return pa.array(doc, mask=doc == NO_DOC)


def removed(n: int, start: list, end: list) -> np.ndarray:
    mask = np.zeros(n + 1, np.int64)
    np.add.at(mask, np.asarray(start, np.int64), 1)
    np.add.at(mask, np.asarray(end, np.int64), -1)
    return np.cumsum(mask)[:-1] > 0
