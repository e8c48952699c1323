"""Suffix-array dedup: bytes covered by a string of `length` bytes that also starts elsewhere.

Threshold-bounded interval expansion on a Burrows-Wheeler transform. Rows are the
suffixes that begin at one anchor, so the transform is a sparse one, with a row for
each text of the anchor. Two breadth-first backward extensions follow each other:

1. On the transform of the reversed texts, where extending backwards appends the next
   byte. All rows of an anchor are one interval; level by level it is split by that
   byte, and rows that part at level l have a common prefix of l. So the rows come
   in order and their common prefixes in increasing value, up to `length`, where
   expansion stops. No two suffixes are ever compared.
2. On the transform of the texts. Each interval is split by the byte before, level by
   level; the common prefix of neighbours in a child interval is the least of those
   between them, plus one for each level. Windows at a level repeat exactly where
   that reaches `length`, or where a row stands for several equal texts. Intervals
   of one row are dropped, and no level goes beyond the first byte a window can have
   before its anchor.

The array is partitioned by anchors (see repeats), so no part of it is larger than
one anchor's texts.

Defined results: a null text is empty; texts shorter than `length` lose nothing;
repeated rows are separate texts and so repeat each other; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from quillon.llm.common import BYTE_VALUES, Texts, arrow_map, pick, unsqueezed
from quillon.llm.repeats import Windows, doc_ids, removed, repeated, with_pieces

LENGTH, GRAM, BLOCK = 400, 64, 32
CROWD = 4096  # texts of one anchor in a task: 3 MB


def _bytes(texts: Texts):
    for i, j, data, offsets in texts.chunks():
        yield i, j, BYTE_VALUES[data], offsets, data.tobytes()


def prefixes(group: np.ndarray, at: np.ndarray, right: np.ndarray, data: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of their texts from `at` on, by group, and the common prefix of each with the row before: w at most, -1 where a group begins.

    Row r has right[r] bytes from at[r] on; rows of a group are together.
    """
    n = len(group)
    rows = np.arange(n)
    lcp = np.full(n, w)
    lcp[:1] = -1
    lcp[1:][group[1:] != group[:-1]] = -1
    open_ = np.arange(n)  # places whose interval has two rows or more
    for level in range(w):
        parted = lcp[open_] < w
        alone = parted & np.append(parted[1:], True)
        if alone.any():
            open_, parted = open_[~alone], parted[~alone]
        if not len(open_):
            break
        r = rows[open_]
        byte = np.where(level < right[r], data[np.minimum(at[r] + level, len(data) - 1)].astype(np.int64) + 1, 0)
        interval = np.cumsum(parted) - 1
        split = byte != byte[np.flatnonzero(parted)][interval]
        if split.any():
            some = np.flatnonzero(np.bincount(interval[split], minlength=interval[-1] + 1)[interval])
            turn = np.argsort(interval[some] * 257 + byte[some], kind="stable")
            rows[open_[some]] = r[some[turn]]
            key, of = byte[some[turn]], interval[some]
            lcp[open_[some[1:][(of[1:] == of[:-1]) & (key[1:] != key[:-1])]]] = level
    ended = np.minimum(right[rows], np.append([w], right[rows[:-1]]))  # texts that end together part there
    return rows, np.minimum(lcp, ended[:n])


def expand(group: np.ndarray, n: np.ndarray, t: np.ndarray, m: np.ndarray, data: np.ndarray, w: int) -> np.ndarray:
    """mark[row, x]: whether the window that starts x bytes before the row's anchor repeats within its group.

    A row's text is m + w bytes of data, its anchor t bytes into it, and it stands for n equal texts; rows of a group are together.
    """
    at = np.concatenate(([0], np.cumsum(m + w)))[:-1] + t
    level = np.arange(int(t.max(initial=0)) + 1)
    mark = (n > 1)[:, None] & (level >= (t - m)[:, None]) & (level <= t[:, None])
    rows, lcp = prefixes(group, at, m + w - t, data, w)
    for level in range(mark.shape[1]):
        if len(rows) < 2:
            break
        linked = np.concatenate((lcp >= w - level, [False]))
        mark[rows, level] |= linked[:-1] | linked[1:]
        on = np.flatnonzero(t[rows] > level)
        interval = np.cumsum(lcp < 0)
        key = interval[on] * 256 + data[at[rows[on]] - level - 1]
        turn = np.argsort(key, kind="stable")
        on, key = on[turn], key[turn]
        if len(on) < 2:
            break
        bounds = np.empty(2 * len(on) - 2, np.int64)
        bounds[::2], bounds[1::2] = on[:-1] + 1, on[1:] + 1
        joined = key[1:] == key[:-1]
        least = np.full(len(on), -1)
        pair = np.flatnonzero(joined)
        if len(pair):
            some = np.stack((bounds[::2][pair], bounds[1::2][pair]), 1).ravel()
            least[pair + 1] = np.minimum.reduceat(np.append(lcp, -1), some)[::2]
        alive = least >= 0
        alive[:-1] |= least[1:] >= 0
        rows, lcp = rows[on[alive]], least[alive]
    return mark


def _compare(h, doc, n, t, m, data):
    mark = np.zeros((len(h), LENGTH - GRAM + 3), np.int8)
    found = expand(np.unique(h, return_inverse=True)[1], n, t, m, data, LENGTH)
    mark[:, 1 : found.shape[1] + 1] = found
    edge = np.diff(mark, axis=1)
    row, begin = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)  # levels begin .. end - 1
    return row, t[row] - end + 1, t[row] - begin + LENGTH, np.zeros(len(row), bool)


WINDOWS = Windows(LENGTH, GRAM, BLOCK, 1, _bytes, _compare, False, CROWD)


def suffix_dedup(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (bytes) of each row."""
    documents = pick(documents, "doc_id", "text")

    def work(batch):
        ids, start, end = doc_ids(batch), batch["start"].to_pylist(), batch["end"].to_pylist()
        for i, j, data, offsets in unsqueezed(batch["z"], batch["size"]).chunks():
            rows = {n: [] for n in ("n_removed", "n_spans", "kept_sha256", "kept")}
            for k in range(j - i):
                text = data[offsets[k] : offsets[k + 1]]
                gone, spans, kept = 0, 0, text.tobytes()
                if start[i + k]:
                    mask = removed(len(text), start[i + k], end[i + k])
                    gone, spans, kept = int(mask.sum()), int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()), text[~mask].tobytes()
                for n, x in zip(rows, (gone, spans, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    rows[n].append(x)
            yield {"doc_id": ids.slice(i, j - i), "n_bytes": np.diff(offsets)} | rows

    return arrow_map(with_pieces(*repeated(documents, WINDOWS)), work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op6_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
