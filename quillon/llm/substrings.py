"""Substring dedup: words covered by a window of `length` words that also starts in an earlier document.

Prefix-partitioned suffix trees: suffixes are split by a prefix of variable length,
the words up to the end of their window's anchor (see repeats), and by longer ones
where many texts share it, so that a group fits in memory. The suffixes of a group
are the leaves of its tree, in sorted order; between two leaves stands their common
prefix, and a branching node is a run of leaves whose common prefixes reach its string
depth. The nodes at a depth of `length` or more that have none such above them hold
the repeats, each maximal to the right: a leaf with an earlier doc_id beside it under
such a node loses as many words as the node is deep.

Defined results: a null text has no words; texts with fewer words than `length` lose
nothing; rows of one doc_id never remove each other; a null doc_id counts as the
smallest; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from quillon.llm.common import NOT_SPACE, Texts, arrow_map, pick, unsqueezed, word_hashes, words
from quillon.llm.repeats import Windows, doc_ids, removed, repeated, with_pieces

LENGTH, GRAM, BLOCK = 50, 8, 8
CROWD = 32_768  # texts of one anchor in a task: 24 MB


def _words(texts: Texts):
    for i, j, data, offsets in texts.chunks():
        starts, ends, first = words(data, offsets, NOT_SPACE)
        h = word_hashes(data, starts, ends)
        yield i, j, h, first, h.tobytes()


def leaves(values: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in sorted order, and the common prefix of each with the one before. Suffix i is values[i : end[i]]; none equals a longer one's prefix for sorting, as ends come first."""
    n = len(values)
    size = end - np.arange(n)
    ranks = [np.unique(values, return_inverse=True)[1].astype(np.int64) + 1]
    depth = 1
    while depth < size.max(initial=0):
        after = np.zeros(n, np.int64)  # the rank of what follows; 0 where the text has ended
        some = np.flatnonzero(size > depth)
        after[some] = ranks[-1][some + depth]
        ranks.append(np.unique(ranks[-1] * (n + 1) + after, return_inverse=True)[1].astype(np.int64) + 1)
        depth *= 2
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1], order[1:]
    common = np.zeros(max(0, n - 1), np.int64)
    for k in range(len(ranks) - 1, -1, -1):  # as for a binary number, from the longest equal block
        x, y = a + common, b + common
        fits = (np.minimum(size[a], size[b]) - common) >= 1 << k
        common += np.where(fits & (ranks[k][np.minimum(x, n - 1)] == ranks[k][np.minimum(y, n - 1)]), 1 << k, 0)
    return order, np.append([0], common)[:n]


def deep_nodes(common: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first leaf, leaf after the last, string depth) of the topmost branching nodes that are at least `length` deep."""
    deep = np.concatenate(([False], common[1:] >= length, [False])).astype(np.int8)
    edge = np.diff(deep)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(first):
        return first, last, first
    bounds = np.stack((first + 1, last + 1), 1).ravel()
    return first, last + 1, np.minimum.reduceat(np.append(common, 0), bounds)[::2]


def _compare(h, doc, n, t, m, data):
    values = np.frombuffer(data.tobytes(), np.uint64)
    size = m + LENGTH
    begin = np.cumsum(size) - size
    row = np.repeat(np.arange(len(h)), size)
    order, common = leaves(values, (begin + size)[row])
    first, last, depth = deep_nodes(common, LENGTH)
    node = np.repeat(np.arange(len(first)), last - first)
    leaf = order[np.repeat(first - np.concatenate(([0], np.cumsum(last - first)))[:-1], last - first) + np.arange(len(node))]
    least = np.minimum.reduceat(doc[row[leaf]], np.concatenate(([0], np.cumsum(last - first)[:-1]))) if len(first) else np.zeros(0, np.int64)
    gone = doc[row[leaf]] > least[node]
    leaf, depth = leaf[gone], depth[node[gone]]
    turn = np.argsort(leaf)
    leaf, depth = leaf[turn], depth[turn]
    own = row[leaf]
    start, end = leaf - begin[own], leaf - begin[own] + depth
    if len(own):  # overlapping pieces of a row as one
        reach = np.maximum.accumulate(end + own * (1 << 32))
        new = np.append(True, (own[1:] != own[:-1]) | (start[1:] + own[1:] * (1 << 32) > reach[:-1]))
        at = np.flatnonzero(new)
        own, start, end = own[at], start[at], np.append(reach[at[1:] - 1], reach[-1]) - own[at] * (1 << 32)
    many = np.flatnonzero(n > 1)  # the runs of a class in later docs lose all of it
    return np.append(own, many), np.append(start, 0 * many), np.append(end, size[many]), np.append(np.zeros(len(own), bool), np.ones(len(many), bool))


WINDOWS = Windows(LENGTH, GRAM, BLOCK, 8, _words, _compare, True, CROWD)


def substring_dedup(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the kept words, joined by spaces) of each row."""
    documents = pick(documents, "doc_id", "text")

    def work(batch):
        ids, start, end = doc_ids(batch), batch["start"].to_pylist(), batch["end"].to_pylist()
        for i, j, data, offsets in unsqueezed(batch["z"], batch["size"]).chunks():
            raw = data.tobytes()
            rows = {n: [] for n in ("n_words", "n_removed", "kept_sha256", "kept")}
            for k in range(j - i):
                text = raw[offsets[k] : offsets[k + 1]].split()
                kept = text
                if start[i + k]:
                    mask = removed(len(text), start[i + k], end[i + k])
                    kept = [text[x] for x in np.flatnonzero(~mask)]
                joined = b" ".join(kept)
                for n, x in zip(rows, (len(text), len(text) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode()), strict=True):
                    rows[n].append(x)
            yield {"doc_id": ids.slice(i, j - i)} | rows

    return arrow_map(with_pieces(*repeated(documents, WINDOWS)), work, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
