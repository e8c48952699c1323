"""Benchmark decontamination with a distributed positional inverted index.

The index is a stored table of blocks, made once and of all words, whatever the test
items are. A block covers about half a MB of whole documents and has, for each of its
terms, the sorted positions of its postings. A test phrase is looked up in each
block by intersecting offset-adjusted posting lists, the rarest term first (by its
count over the whole index), so most phrases end at the first, empty list. Terms
are told apart by 64-bit hashes.

Phrases are all windows of `window` consecutive words of an item; an item with
fewer words is one phrase. An item is near a document if its rarest word occurs
there with each of its other words within `slop` words of it. Test items are taken
in blocks of at most about ITEM_BYTES, all of them against the same index; only one
block is on an executor at a time, and what they find is brought together by a
number that each document row has in the index, so the size of the benchmark has
no effect on results.

Defined results: a null or empty text has no words, no hits and isn't
contaminated; an item without words, or with a null item_id, is left out; items
that share an item_id count as one. Empty tables: no documents give no rows, no
items no hits. Repeated documents are judged each. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import ALNUM, LOWER, Texts, arrow_map, pick, stored, word_hashes, words

WINDOW, SLOP = 13, 64
ITEM_BYTES = 16 << 20
BLOCK_BYTES = 1 << 19
INDEX = "rows array<long>, doc_ids array<long>, first binary, terms binary, ends binary, positions binary"


def _split(column):
    for _, _, data, offsets in Texts(column).chunks(BLOCK_BYTES):
        data = LOWER[data]
        starts, ends, first = words(data, offsets, ALNUM)
        yield data, starts, ends, first, word_hashes(data, starts, ends)


def _flat(sets) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all sets, one set after the other, and where each begins (and one more)."""
    return np.array([x for s in sets for x in sorted(s)], np.int64), np.cumsum([0, *map(len, sets)])


class Items:
    """The phrases of a block of test items, over numbered terms."""

    def __init__(self, rows: list[tuple[int, str]], window: int):
        column = pa.array([r[1] for r in rows], pa.string())
        number: dict[int, int] = {}
        self.terms: list[bytes] = []
        phrases: dict[tuple[int, ...], set[int]] = {}
        words_of: dict[int, set[int]] = {}
        done = 0
        for data, starts, ends, first, h in _split(column):
            raw = data.tobytes()
            ids = []
            for a, z, x in zip(starts, ends, h.tolist(), strict=True):
                if x not in number:
                    number[x] = len(number)
                    self.terms.append(raw[a:z])
                elif self.terms[number[x]] != raw[a:z]:
                    raise ValueError("two terms share a hash")
                ids.append(number[x])
            for k in range(len(first) - 1):
                of = ids[first[k] : first[k + 1]]
                item = rows[done + k][0]
                if of:
                    words_of.setdefault(item, set()).update(of)
                for at in range(max(1, len(of) - window + 1) if of else 0):
                    phrases.setdefault(tuple(of[at : at + window]), set()).add(item)
            done += len(first) - 1
        self.hashes = np.array(list(number), np.uint64)
        # phrases as rows of term numbers, short ones filled up with their first term, and the items of each; items and their terms
        self.size = np.array([len(p) for p in phrases], np.int32)
        most = int(self.size.max(initial=1))
        self.table = np.array([p + (p[0],) * (most - len(p)) for p in phrases], np.int32).reshape(-1, most)
        self.of, self.of_at = _flat(phrases.values())
        self.items = np.array(list(words_of), np.int64)
        self.item_terms, self.item_at = _flat(words_of.values())

    def ranked(self, count: np.ndarray) -> np.ndarray:
        """The place of each term from rare to common; ties by the word, so it is the same whatever the block of items."""
        rank = np.zeros(len(count), np.int64)
        rank[sorted(range(len(count)), key=lambda t: (count[t], self.terms[t]))] = np.arange(len(count))
        return rank


def build_index(documents: DataFrame) -> DataFrame:
    """The index of (row, doc_id, text) as a DataFrame of blocks."""

    def work(batch):
        done = 0
        for _, _, first, h in ((x[1], x[2], x[3], x[4]) for x in _split(batch["text"])):
            order = np.argsort(h, kind="stable")
            terms, begin = np.unique(h[order], return_index=True)
            n = len(first) - 1
            yield {
                "rows": [batch["row"].slice(done, n).to_pylist()], "doc_ids": [batch["doc_id"].slice(done, n).to_pylist()], "first": [first.astype("<i8").tobytes()],
                "terms": [terms.astype("<u8").tobytes()], "ends": [np.append(begin[1:], len(order))[: len(terms)].astype("<u4").tobytes()], "positions": [order.astype("<u4").tobytes()],
            }
            done += n

    numbered = pick(documents, "doc_id", "text").withColumn("row", F.monotonically_increasing_id())  # stored with the block
    return arrow_map(numbered, work, INDEX)


class Postings:
    """The posting lists of some terms in one block."""

    def __init__(self, terms: bytes, ends: bytes, positions: bytes, hashes: np.ndarray):
        self.positions = np.frombuffer(positions, "<u4").astype(np.int64)
        terms, ends = np.frombuffer(terms, "<u8"), np.concatenate(([0], np.frombuffer(ends, "<u4").astype(np.int64)))
        k = np.minimum(np.searchsorted(terms, hashes), max(0, len(terms) - 1))
        there = terms[k] == hashes if len(terms) else np.zeros(len(hashes), bool)
        self.begin, self.end = (np.where(there, ends[k], 0), np.where(there, ends[k + 1], 0)) if len(terms) else (k * 0, k * 0)
        self.count = self.end - self.begin

    def of(self, term: int) -> np.ndarray:
        return self.positions[self.begin[term] : self.end[term]]

    def phrase(self, terms: tuple[int, ...], rarity: np.ndarray) -> np.ndarray:
        """Positions of the first word of each occurrence: offset-adjusted lists, intersected from the rarest term."""
        order = sorted(range(len(terms)), key=lambda k: (rarity[terms[k]], k))
        found = self.of(terms[order[0]]) - order[0]
        for k in order[1:]:
            if not len(found):
                break
            other = self.of(terms[k])
            at = np.minimum(np.searchsorted(other, found + k), len(other) - 1)
            found = found[other[at] == found + k] if len(other) else found[:0]
        return found

    def near(self, terms: list[int], rarity: np.ndarray, slop: int, first: np.ndarray) -> np.ndarray:
        """Documents (their places in the block) where the rarest term has every other term within slop words of it."""
        apart = lambda at: at + (slop + 1) * (np.searchsorted(first, at, "right") - 1)  # noqa: E731  documents don't reach into each other
        order = sorted(terms, key=lambda t: rarity[t])
        found = self.of(order[0])
        moved = apart(found)
        for t in order[1:]:
            if not len(found):
                break
            other = apart(self.of(t))
            good = np.searchsorted(other, moved + slop, "right") > np.searchsorted(other, moved - slop)
            found, moved = found[good], moved[good]
        return np.unique(np.searchsorted(first, found, "right") - 1)


def matches(index: DataFrame, items, slop: int = SLOP) -> DataFrame:
    """For each document: its row number, n_words, hit spans (in words), items with an occurring phrase and items that are near."""
    spark = index.sparkSession

    def counted(batch):
        total = np.zeros(len(items.value.hashes), np.int64)
        for terms, ends in zip(batch["terms"].to_pylist(), batch["ends"].to_pylist(), strict=True):
            total += Postings(terms, ends, b"", items.value.hashes).count
        at = np.flatnonzero(total)
        yield {"term": at, "n": total[at]}

    count = np.zeros(len(items.value.hashes), np.int64)
    for r in arrow_map(index.select("terms", "ends"), counted, "term long, n long").groupBy("term").agg(F.sum("n")).collect():  # terms of the items only
        count[r[0]] = r[1]
    rarity = spark.sparkContext.broadcast(items.value.ranked(count))

    def work(batch):
        rare, test = rarity.value, items.value
        for k in range(batch.num_rows):
            block = {n: batch[n][k].as_py() for n in batch.schema.names}
            post = Postings(block["terms"], block["ends"], block["positions"], test.hashes)
            first, n = np.frombuffer(block["first"], "<i8"), len(block["rows"])
            spans: list[list] = [[] for _ in range(n)]
            found: list[set] = [set() for _ in range(n)]
            close: list[set] = [set() for _ in range(n)]
            for p in np.flatnonzero((post.count[test.table] > 0).all(1)) if len(test.table) else ():
                terms, of = tuple(test.table[p][: test.size[p]].tolist()), test.of[test.of_at[p] : test.of_at[p + 1]].tolist()
                at = post.phrase(terms, rare)
                doc = np.searchsorted(first, at, "right") - 1
                for d, a in zip(doc.tolist(), at.tolist(), strict=True):
                    if a >= 0 and a + len(terms) <= first[d + 1]:
                        spans[d].append({"start": a - first[d], "end": a - first[d] + len(terms)})
                        found[d].update(of)
            for w in np.flatnonzero(np.minimum.reduceat(post.count[test.item_terms], test.item_at[:-1]) > 0) if len(test.items) else ():
                for d in post.near(test.item_terms[test.item_at[w] : test.item_at[w + 1]].tolist(), rare, slop, first).tolist():
                    close[d].add(int(test.items[w]))
            yield {"row": block["rows"], "doc_id": block["doc_ids"], "n_words": np.diff(first), "spans": [sorted(x, key=lambda s: (s["start"], s["end"])) for x in spans], "items": [sorted(x) for x in found], "near_items": [sorted(x) for x in close]}

    return arrow_map(index, work, "row long, doc_id long, n_words long, spans array<struct<start long, end long>>, items array<long>, near_items array<long>")


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """matches() of all test items for each document, without the row number."""
    spark = documents.sparkSession
    test = pick(benchmark, "item_id", "text").dropna()
    size = test.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    blocks = max(1, -(-size // ITEM_BYTES))
    # no two blocks are alike, and a reader holds a row group of them at a time
    index = stored(build_index(documents), "postings", **{"parquet.enable.dictionary": "false", "parquet.block.size": str(4 << 20)})
    out = None
    for k in range(blocks):
        part = test.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else test
        items = spark.sparkContext.broadcast(Items([tuple(r) for r in part.orderBy("item_id", "text").collect()], window))  # about ITEM_BYTES
        found = matches(index, items, slop)
        out = found if out is None else out.unionByName(found)
    if blocks > 1:
        flat = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(n)))).alias(n) for n in ("spans", "items", "near_items")]
        out = out.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *flat)
    return out.drop("row")


def judged(found: DataFrame) -> DataFrame:
    """The contract's columns from decontaminate()'s, and the number of items that are near. JVM functions alone, so a task has one Python worker."""
    # spans come sorted: a span adds what of it lies beyond the ends of those before
    nothing = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("upto"))
    grown = lambda m, s: F.struct((m["hit"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], m["upto"]))).alias("hit"), F.greatest(m["upto"], s["end"]).alias("upto"))
    out = found.select(
        "doc_id", "n_words", F.aggregate("spans", nothing, grown, lambda m: m["hit"]).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string")))), 256).alias("items_sha256"), F.size("near_items").cast("long").alias("n_near_items"),
    )
    return out.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def op4_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return judged(decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
