"""MinHash near-duplicates by an LSH forest, confirmed on full shingle sets.

1. Every text becomes its set of distinct shingles, a MinHash signature of
   TREES x DEPTH values and a hash of the whole set. Texts with equal sets are one
   class from here on, stood for by their smallest doc_id.
2. The forest: each class is in TREES sorted orders, one for each group of DEPTH
   signature values. An order is range-partitioned, so no prefix is gathered in
   one task. Neighbours with a common prefix of at least MIN_PREFIX values are
   candidates. Depth adapts to the region: where a prefix has at most REGION
   classes all its pairs are candidates; where it has more, longer prefixes are
   asked for, and where even those are crowded the next NEXT classes of an order
   that differs from tree to tree. All classes of a region that is crowded at
   MIN_PREFIX values are remembered for step 5.
3. A candidate is a link if 100 * |A and B| >= threshold * |A or B|, on the sets
   themselves, made again from the texts. First one candidate for each class, the
   one that most trees agree on; then, of the others, those whose ends aren't yet
   in one component. What is left out can't change any component.
4. Components by alternating large-star and small-star steps.
5. Crowded regions whose classes aren't in one component by then: their classes meet
   by an exact similarity join. Shingles are ordered from rare to common; two sets
   that are similar enough share one among the first of both, as many as a set may
   lack, so classes meet on those alone. Common passages come last in that order and
   bring nothing together. Pairs within a component are never made, and bits of the
   sets rule out nearly all others before texts are read.

So a pair is found if it has a common prefix of 4 in one of the 24 trees, crowded or
not: at a similarity of 0.85 with a probability above 0.9999999.

Defined results: a null text, an empty text or one without words has an empty set,
links with nothing and is its own component; a row with a null doc_id links with
nothing, has a null component and is kept. doc_id is a document's identity:
repeated rows of an id are one document (their texts' shingles count for the row
they are in, all get the id's component). An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import LOWER, NOT_SPACE, Texts, U, arrow_map, dropped, mixed, pick, squeezed, stored, unsqueezed, word_hashes, words

SHINGLE, THRESHOLD = 3, 85
TREES, DEPTH, MIN_PREFIX = 24, 6, 4
REGION, NEXT = 12, 2
ROWS_PER_RANGE = 1000  # of an order, at least, in a range partition: only adjacent ones meet
BUCKETS = 1 << 18  # counters by which shingles are ordered from rare to common
MAPS = 16  # longs of bits that stand for a set: the top 4 bits of a hash choose one
_SEEDS = mixed(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * U(0xD6E8FEB86659FD93)) | U(1)


def shingle_sets(texts: Texts, k: int = SHINGLE):
    """(first row, row after the last, hashes, ends): for each chunk of rows their sets' hashes, sorted within each row."""
    for i, j, data, offsets in texts.chunks():
        data = LOWER[data]
        starts, ends, first = words(data, offsets, NOT_SPACE)
        h = word_hashes(data, starts, ends)
        n = np.diff(first)
        take = np.where(n > 0, np.maximum(1, n - k + 1), 0)
        row = np.repeat(np.arange(j - i), take)
        at = np.arange(len(row)) - np.repeat(np.cumsum(take) - take, take) + first[:-1][row]
        last = first[1:][row]
        s = np.full(len(row), 0x2545F4914F6CDD1D, np.uint64)
        for step in range(k):
            s = mixed(s * U(0x9FB21C651E98DF25) + np.where(at + step < last, h[np.minimum(at + step, max(0, len(h) - 1))], U(step)))
        order = np.lexsort((s, row))
        s, row = s[order], row[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
        s, row = s[new], row[new]
        yield i, j, s, np.searchsorted(row, np.arange(j - i), "right")


def signatures(documents: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, set_hash and signature of each row; an empty set has neither hash nor signature."""

    def work(batch):
        for i, j, s, ends in shingle_sets(Texts(batch["text"]), k):
            begin = np.concatenate(([0], ends[:-1])).astype(np.int64)
            n = ends - begin
            full = np.flatnonzero(n)
            sig = np.zeros((j - i, TREES * DEPTH), np.uint32)
            whole = np.zeros((2, j - i), np.uint64)
            if len(full):
                for c, seed in enumerate(_SEEDS):
                    x = s * seed
                    sig[full, c] = np.minimum.reduceat(x ^ (x >> U(29)), begin[full]) >> U(24)
                for c in (0, 1):
                    whole[c, full] = np.add.reduceat(mixed(s + _SEEDS[c]), begin[full])
            raw = sig.astype(">u4").tobytes()
            wide, both = 4 * TREES * DEPTH, whole.T.astype(">u8").tobytes()
            yield {
                "doc_id": batch["doc_id"].slice(i, j - i), "n_shingles": n, "set_hash": [both[16 * r : 16 * r + 16] if n[r] else None for r in range(j - i)],
                "signature": [raw[wide * r : wide * r + wide] if n[r] else None for r in range(j - i)],
            }

    return arrow_map(pick(documents, "doc_id", "text"), work, "doc_id long, n_shingles long, set_hash binary, signature binary")


def _pairs(keys: np.ndarray, ids: np.ndarray, out: list) -> np.ndarray:
    """Candidates among rows sorted by key (uint32 values: tree, then its signature values); returns the rows in regions crowded at MIN_PREFIX values."""
    n = len(ids)
    if n < 2:
        return np.zeros(0, np.int64)
    same = np.logical_and.accumulate(keys[1:] == keys[:-1], axis=1).sum(1) - 1  # common prefix with the row before; -1: another tree
    depth = np.full(n, DEPTH + 1)  # the shortest prefix from MIN_PREFIX whose region is small enough
    crowded = np.zeros(0, np.int64)
    for d in range(MIN_PREFIX, DEPTH + 1):
        cut = np.concatenate(([True], same < d))
        region = np.cumsum(cut) - 1
        size = np.bincount(region)[region]
        depth = np.where((depth > DEPTH) & (size <= REGION), d, depth)
        if d == MIN_PREFIX:
            crowded = np.flatnonzero(size > REGION)
    low = same.copy()
    for step in range(1, min(REGION, n)):
        if step > 1:
            low = np.minimum(low[:-1], same[step - 1 :])
        a, b = np.arange(n - step), np.arange(step, n)
        near = low >= np.minimum(depth[a], depth[b])
        if step <= NEXT:
            near |= low >= MIN_PREFIX
        if not (low >= MIN_PREFIX).any():
            break
        k = np.flatnonzero(near)
        out.append((np.minimum(ids[k], ids[k + step]), np.maximum(ids[k], ids[k + step])))
    return crowded


def candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, trees) of classes (doc_id, signature) with a < b that the forest brings together, and the rows (doc_id, tree, key) of crowded regions, whose key is MIN_PREFIX values."""
    spark = classes.sparkSession
    width = 4 * DEPTH
    trees = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.substring("signature", t * width + 1, F.lit(width)).alias("key")))
    rows = classes.select("doc_id", F.explode(trees).alias("t")).select("doc_id", "t.tree", "t.key", F.xxhash64("doc_id", "t.tree").alias("turn"))
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), classes.count() * TREES // ROWS_PER_RANGE))
    rows = rows.repartitionByRange(parts, "tree", "key", "turn").sortWithinPartitions("tree", "key", "turn")

    def run(batches):
        """Pairs within the partition, and its first and last rows, so that neighbours in two partitions meet later."""
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        tail = None
        head: list[pa.RecordBatch] = []
        for batch in batches:
            batch = batch.select(["doc_id", "tree", "key"])
            head.append(batch) if sum(b.num_rows for b in head) < REGION else None
            table = pa.Table.from_batches([*([tail] if tail is not None else []), batch]).combine_chunks()
            both = table.to_batches()[0] if table.num_rows else batch
            yield from _emit(both)
            tail = both.slice(max(0, both.num_rows - REGION))
        for at, rows in ((part, pa.Table.from_batches(head).slice(0, REGION)) if head else (part, None), (part + 1, tail)):
            if rows is not None and rows.num_rows:
                n = rows.num_rows
                yield pa.RecordBatch.from_pydict({"a": rows["doc_id"].to_pylist(), "b": [None] * n, "edge": [at] * n, "tree": rows["tree"].to_pylist(), "key": rows["key"].to_pylist()}, schema=made)

    made = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("edge", pa.int64()), ("tree", pa.int32()), ("key", pa.binary())])

    def keys_of(tree, key) -> np.ndarray:
        n = len(tree)
        values = np.frombuffer(b"".join(key), ">u4").reshape(n, DEPTH).astype(np.uint32)
        return np.column_stack((np.asarray(tree, np.uint32), values))

    def _emit(batch):
        out: list = []
        none = pa.nulls
        crowd = _pairs(keys_of(batch["tree"].to_numpy(), batch["key"].to_pylist()), batch["doc_id"].to_numpy(), out)
        if out:
            a, b = (np.concatenate(x) for x in zip(*out, strict=True))
            n = len(a)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none(n, pa.int64()), none(n, pa.int32()), none(n, pa.binary())], schema=made)
        if len(crowd):
            rows, n = batch.take(pa.array(crowd)), len(crowd)
            yield pa.RecordBatch.from_arrays([rows["doc_id"], none(n, pa.int64()), pa.array(np.full(n, -1)), rows["tree"], rows["key"]], schema=made)

    found = stored(rows.mapInArrow(run, "a long, b long, edge long, tree int, key binary"), "forest")

    def across(table):
        table = table.sort_by([("tree", "ascending"), ("key", "ascending"), ("a", "ascending")]).combine_chunks()
        out: list = []
        crowd = _pairs(keys_of(table["tree"].to_numpy(), table["key"].to_pylist()), table["a"].to_numpy(), out)
        a, b = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
        n = len(a)
        pairs = pa.Table.from_arrays([pa.array(a), pa.array(b), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=met)
        rows = table.take(pa.array(crowd))
        return pa.concat_tables([pairs, pa.table([rows["a"], pa.nulls(len(crowd), pa.int64()), rows["tree"], rows["key"]], schema=met)])

    met = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("tree", pa.int32()), ("key", pa.binary())])
    edges = found.filter("edge >= 0").groupBy("edge").applyInArrow(across, "a long, b long, tree int, key binary")  # a few rows for each partition
    pairs = found.filter("edge is null").select("a", "b").unionByName(edges.filter("b is not null").select("a", "b")).filter("a < b")
    crowded = found.filter("edge = -1").select("a", "tree", "key").unionByName(edges.filter("b is null").select("a", "tree", "key"))
    crowded = crowded.select("a", "tree", F.substring("key", 1, 4 * MIN_PREFIX).alias("key")).distinct()
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("trees")), crowded.withColumnRenamed("a", "doc_id")


def _rarity(sets: DataFrame, k: int) -> np.ndarray:
    """How many shingles of the sets (z, size) fall into each of BUCKETS counters."""

    def work(batch):
        total = np.zeros(BUCKETS, np.int64)
        for _, _, s, _ in shingle_sets(unsqueezed(batch["z"], batch["size"]), k):
            total += np.bincount((s >> U(46)).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield {"bucket": at, "n": total[at]}

    counts = np.zeros(BUCKETS, np.int64)
    for r in arrow_map(sets.select("z", "size"), work, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():  # BUCKETS rows at most
        counts[r[0]] = r[1]
    return counts


def _first_shingles(sets: DataFrame, threshold: int, k: int) -> DataFrame:
    """token, doc_id, part, n and m0 .. m15 for the rarest shingles of each set (doc_id, part, z, size), as many as a set at the threshold may lack, and one more.

    The maps are 1024 bits, each the parity of the shingles that hash to it: two sets differ in at least as many shingles as their bits do.
    """
    rarity = sets.sparkSession.sparkContext.broadcast(_rarity(sets, k))  # 2 MB

    def work(batch):
        for i, j, s, ends in shingle_sets(unsqueezed(batch["z"], batch["size"]), k):
            begin = np.concatenate(([0], ends[:-1])).astype(np.int64)
            n = ends - begin
            row = np.repeat(np.arange(j - i), n)
            maps = np.zeros((j - i, MAPS), np.uint64)
            np.bitwise_xor.at(maps, (row, (s >> U(60)).astype(np.int64)), U(1) << ((s >> U(54)) & U(63)))
            often = rarity.value[(s >> U(46)).astype(np.int64)]
            order = np.lexsort((s, often, row))
            place = np.arange(len(s)) - begin[row]
            at = np.flatnonzero((place < (n + (-threshold * n) // 100 + 1)[row]) & (often[order] > 1))  # alone in its counter, it is in no other set
            for lo in range(0, len(at), 100_000):
                some = at[lo : lo + 100_000]
                of = row[some]
                yield {"token": s[order[some]].view(np.int64), "n": n[of], "doc_id": batch["doc_id"].to_numpy()[i + of], "part": batch["part"].to_numpy()[i + of]} | {f"m{c}": maps[of, c].view(np.int64) for c in range(MAPS)}

    return arrow_map(sets, work, "token long, n long, doc_id long, part long, " + ", ".join(f"m{c} long" for c in range(MAPS)))


def unsettled(crowded: DataFrame, joined: DataFrame, texts: DataFrame, threshold: int = THRESHOLD, k: int = SHINGLE, salts: int = 32) -> DataFrame:
    """Pairs (a, b) of classes from crowded regions that aren't in one component (joined) yet: all of them that can be links.

    Pairs within a component are never made: on a shingle, only the classes outside the component that most
    of its classes are in meet the others. Rows of a region or shingle are dealt over `salts` tasks.
    """
    salted = lambda df: df.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    rows = salted(crowded.join(joined, "doc_id", "left").select("doc_id", "tree", "key", F.coalesce("component_id", "doc_id").alias("part")))
    parted = rows.groupBy("tree", "key").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low != high").select("tree", "key", every)
    ids = stored(rows.join(parted, ["tree", "key", "salt"], "left_semi").select("doc_id", "part").distinct(), "crowded")
    if ids.isEmpty():
        return crowded.sparkSession.createDataFrame([], "a long, b long")
    sets = stored(texts.join(ids, "doc_id").select("doc_id", "part", "z", "size"), "sets")
    first = stored(salted(_first_shingles(sets, threshold, k)), "shingles")
    per = first.groupBy("token", "part").agg(F.count(F.lit(1)).alias("rows"))
    top = per.groupBy("token").agg(F.max(F.struct("rows", "part")).alias("most"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").select("token", F.col("most.part").alias("top"), every)
    first = stored(first.join(top, ["token", "salt"]), "shingles")
    few = first.filter("part != top").select("token", F.col("doc_id").alias("x"), F.col("part").alias("part_x"), F.col("n").alias("n_x"), *[F.col(f"m{c}").alias(f"x{c}") for c in range(MAPS)], every)
    differ = " + ".join(f"bit_count(m{c} ^ x{c})" for c in range(MAPS))
    able = f"part != part_x and (part = top or x < doc_id) and 100 * least(n, n_x) >= {threshold} * greatest(n, n_x) and 100 * (n + n_x - ({differ})) >= {threshold} * (n + n_x + ({differ}))"
    met = few.join(first, ["token", "salt"]).filter(able)
    return met.select(F.least("x", "doc_id").alias("a"), F.greatest("x", "doc_id").alias("b")).distinct()


def texts_of(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, z, size of the documents that occur in pairs."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = squeezed(pick(documents, "doc_id", "text").filter("doc_id is not null")).join(ends.hint("merge"), "doc_id", "left_semi")
    return stored(texts.groupBy("doc_id").agg(F.min(F.struct("size", "z")).alias("t")).select("doc_id", "t.*"), "texts")


def links(pairs: DataFrame, texts: DataFrame, threshold: int = THRESHOLD, k: int = SHINGLE) -> DataFrame:
    """Of pairs (a, b), those whose full shingle sets are similar enough; texts from texts_of()."""
    named = lambda x: texts.select(F.col("doc_id").alias(x), F.col("z").alias(f"z_{x}"), F.col("size").alias(f"size_{x}"))
    both = pairs.select("a", "b").hint("merge").join(named("a"), "a").hint("merge").join(named("b"), "b")

    def work(batch):
        for lo in range(0, batch.num_rows, 500):
            yield judged(batch.slice(lo, 500))

    def judged(batch):
        n = batch.num_rows
        sets = []
        for x in "ab":
            row, value, size = [], [], np.zeros(n, np.int64)
            for i, j, s, ends in shingle_sets(unsqueezed(batch[f"z_{x}"], batch[f"size_{x}"]), k):
                size[i:j] = np.diff(np.concatenate(([0], ends)))
                row.append(np.repeat(np.arange(i, j), size[i:j])), value.append(s)
            sets.append((np.concatenate(row), np.concatenate(value), size))
        (row_a, a, n_a), (row_b, b, n_b) = sets
        row, value = np.concatenate((row_a, row_b)), np.concatenate((a, b))
        order = np.lexsort((value, row))
        row, value = row[order], value[order]
        twice = (row[1:] == row[:-1]) & (value[1:] == value[:-1])
        common = np.bincount(row[1:][twice], minlength=n)
        good = (100 * common >= threshold * (n_a + n_b - common)) & (common > 0)
        return {"a": batch["a"].to_numpy()[good], "b": batch["b"].to_numpy()[good]}

    return arrow_map(both, work, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, component_id) of every end of edges (a, b): the smallest id reachable. Large-star and small-star steps until nothing changes."""
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())
    edges = stored(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    before = mark(edges)
    while before[0]:
        # large star: every larger neighbour of a node is linked to the smallest of its neighbours and itself
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a != b").distinct()
        # small star: a node and its smaller neighbours are linked to the smallest
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select("m", F.explode(F.array("a", "b")).alias("v")).select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a != b").distinct()
        new = stored(small, "edges")
        now = mark(new)
        dropped(edges)
        edges = new
        if now == before:
            break
        before = now
    return edges.select(F.col("b").alias("doc_id"), F.col("a").alias("component_id")).unionByName(edges.select(F.col("a").alias("doc_id"), F.col("a").alias("component_id")).distinct())


def near_duplicates(documents: DataFrame, threshold: int = THRESHOLD, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row."""
    signed = stored(signatures(documents, k), "signatures")
    classes = stored(signed.filter("set_hash is not null and doc_id is not null").groupBy("set_hash").agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles")), "classes")
    pairs, crowded = candidates(classes.select("doc_id", "signature"))
    pairs, crowded = stored(pairs, "pairs"), stored(crowded, "crowded")
    # one candidate for each class first, the one most trees agree on
    best = pairs.groupBy("b").agg(F.max(F.struct(F.col("trees"), (-F.col("a")).alias("minus"))).alias("best")).select((-F.col("best.minus")).alias("a"), "b")
    texts = texts_of(pairs, documents)
    first = stored(links(best, texts, threshold, k), "links")
    joined = components(first)
    named = lambda end: joined.select(F.col("doc_id").alias(end), F.col("component_id").alias(f"of_{end}"))
    rest = pairs.join(best, ["a", "b"], "left_anti").join(named("a"), "a", "left").join(named("b"), "b", "left")
    rest = stored(rest.filter("coalesce(of_a, a) != coalesce(of_b, b)").select("a", "b"), "rest")
    if not rest.isEmpty():
        first = stored(first.unionByName(links(rest, texts, threshold, k)), "links")
        joined = components(first)
    more = stored(unsettled(crowded, joined, texts, threshold, k).join(pairs, ["a", "b"], "left_anti"), "more")
    if not more.isEmpty():
        joined = components(first.unionByName(links(more, texts, threshold, k)))
    of_class = classes.select("set_hash", F.col("doc_id").alias("class_id")).join(joined.withColumnRenamed("doc_id", "class_id"), "class_id", "left")
    of_class = of_class.select("set_hash", F.coalesce("component_id", "class_id").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "set_hash").join(of_class, "set_hash", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op9_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
