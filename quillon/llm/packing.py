"""Best-fit packing of token sequences by exact-complement hashing.

Every document becomes its token ids and a closing id 0; only documents longer
than a sequence are cut. The plan needs just the histogram of piece lengths, at
most `size` entries however many documents there are. Planning takes lengths
from the longest down: a gap is filled exactly by one, two or three other lengths,
as many times as counts allow; what is left is placed by best fit, decreasing.
Single lengths and pairs are indexed by their sum (two million pairs at most);
triples are a single beside an indexed pair, since a table of their own would have
over a billion. Counts only fall, so a combination once passed over for want of
pieces is never looked at again. Each step uses up a length or a kind of gap, so
there are few steps. Pieces are then numbered within their length in
salted groups (no group grows with the commonness of a length) and look their
place up in the plan.

Defined results: a null or empty text is the closing id alone. Repeated rows are
packed each. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import LOWER, Texts, arrow_map, pick, stored, word_hashes, words

SIZE = 2048
CACHE_UNITS = 400_000  # of an Encoder: 12 MB
ROWS_PER_GROUP, MOST_GROUPS = 1000, 4096

#: What a tokenizer must encode unit by unit as it does whole, for parts() to be used.
PROBE = "The quick brown-fox, 12345 it's o'clock!? na\u00efve \u00fcber stra\u00dfe caf\u00e9s \u00c0\u00d8 x\u00d7y a\u00f7b 3.14 e-mail@host.org #tag $9.99 (a)[b]{c} \u6f22\u5b57 \u0440\u0443\u0441\n\tnew  line don't \u201cquoted\u201d ... a1b2 \u00b5m 50% <b>&amp; \u0130 \u017f"

_LETTER, _DIGIT, _OTHER, _SPACE = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[*b"abcdefghijklmnopqrstuvwxyz", 0xC3, *range(0x80, 0xC0)]] = _LETTER
_CLASS[[*b"0123456789"]] = _DIGIT
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_ODD = np.zeros(256, bool)  # ASCII that the rule of parts() doesn't cover: control characters and the apostrophe
_ODD[[*range(0x09), *range(0x0E, 0x20), 0x27, 0x7F]] = True


def parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The units that a lower-casing word tokenizer encodes each on its own: (bytes, starts, ends, first unit of each row, plain).

    A word of ASCII and of the letters U+00C0 to U+00FF falls into runs of letters, single digits and runs of other signs,
    lower-cased here. Any other word (other scripts, apostrophes, what may hold a special token) is one unit, unchanged.
    """
    low = LOWER[data]
    lead = np.zeros(len(data), bool)  # the byte before is 0xC3
    lead[1:] = low[:-1] == 0xC3
    low = np.where(lead & (low >= 0x80) & (low <= 0x9E) & (low != 0x97), low + 0x20, low).astype(np.uint8)
    odd = _ODD[data] | (low >= 0x80) & ~(lead & (low >= 0x9F) & (low <= 0xBF) & (low != 0xB7)) & (low != 0xC3)
    odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
    starts, ends, first = words(data, offsets, _CLASS != _SPACE)
    bad = np.flatnonzero(odd)
    strange = np.zeros(len(starts), bool)
    strange[np.searchsorted(starts, bad, "right") - 1] = True
    kind = _CLASS[low]
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    for k in np.flatnonzero(strange):
        low[starts[k] : ends[k]] = data[starts[k] : ends[k]]
        cut[starts[k] : ends[k]] = False
    cut[starts] = True
    begin = np.flatnonzero(cut[:-1] & (kind != _SPACE))
    word = np.searchsorted(starts, begin, "right") - 1
    end = np.append(begin[1:], len(data))
    end = np.minimum(end, ends[word]) if len(begin) else end[:0]
    return low, begin, end, np.searchsorted(begin, offsets), ~strange[word]


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + count[0] - 1, then those from start[1] on, and so on."""
    total = np.cumsum(count, dtype=np.int64)
    return np.repeat(start - total + count, count) + np.arange(total[-1] if len(total) else 0)


class Encoder:
    """Token ids of texts, from the ids of their units. Units seen are kept in arrays sorted by hash; this has no effect on results.

    Beyond CACHE_UNITS, those that weren't met again since the last such clearing go.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a unit
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        # of each unit: its hash, where its ids begin in self.ids, how many they are, and whether it was met again
        self.keys, self.start, self.size, self.again = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, bool)
        self.ids = np.zeros(0, "<u4")
        # whether the tokenizer treats units as parts() takes them; if not, texts are encoded whole
        self.by_units = True
        t = Texts(pa.array([PROBE, PROBE.upper(), PROBE.title()]))
        self.by_units = all(np.array_equal(a, b) for a, b in zip(self.encode(t.data, t.offsets), self._whole(t.data, t.offsets), strict=True))

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        ids = [self._one(raw[a:z]) for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
        return np.concatenate([np.zeros(0, "<u4"), *ids]), np.cumsum([0, *map(len, ids)])

    def _one(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, "<u4")

    def _units(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units, one unit after the other, and how many each has: plain ones are encoded together, with spaces between."""
        found: list[np.ndarray] = []
        size = np.zeros(len(begin), np.int32)
        order = np.argsort(~plain, kind="stable")  # plain ones first
        easy, hard = np.split(order, [int(plain.sum())])
        for lo in range(0, len(easy), 1000):
            part = easy[lo : lo + 1000]
            long = end[part] - begin[part]
            at = np.cumsum(long + 1) - long - 1
            line = np.full(at[-1] + long[-1], 0x20, np.uint8)
            line[spread(at, long)] = data[spread(begin[part], long)]
            ids = self._one(line.tobytes())
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(part):
                found.append(ids)
                size[part] = np.diff(ends, prepend=0)
            else:  # a tokenizer without such tokens
                for k in part:
                    found.append(self._one(data[begin[k] : end[k]].tobytes()))
                    size[k] = len(found[-1])
        for k in hard:
            found.append(self._one(data[begin[k] : end[k]].tobytes()))
            size[k] = len(found[-1])
        ids, start = np.concatenate(found), np.empty(len(size), np.int64)
        start[order] = np.cumsum(size[order]) - size[order]
        return ids[spread(start, size)], size

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows one after the other, and where each row's begin (and one more)."""
        if not self.by_units:
            return self._whole(data, offsets)
        low, begin, end, first, plain = parts(data, offsets)
        if not len(begin):
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
        hashes, at, unit = np.unique(word_hashes(low, begin, end), return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, hashes)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == hashes[known]
        self.again[place[known]] = True
        if not known.all():
            new, at = place[~known], at[~known]
            ids, size = self._units(low, begin[at], end[at], plain[at])
            start = len(self.ids) + np.cumsum(size) - size
            self.keys, self.start, self.size = np.insert(self.keys, new, hashes[~known]), np.insert(self.start, new, start), np.insert(self.size, new, size)
            self.again, self.ids = np.insert(self.again, new, False), np.concatenate((self.ids, ids))
            place = np.searchsorted(self.keys, hashes)
        count = self.size[place][unit]
        out = self.ids[spread(self.start[place][unit], count)]
        if len(self.keys) > CACHE_UNITS:
            self._clear()
        return out, np.concatenate(([0], np.cumsum(count, dtype=np.int64)))[first]

    def _clear(self) -> None:
        start, self.keys, self.size = self.start[self.again], self.keys[self.again], self.size[self.again]
        self.ids = self.ids[spread(start, self.size)]
        self.start, self.again = (np.cumsum(self.size) - self.size).astype(np.int32), np.zeros(len(self.keys), bool)


_encoders: dict[str, Encoder] = {}


def pieces(documents: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each document."""

    def work(batch):
        if tokenizer not in _encoders:
            _encoders[tokenizer] = Encoder(tokenizer)
        for i, _, data, offsets in Texts(batch["text"]).chunks():
            ids, at = _encoders[tokenizer].encode(data, offsets)
            raw = ids.tobytes()
            out = []
            for k, (a, z) in enumerate(zip((4 * at[:-1]).tolist(), (4 * at[1:]).tolist(), strict=True)):
                b = raw[a:z] + b"\0\0\0\0"
                for piece, x in enumerate(range(0, len(b), 4 * size)):
                    part = b[x : x + 4 * size]
                    out.append((i + k, piece, x // 4, len(part) // 4, zlib.crc32(part)))
            row, *rest = zip(*out, strict=True)
            yield dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), (batch["doc_id"].take(pa.array(row)), *rest), strict=True))

    return arrow_map(pick(documents, "doc_id", "text"), work, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences), which together use every counted piece once."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    done: list[tuple[tuple[int, ...], int]] = []

    def take(*lengths: int) -> bool:
        n = min(left[x] // lengths.count(x) for x in set(lengths))
        if n > 0:
            for x in lengths:
                left[x] -= n
            done.append((lengths, int(n)))
        return n > 0

    # the index of pair sums: pairs of a sum s are first[at[s] : at[s + 1]] and s less these, the longest first length first
    lengths = np.flatnonzero(left[:size])
    i, j = np.tril_indices(len(lengths))
    sums = lengths[i] + lengths[j]
    i, sums = i[sums < size], sums[sums < size]
    first = lengths[i[np.lexsort((-i, sums))]]
    at = np.concatenate(([0], np.cumsum(np.bincount(sums, minlength=size))))
    passed = at[:-1].copy()

    def pair(total: int, apart: np.ndarray) -> tuple[int, int] | None:
        """The pair of available lengths of this sum with the longest first length."""
        k = passed[total] if total > 0 else 0
        while total > 0 and k < at[total + 1]:
            x = int(first[k])
            y = total - x
            if apart[x] > 0 and apart[y] > (x == y):
                return x, y
            gone = left[x] < 1 or left[y] < 1 + (x == y)
            if gone and k == passed[total]:
                passed[total] += 1
            k += 1
        return None

    if left[size]:
        take(size)
    for longest in range(size - 1, 0, -1):
        gap = size - longest
        while left[longest]:
            if left[gap] and take(longest, gap):
                continue
            apart = left.copy()
            apart[longest] -= 1
            if (two := pair(gap, apart)) and take(longest, *two):
                continue
            for second in np.flatnonzero(apart[: gap - 1])[::-1]:
                apart[second] -= 1
                two = pair(gap - int(second), apart)
                apart[second] += 1
                if two and take(longest, int(second), *two):
                    break
            else:
                break
    # best fit, decreasing, of the rest: kinds of open sequences by gap
    kinds: dict[int, list[list]] = {}
    gaps: list[int] = []

    def put(lengths: tuple[int, ...], n: int) -> None:
        gap = size - sum(lengths)
        if gap not in kinds:
            kinds[gap] = []
            insort(gaps, gap)
        kinds[gap].append([lengths, n])

    for length in range(size, 0, -1):
        n = int(left[length])
        while n:
            k = bisect_left(gaps, length)
            if k == len(gaps):
                each = size // length
                if n >= each:
                    put((length,) * each, n // each)
                if n % each:
                    put((length,) * (n % each), 1)
                break
            gap = gaps[k]
            lengths, there = kinds[gap].pop()
            if not kinds[gap]:
                del kinds[gap], gaps[k]
            fit = gap // length
            full = min(there, n // fit)
            if full:
                put(lengths + (length,) * fit, full)
                n -= full * fit
                there -= full
            if there and 0 < n < fit:
                put(lengths + (length,) * n, 1)
                n, there = 0, there - 1
            if there:
                put(lengths, there)
    return done + [(lengths, n) for kind in kinds.values() for lengths, n in kind]


def _places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first number, first sequence, offset): the piece numbered k of a length has the place of the last row whose first number is at most k."""
    used: dict[int, int] = {}
    out: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for lengths, n in patterns:
        offset = 0
        for length in lengths:
            first = used.get(length, 0)
            out.setdefault(length, []).append((first, sequence, offset))
            used[length] = first + n
            offset += length
        sequence += n
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(documents: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """pieces() with sequence_id and offset added."""
    spark = documents.sparkSession
    cut = stored(pieces(documents, tokenizer, size), "pieces")
    rows = cut.count()
    groups = min(MOST_GROUPS, max(1, rows // ROWS_PER_GROUP))  # a length with a third of all pieces is dealt to as many groups
    salted = cut.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    counts = salted.groupBy("length", "_group").agg(F.count(F.lit(1)).alias("n"))
    lengths = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `size` rows
    places = spark.sparkContext.broadcast(_places(plan(lengths, size)))  # some rows for each length
    before = counts.select("length", "_group", (F.sum("n").over(Window.partitionBy("length").orderBy("_group")) - F.col("n")).alias("_before"))
    order = Window.partitionBy("length", "_group").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("_number", F.row_number().over(order) - 1).join(before, ["length", "_group"]).withColumn("_number", F.col("_number") + F.col("_before"))

    def work(batch):
        length, number = batch["length"].to_numpy(), batch["_number"].to_numpy()
        sequence, offset = np.empty_like(length), np.empty_like(length)
        for x in np.unique(length):
            at = np.flatnonzero(length == x)
            p = places.value[int(x)]
            k = np.searchsorted(p[:, 0], number[at], "right") - 1
            sequence[at], offset[at] = p[k, 1] + number[at] - p[k, 0], p[k, 2]
        yield {n: batch[n] for n in ("doc_id", "piece", "start", "length", "ids_crc32")} | {"sequence_id": sequence, "offset": offset}

    return arrow_map(numbered, work, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
