"""Importance resampling towards a target distribution.

Texts become counts of hashed n-grams. The gain of a bucket is the logarithm of how much more of
the target than of the documents falls into it; a document's weight is the sum of the gains of its
n-grams. A Gumbel variable, drawn from a hash of the id, makes the documents of highest weight
plus noise a sample without replacement in proportion to their importance.

N-grams are interned per batch of 128 KiB: an open-addressed NumPy table, keyed by XXH64 and
verified byte by byte, holds each different n-gram once with its bucket and its count, so that
CRC-32 is computed once per different n-gram and every occurrence is a slot number. The slots'
counts make the corpus counts; the slots' gains, gathered by occurrence, make the weights. A text of
any length is read in pieces, each behind the last two words of the one before.
"""

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripledger.llm.order import ranked
from tripledger.llm.text import byte_texts
from tripledger.sources.workdir import materialize

GRAMS = 3
PIECE = 1 << 17  # bytes interned together

# XXH64's primes: fixed values of its definition
P1, P2, P3, P4, P5 = (
    np.uint64(11400714785074694791),
    np.uint64(14029467366897019727),
    np.uint64(1609587929392839161),
    np.uint64(9650029242287828579),
    np.uint64(2870177450012600261),
)
#: Keeps a-z, 0-9 and bytes of other alphabets, lowers A-Z, and makes a blank of anything else.
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
SHORT = 32  # bytes; XXH64 takes longer strings by another rule, and they are hashed one by one


def _crc_tables() -> np.ndarray:
    """Row k: what a byte does to CRC-32 (reflected polynomial EDB88320) k bytes later."""
    row = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        row = np.where(row & 1, (row >> 1) ^ np.uint32(0xEDB88320), row >> 1)
    rows = [row]
    for _ in range(7):
        rows.append(rows[0][rows[-1] & 255] ^ (rows[-1] >> 8))
    return np.array(rows)


CRC = _crc_tables()


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


class Strings:
    """Slices of one byte buffer."""

    def __init__(self, data: bytes, start: np.ndarray, size: np.ndarray):
        self.data, self.start, self.size = data, start, size
        padded = data + bytes(SHORT + 8)
        # the eight bytes from every place on
        self.lanes = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,)).copy()

    def lane(self, rows: np.ndarray, j: int) -> np.ndarray:
        """Bytes 8j to 8j + 7 of some strings, zero beyond their ends."""
        return self.lanes[self.start[rows] + 8 * j] & MASKS[np.clip(self.size[rows] - 8 * j, 0, 8)]

    def bytes(self, row: int) -> bytes:
        return self.data[self.start[row] : self.start[row] + self.size[row]]

    def hashes(self) -> np.ndarray:
        """XXH64 with seed 0 of every string."""
        out = np.empty(len(self.start), dtype=np.uint64)
        long = self.size >= SHORT
        for i in np.flatnonzero(long):
            out[i] = xxhash.xxh64_intdigest(self.bytes(i))
        rows = np.flatnonzero(~long)
        start, size = self.start[rows], self.size[rows]
        h = P5 + size.astype(np.uint64)
        full = size >> 3
        for j in range(int(full.max(initial=0))):
            lane = _rotate(self.lanes[start + 8 * j] * P2, 31) * P1
            h = np.where(full > j, _rotate(h ^ lane, 27) * P1 + P4, h)
        at, rest = start + 8 * full, size & 7
        tail = self.lanes[at] & MASKS[rest]
        half = rest >= 4
        h = np.where(half, _rotate(h ^ ((tail & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3, h)
        tail, rest = np.where(half, tail >> np.uint64(32), tail), rest & 3
        for j in range(3):
            byte = (tail >> np.uint64(8 * j)) & np.uint64(255)
            h = np.where(rest > j, _rotate(h ^ (byte * P5), 11) * P1, h)
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        out[rows] = h ^ (h >> np.uint64(32))
        return out

    def crcs(self, rows: np.ndarray) -> np.ndarray:
        """CRC-32 of some strings: eight bytes at a time, then the rest one by one."""
        out = np.empty(len(rows), dtype=np.uint32)
        long = self.size[rows] >= SHORT
        out[long] = [zlib.crc32(self.bytes(i)) for i in rows[long]]
        rows = rows[~long]
        start, size = self.start[rows], self.size[rows]
        c, full = np.full(len(rows), 0xFFFFFFFF, dtype=np.uint32), size >> 3
        for j in range(int(full.max(initial=0))):
            live = np.flatnonzero(full > j)
            lane = self.lanes[start[live] + 8 * j]
            low, high = lane.astype(np.uint32) ^ c[live], (lane >> np.uint64(32)).astype(np.uint32)
            c[live] = (
                CRC[7][low & 255] ^ CRC[6][(low >> 8) & 255] ^ CRC[5][(low >> 16) & 255] ^ CRC[4][low >> 24]
                ^ CRC[3][high & 255] ^ CRC[2][(high >> 8) & 255] ^ CRC[1][(high >> 16) & 255] ^ CRC[0][high >> 24]
            )
        tail, rest = self.lanes[start + 8 * full], size & 7
        half = np.flatnonzero(rest >= 4)
        word = tail[half].astype(np.uint32) ^ c[half]
        c[half] = CRC[3][word & 255] ^ CRC[2][(word >> 8) & 255] ^ CRC[1][(word >> 16) & 255] ^ CRC[0][word >> 24]
        tail[half] >>= np.uint64(32)
        tail, rest = tail.astype(np.uint32), rest & 3
        for j in range(3):
            live = np.flatnonzero(rest > j)
            c[live] = CRC[0][(c[live] ^ (tail[live] >> (8 * j))) & 255] ^ (c[live] >> 8)
        out[~long] = ~c
        return out

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether strings a and b hold the same bytes, pair by pair."""
        found = self.size[a] == self.size[b]
        check = np.flatnonzero(found & (a != b))
        j = 0
        while len(check) and j < 8:
            equal = self.lane(a[check], j) == self.lane(b[check], j)
            found[check[~equal]] = False
            j += 1
            check = check[equal]
            check = check[self.size[a[check]] > 8 * j]
        for i in check:
            found[i] = self.bytes(a[i]) == self.bytes(b[i])
        return found


class Interned:
    """An open-addressed table of the different strings: `slot` of every occurrence; per slot
    `owner` (an occurrence of its string, -1 if empty), `count` and `bucket`."""

    def __init__(self, strings: Strings, buckets: int, hashes: np.ndarray | None = None):
        keys = strings.hashes() if hashes is None else hashes
        n = len(keys)
        room = 1 << max(1, (2 * n - 1).bit_length()) if n else 2
        self.owner = np.full(room, -1, dtype=np.int64)
        self.slot = np.empty(n, dtype=np.int64)
        place = (keys & np.uint64(room - 1)).astype(np.int64)
        waiting = np.arange(n)
        while len(waiting):
            at = place[waiting]
            free = self.owner[at] < 0
            # of those that want a free slot, one gets it; equal strings always wait together
            self.owner[at[free]] = waiting[free]
            holder = self.owner[at]
            hit = keys[holder] == keys[waiting]
            hit[hit] = strings.same(holder[hit], waiting[hit])
            self.slot[waiting[hit]] = at[hit]
            waiting = waiting[~hit]
            place[waiting] = (place[waiting] + 1) & (room - 1)
        self.count = np.bincount(self.slot, minlength=room)
        self.bucket = np.zeros(room, dtype=np.int64)
        used = np.flatnonzero(self.owner >= 0)
        self.bucket[used] = strings.crcs(self.owner[used]) % np.uint32(buckets)


def pieces(texts: Iterable[bytes], limit: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """(text number, words carried over, words) of all texts, cut at blanks after `limit` bytes."""
    for number, text in enumerate(texts):
        text, at, carried = text.translate(NORMAL), 0, []
        while True:
            end = text.find(b" ", at + limit)
            words = text[at : end if end >= 0 else len(text)].split()
            yield number, len(carried), carried + words
            if end < 0:
                break
            at, carried = end, (carried + words)[-(GRAMS - 1) :]


def batches(texts: Iterable[bytes], limit: int = PIECE) -> Iterator[tuple[np.ndarray, Strings]]:
    """(text number of each n-gram, the n-grams) for some pieces at a time.

    An n-gram is counted with its last word, so those that end in carried words are not repeated.
    """
    held, size = [], 0
    for piece in pieces(texts, limit):
        held.append(piece)
        size += sum(map(len, piece[2])) + len(piece[2])
        if size >= limit:
            yield _grams(held)
            held, size = [], 0
    if held:
        yield _grams(held)


def _grams(held: list[tuple[int, int, list[bytes]]]) -> tuple[np.ndarray, Strings]:
    data = b" ".join([b" ".join(words) for _, _, words in held if words])
    counts = np.array([len(words) for _, _, words in held], dtype=np.int64)
    n = int(counts.sum())
    blanks = np.flatnonzero(np.frombuffer(data, np.uint8) == 32) if n else np.empty(0, np.int64)
    ends = np.append(blanks, len(data))[:n]
    starts = np.append(0, blanks + 1)[:n]
    number = np.repeat(np.array([p[0] for p in held], dtype=np.int64), counts)
    place = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    new = place >= np.repeat(np.array([p[1] for p in held], dtype=np.int64), counts)
    text, start, size = [], [], []
    for k in range(GRAMS):
        last = np.flatnonzero(new & (place >= k))
        text.append(number[last])
        start.append(starts[last - k])
        size.append(ends[last] - starts[last - k])
    return np.concatenate(text), Strings(data, np.concatenate(start), np.concatenate(size))


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = 10000) -> DataFrame:
    """(bucket, n): how many n-grams of all texts fall into each bucket. Each task adds up its own
    rows, so at most `buckets` rows of a task are shuffled."""

    def count(rows):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in rows:
            for _, strings in batches(byte_texts(batch.column(0))):
                table = Interned(strings, buckets)
                total += np.bincount(table.bucket, table.count, buckets).astype(np.int64)  # exact below 2**53
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int32()), "n": pa.array(total[used], pa.int64())})

    return docs.select(text_col).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = 10000) -> np.ndarray:
    """The gain of each bucket: a thousand times the logarithm of its smoothed share in the target
    over that in docs, rounded down. Of each table at most `buckets` rows reach the driver."""
    s, t = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
    for counts, df in ((s, docs), (t, target)):
        for r in bucket_counts(df, text_col, buckets).collect():
            counts[r.bucket] = r.n
    all_s, all_t = int(s.sum()), int(t.sum())
    ratio = ((b + 1) * (all_s + buckets) / ((a + 1) * (all_t + buckets)) for a, b in zip(s.tolist(), t.tolist()))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], dtype=np.int64)


def weighed(text: Column, gain: np.ndarray) -> Column:
    """Struct (words, features, weight) of a text; zeros for a null text or one without words."""
    buckets = len(gain)
    kind = "struct<words:long,features:long,weight:long>"

    @F.arrow_udf(kind)
    def weigh(texts: pa.Array) -> pa.Array:
        n = len(texts)
        features, weight = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for number, strings in batches(byte_texts(texts)):
            table = Interned(strings, buckets)
            value = gain[table.bucket]  # of every slot
            features += np.bincount(number, minlength=n)
            weight += np.bincount(number, value[table.slot], n).astype(np.int64)
        # runs of 1, 2 and 3 words of n words: 3n - 3 from two words on
        words = np.where(features > 1, (features + GRAMS) // GRAMS, features)
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (words, features, weight)], ["words", "features", "weight"])

    return weigh(text)


def noise(key: Column, seed: int) -> Column:
    """A thousand times a Gumbel variable, rounded down, from a hash of seed and key."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(uniform))).cast("long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 5,
             least: int = 20, seed: int = 42, buckets: int = 10000) -> DataFrame:
    """id, n_features, weight, score and rank of every row of docs; repeated rows stay.

    Of the rows with `least` words or more, `percent` in a hundred (rounded down) are drawn: those
    of the highest scores, ties to the smaller id, null last. rank counts them from 1 and is null
    for the others. Null texts count as empty; a null id has the noise of the word null. Where either
    table is empty its shares are even.
    """
    gain = gains(docs, target, text_col, buckets)
    found = docs.select(F.col(id_col).alias("id"), weighed(F.col(text_col), gain).alias("x"))
    found = materialize(
        found.select(
            "id", "x.words", "x.features", "x.weight", (F.col("x.weight") + noise(F.col("id"), seed)).alias("score"),
            F.monotonically_increasing_id().alias("row"),  # stored here; tells equal rows apart
        ),
        "weights",
    )
    able = found.where(F.col("words") >= least)
    drawn = able.count() * percent // 100
    order = (F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row"))
    placed = ranked(able, [], order, "place", "scores")
    rest = found.where(F.col("words") < least).withColumn("place", F.lit(None).cast("long"))
    return placed.unionByName(rest).select(
        F.col("id").alias(id_col), F.col("features").alias("n_features"), "weight", "score",
        F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"),
    )
