"""SimHash near-duplicates by multi-index hashing.

Every text gets a 64-bit fingerprint. Two fingerprints link at `bits` or fewer differing bits.
Fingerprints are cut into m segments; two that link differ in at most bits // m bits of one
segment at least, so probing each segment table with the small Hamming ball around one's own
segment finds every link. Copies share a fingerprint and are folded before the search.

Inside one bucket of a table, fingerprints are compared in blocks of numpy words, and only a
spanning forest of the links leaves the task. A bucket with more than `crowd` entries is not
compared pairwise: all its members enter the exact path for crowds, where two fingerprints are
tied if they share a point within half the distance (they do exactly if they link), so the work
per member is fixed however large the group is.
"""

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripledger.llm.components import components
from tripledger.llm.text import byte_texts
from tripledger.sources.workdir import materialize

SEED = 42
KEEP = "__simhash_row"
WIDTH = 64


def fingerprint_of(text: bytes, words: int) -> int:
    """The fingerprint of one text, as unsigned integer."""
    tokens = text.lower().split()  # on bytes: ASCII case and ASCII white space only
    if not tokens:
        return 0
    digest = xxhash.xxh64_intdigest
    ones, total = np.zeros(WIDTH, dtype=np.int64), max(1, len(tokens) - words + 1)
    for start in range(0, total, 65536):
        hashes = np.fromiter(
            (digest(b" ".join(tokens[i : i + words]), SEED) for i in range(start, min(total, start + 65536))),
            dtype="<u8",
        )
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, words: int = 4) -> Column:
    """64-bit SimHash of a text's word shingles, repeats included, as signed BIGINT."""

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint_of(t, words) for t in byte_texts(texts)), dtype=np.uint64, count=len(texts))
        return pa.array(found.view(np.int64), type=pa.int64())

    return simhash(text)


def segments_for(count: int, bits: int) -> int:
    """Number of segments: as many as keep a segment at least as wide as the logarithm of the
    number of fingerprints, so that a bucket holds about one. Any number finds all links."""
    wide = max(1, math.ceil(math.log2(max(count, 2))))
    return max(2, min(bits + 1, WIDTH // wide))


def _cuts(segments: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment."""
    edges = [round(i * WIDTH / segments) for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _ball(first: int, width: int, radius: int) -> np.ndarray:
    """All masks of 1 to radius bits within a segment."""
    masks = [
        sum(1 << (first + i) for i in chosen)
        for size in range(1, radius + 1)
        for chosen in itertools.combinations(range(width), size)
    ]
    return np.array(masks, dtype=np.uint64)


def _pieces(batch: pa.RecordBatch, rows: int):
    """The first column as unsigned numbers, so many rows at a time."""
    values = batch.column(0).to_numpy().view(np.uint64)
    return (values[i : i + rows] for i in range(0, len(values), rows))


def _batch(**columns) -> pa.RecordBatch:
    """A batch of the given columns; unsigned numbers go as signed ones of the same bits."""
    signed = {k: c.view(np.int64) if getattr(c, "dtype", None) == np.uint64 else c for k, c in columns.items()}
    return pa.RecordBatch.from_pydict(signed)


def _probes(segments: int, bits: int):
    """Rows (seg, value, near, fp): the table entry of a fingerprint (near = 0) and its probes
    (near = 1). Of two segments that differ, the one with the smaller value probes the other."""
    radius = bits // segments

    def expand(batches):
        cuts = [(f, w, _ball(f, w, radius)) for f, w in _cuts(segments)]
        for batch in batches:
            for piece in _pieces(batch, 2000):
                for number, (first, width, masks) in enumerate(cuts):
                    inside = np.uint64(((1 << width) - 1) << first)
                    own = piece & inside
                    near = own[:, None] ^ masks[None, :]
                    row, _ = np.nonzero(near > own[:, None])
                    values = np.concatenate([own, near[near > own[:, None]]])
                    yield _batch(
                        seg=np.full(len(values), number, np.int32),
                        value=values,
                        near=np.repeat(np.array([0, 1], np.int32), [len(own), len(row)]),
                        fp=np.concatenate([piece, piece[row]]),
                    )

    return expand


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) with the same components as the links (a, b)."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    apart = label != np.arange(len(nodes))
    return nodes[apart], nodes[label[apart]]


def _links(bits: int, crowd: int):
    """Compare within buckets. The rows of a task come sorted by bucket, entries before probes.

    Gives rows (u, v): a forest of the links; and (u, null): members of crowded buckets.
    Holds `crowd` entries and one batch at most.
    """
    empty = np.empty(0, np.uint64)

    def compare(batches):
        key, held, crowded = None, empty, False  # the bucket left open by the batch before
        for batch in batches:
            if not batch.num_rows:
                continue
            seg, value, near, fp = (column.to_numpy() for column in batch.columns)
            fp = fp.view(np.uint64)
            starts = np.flatnonzero(np.r_[True, (seg[1:] != seg[:-1]) | (value[1:] != value[:-1])])
            sizes = np.diff(np.r_[starts, len(fp)])
            out_a, out_b, members = [], [], []
            if (seg[0], value[0]) == key:  # goes on: compare with what is held first
                head = fp[: sizes[0]]
                if crowded:
                    members.append(head)
                else:
                    for s in range(0, len(head), 512):
                        x, y = np.nonzero(np.bitwise_count(head[s : s + 512, None] ^ held[None, :]) <= bits)
                        out_a.append(head[s : s + 512][x])
                        out_b.append(held[y])
            # within this batch: entry against every later row of its bucket, one distance at a time
            entry = near == 0
            entries = np.add.reduceat(entry.astype(np.int64), starts)
            before = len(held) if (seg[0], value[0]) == key else 0
            was = crowded and (seg[0], value[0]) == key
            full = entries > crowd
            full[0] = was or entries[0] + before > crowd
            if full[0] and not was and before:
                members.append(held)
            for g in np.flatnonzero(full):
                if not (g == 0 and was):
                    members.append(fp[starts[g] : starts[g] + sizes[g]])
            size_of = np.repeat(np.where(full | (entries == 0), 0, sizes), sizes)
            at = np.arange(len(fp)) - np.repeat(starts, sizes)
            alive = np.flatnonzero(entry & (size_of > 1))
            step = 1
            while len(alive):
                alive = alive[at[alive] + step < size_of[alive]]
                hit = alive[np.bitwise_count(fp[alive] ^ fp[alive + step]) <= bits]
                out_a.append(fp[hit])
                out_b.append(fp[hit + step])
                step += 1
            # the last bucket may go on in the next batch
            last, same = (seg[-1], value[-1]), (seg[-1], value[-1]) == key
            tail = fp[starts[-1] :][entry[starts[-1] :]]
            crowded = bool(full[-1])
            held = empty if crowded else np.concatenate([held, tail]) if same else tail
            key = last
            a, b = _forest(np.concatenate([*out_a, empty]), np.concatenate([*out_b, empty]))
            lone = np.unique(np.concatenate([*members, empty]))
            if len(a) or len(lone):
                alone = np.repeat([False, True], [len(b), len(lone)])
                yield _batch(u=np.concatenate([a, lone]), v=pa.array(np.concatenate([b, lone]).view(np.int64), mask=alone))

    return compare


def _points(bits: int):
    """(point, fp): every point within half the distance of a fingerprint. An odd distance is
    covered by balls of its larger half, checked by the caller's exact distance."""
    masks = np.concatenate([[np.uint64(0)], _ball(0, WIDTH, bits // 2)]).astype(np.uint64)

    def expand(batches):
        for batch in batches:
            for piece in _pieces(batch, 16):
                yield _batch(point=(piece[:, None] ^ masks[None, :]).ravel(), fp=np.repeat(piece, len(masks)))

    return expand


def links(fps: DataFrame, bits: int = 4, crowd: int = 2000, segments: int | None = None) -> DataFrame:
    """Edges (u, v) whose components are those of all links between the distinct fingerprints
    in column fp. bits is even, so that half of it is a whole radius for crowds."""
    if bits % 2:
        raise ValueError("the crowd path needs an even distance")
    fps = fps.where("fp is not null").select("fp").distinct()
    segments = segments or segments_for(fps.count(), bits)
    rows = fps.mapInArrow(_probes(segments, bits), "seg int, value long, near int, fp long")
    found = materialize(
        rows.repartition("seg", "value")
        .sortWithinPartitions("seg", "value", "near", "fp")
        .mapInArrow(_links(bits, crowd), "u long, v long"),
        "links",
    )
    members = found.where("v is null").select(F.col("u").alias("fp")).distinct()
    points = members.mapInArrow(_points(bits), "point long, fp long")
    lowest = points.groupBy("point").agg(F.min("fp").alias("v"))
    tied = points.withColumnRenamed("fp", "u").join(lowest, "point").where("u <> v").select("u", "v")
    return found.where("v is not null").unionByName(tied.distinct())


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 4,
            crowd: int = 2000, segments: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): rows has id and fp of each document, stored; groups has, for every
    distinct fp, root (smallest fp of its component, as signed number) and component_id.

    A null text has no words and fingerprint zero, linked like any other. component_id is the
    smallest non-null id of the component, null if it has none. Repeated rows are copies.
    """
    rows = materialize(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), words).alias("fp")), "simhash")
    first = rows.groupBy("fp").agg(F.min("id").alias("low"))
    roots = components(links(rows, bits, crowd, segments)).select(F.col("node").alias("fp"), "root")
    keyed = materialize(
        first.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "roots"
    )
    ids = keyed.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows, keyed.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4,
                    bits: int = 4, crowd: int = 2000) -> DataFrame:
    """One row per document: its id, fingerprint (16 hexadecimal digits) and component_id.

    Other columns of docs are ignored, whatever their names. An empty table gives no rows.
    """
    rows, groups = classes(docs, id_col, text_col, words, bits, crowd)
    return rows.join(groups, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 4,
             crowd: int = 2000) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest id stays.

    Null ids come last. Of several rows with that id in one component the one with the
    smallest text (null as empty) stays, and of equal texts one. All columns are returned.
    """
    rows, groups = classes(docs, id_col, text_col, words, bits, crowd)
    held = docs.withColumn(KEEP, F.struct(*[F.col(f"`{c}`") for c in docs.columns])).select(
        F.col(KEEP).alias("row"), F.col(KEEP).getField(id_col).alias("id")
    )
    chosen = rows.join(groups, "fp").where(F.col("id").eqNullSafe(F.col("component_id")))
    often = rows.groupBy("id").agg(F.count("*").alias("n"))
    stays = chosen.select("id").distinct().join(often.withColumnRenamed("id", "i"), F.col("id").eqNullSafe(F.col("i")))
    stays = materialize(stays.select("id", "n"), "stays")
    alone = held.join(
        stays.where("n = 1").select(F.col("id").alias("one")), F.col("id").eqNullSafe(F.col("one")), "left_semi"
    )
    # ids that several rows share: which of the rows is in the component shows in its text only
    tied = held.join(
        stays.where("n > 1").select(F.col("id").alias("one")), F.col("id").eqNullSafe(F.col("one")), "left_semi"
    )
    text = F.col("row").getField(text_col)
    marked = tied.withColumn("fp", fingerprint(text, words)).join(groups, "fp")
    picked = (
        marked.where(F.col("id").eqNullSafe(F.col("component_id")))
        .groupBy("root")
        .agg(F.min_by("row", F.coalesce(text, F.lit(""))).alias("row"))
    )
    return alone.select("row").unionByName(picked.select("row")).select("row.*")
