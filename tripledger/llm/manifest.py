"""Merkle manifest of a table: a leaf per row, a tree per group, a tree over the groups' roots.

A leaf's coordinate is its rank by id in its group, and no table is sorted to find it. Tasks gather
the ids of each group into compressed bitmaps of 65,536 neighbours (a list of 16-bit numbers where
they are few, bits where they are many); those of the same place are merged; running counts per
bitmap make the directory. Rank queries then add the directory's count to the number of bits set
below an id. Ids that stand on several rows keep their number of rows beside the bitmap.

With ranks as coordinates, every FAN neighbouring leaves are put into the slots of an array by
rank, whatever order they come in, and reduced LEVELS levels at once; the results are the next
leaves, until one is left. A leaf's proof is what its arrays, from the lowest up, have beside its
path. Digests are SHA-256, joined as lower-case hexadecimal text.
"""

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripledger.llm.order import ranked
from tripledger.sources.workdir import materialize

LEVELS = 10
FAN = 1 << LEVELS
LOW = 16  # bits of an id within its bitmap
DENSE = 4096  # from so many ids on, 8 KiB of bits are smaller than a list
HELD = 1 << 20  # ids that a task holds before it passes their bitmaps on


def digest(*parts: bytes) -> bytes:
    """SHA-256 of parts joined, as lower-case hexadecimal bytes."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


# Bitmaps. `extra` holds, for ids on several rows, pairs (low bits, rows beyond the first).


def pack(low: np.ndarray) -> bytes:
    """The compressed bitmap of some different 16-bit numbers."""
    if len(low) < DENSE:
        return np.sort(low).astype("<u2").tobytes()
    bits = np.zeros(1 << LOW, dtype=np.uint8)
    bits[low] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def words(data: bytes) -> np.ndarray:
    """A bitmap as 1,024 words of 64 bits."""
    if len(data) == 1 << (LOW - 3):
        return np.frombuffer(data, dtype="<u8")
    bits = np.zeros(1 << LOW, dtype=np.uint8)
    bits[np.frombuffer(data, dtype="<u2")] = 1
    return np.packbits(bits, bitorder="little").view("<u8")


class Ranks:
    """Rank queries on a bitmap: a directory of bits set before each word, and the words."""

    def __init__(self, data: bytes, extra: bytes):
        self.words = words(data)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])
        pairs = np.frombuffer(extra, dtype="<i8").reshape(-1, 2)
        self.extra = pairs[np.argsort(pairs[:, 0], kind="stable")]
        self.more = np.concatenate([[0], np.cumsum(self.extra[:, 1])])

    def members(self) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))

    def rank(self, low: np.ndarray) -> np.ndarray:
        """Rows whose id is under each of some 16-bit numbers."""
        word, bit = low >> 6, (low & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below).astype(np.int64) + self.more[np.searchsorted(self.extra[:, 0], low)]

    def rows(self, low: np.ndarray) -> np.ndarray:
        """Rows that each of some members stands on."""
        at = np.searchsorted(self.extra[:, 0], low)
        known = np.minimum(at, max(0, len(self.extra) - 1))
        hit = (self.extra[known, 0] == low) if len(self.extra) else np.zeros(len(low), dtype=bool)
        return 1 + np.where(hit, self.extra[known, 1] if len(self.extra) else 0, 0)


BITMAP = "grp binary, high long, bits binary, extra binary, rows long"


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[bytes, bytes, int]:
    """(bits, extra, rows) from (members, rows of each) of several bitmaps."""
    low = np.concatenate([p[0] for p in parts])
    members, place = np.unique(low, return_inverse=True)
    rows = np.bincount(place, np.concatenate([p[1] for p in parts])).astype(np.int64)
    often = rows > 1
    extra = np.column_stack([members[often], rows[often] - 1]).astype("<i8")
    return pack(members.astype(np.int64)), extra.tobytes(), int(rows.sum())


def _gather(batches):
    """Bitmaps of the ids that a task sees, (grp, id) in; null ids have the place null and no bits."""
    held, size = defaultdict(list), 0

    def flush():
        rows = []
        for (grp, high), low in held.items():
            if high is None:
                rows.append((grp, None, b"", b"", sum(low)))
            else:
                low = np.concatenate(low)
                rows.append((grp, high, *_merged([(low, np.ones(len(low), dtype=np.int64))])))
        held.clear()
        return _batch(rows, [pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int64()], ["grp", "high", "bits", "extra", "rows"])

    for batch in batches:
        grp, ids = batch.column("grp"), batch.column("id")
        codes = grp.dictionary_encode(null_encoding="encode")
        names, codes = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
        null = ids.is_null().to_numpy(zero_copy_only=False)
        values = ids.fill_null(0).to_numpy(zero_copy_only=False)
        for code, name in enumerate(names):
            own = codes == code
            if missing := int((own & null).sum()):
                held[name, None].append(missing)
            found = values[own & ~null]
            high = found >> LOW
            order = np.argsort(high, kind="stable")
            found, high = found[order], high[order]
            starts = np.flatnonzero(np.diff(high, prepend=high[:1] - 1)) if len(high) else []
            for place, low in zip(high[starts].tolist(), np.split(found & ((1 << LOW) - 1), starts[1:])):
                held[name, place].append(low)
        size += len(values)
        if size >= HELD:
            yield flush()
            size = 0
    yield flush()


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _merge(table: pa.Table) -> pa.Table:
    """One bitmap from all of the same group and place."""
    first = table.slice(0, 1).to_pylist()[0]
    if first["high"] is None:
        out = (first["grp"], None, b"", b"", sum(table.column("rows").to_pylist()))
    else:
        parts = []
        for bits, extra in zip(table.column("bits").to_pylist(), table.column("extra").to_pylist()):
            ranks = Ranks(bits, extra)
            parts.append((members := ranks.members(), ranks.rows(members)))
        out = (first["grp"], first["high"], *_merged(parts))
    batch = _batch([out], [pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int64()], ["grp", "high", "bits", "extra", "rows"])
    return pa.Table.from_batches([batch])


def directory(keys: DataFrame) -> DataFrame:
    """(grp, high, bits, extra, rows, before): the bitmaps of all ids of a group, and the number of
    its rows in lower ones. keys: grp (binary), id. Rows of null ids come first."""
    parts = keys.select("grp", "id").mapInArrow(_gather, BITMAP)
    bitmaps = materialize(parts.groupBy("grp", "high").applyInArrow(_merge, BITMAP), "bitmaps")
    # running counts: first of 1,024 neighbouring bitmaps each, then within
    order = F.col("high").asc_nulls_first()
    far = F.coalesce(F.shiftright("high", 10), F.lit(-(1 << 62)))
    counts = bitmaps.select("grp", "high", "rows", far.alias("far"))
    sums = counts.groupBy("grp", "far").agg(F.sum("rows").alias("rows"))
    upto = Window.partitionBy("grp").orderBy("far").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("grp").alias("g"), F.col("far").alias("f"), F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("first"))
    near = Window.partitionBy("grp", "far").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("near", F.coalesce(F.sum("rows").over(near), F.lit(0)))
    counts = counts.join(sums, F.col("grp").eqNullSafe(F.col("g")) & (F.col("far") == F.col("f")))
    counts = counts.select(F.col("grp").alias("g"), F.col("high").alias("h"), (F.col("first") + F.col("near")).alias("before"))
    same = F.col("grp").eqNullSafe(F.col("g")) & F.col("high").eqNullSafe(F.col("h"))
    return bitmaps.join(counts, same).select(*bitmaps.columns, "before")


def _query(batches):
    """(grp, id, rank, rows) of every id of each bitmap."""
    for batch in batches:
        for r in batch.to_pylist():
            if r["high"] is None:
                ids, rank, rows = [None], np.array([r["before"]]), np.array([r["rows"]])
            else:
                ranks = Ranks(r["bits"], r["extra"])
                low = ranks.members()
                ids, rank, rows = (r["high"] << LOW) + low, r["before"] + ranks.rank(low), ranks.rows(low)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["grp"]] * len(ids), pa.binary()), pa.array(ids, pa.int64()), pa.array(rank, pa.int64()), pa.array(rows, pa.int64())],
                ["grp", "id", "rank", "rows"],
            )


def coordinates(leaves: DataFrame) -> DataFrame:
    """leaves (grp, id, leaf and more) with `rank`, their place in their group by id from 0, null
    first; rows of the same id by their leaf."""
    found = directory(leaves).mapInArrow(_query, "grp binary, id long, rank long, rows long")
    found = found.select(F.col("grp").alias("g"), F.col("id").alias("i"), F.col("rank").alias("first"), "rows")
    same = F.col("grp").eqNullSafe(F.col("g")) & F.col("id").eqNullSafe(F.col("i"))
    placed = materialize(leaves.join(found, same).drop("g", "i"), "ranks")
    names = leaves.columns
    alone = placed.where("rows = 1").select(*names, F.col("first").alias("rank"))
    often = placed.where("rows > 1").withColumn("__row", F.monotonically_increasing_id())
    tied = ranked(often, ["grp", "id"], [F.col("leaf"), F.col("__row")], "tie", "ties")
    return alone.unionByName(tied.select(*names, (F.col("first") + F.col("tie")).alias("rank")))


NODE = "grp binary, block long, rank long, digest string, path binary"


def _reduce(table: pa.Table) -> pa.Table:
    """One array of slots: its leaves with the digests beside their paths, and its top.

    In: grp, block, rank, digest, size (of the level's group). Rows come in any order. The top's
    rank is null.
    """
    grp, block = table.column("grp")[0].as_py(), table.column("block")[0].as_py()
    total = table.column("size")[0].as_py()
    rank = table.column("rank").to_numpy()
    slot = (rank & (FAN - 1)).astype(np.int64)
    n = len(slot)
    level = np.empty(n, dtype="S64")
    level[slot] = np.array(table.column("digest").to_pylist(), dtype="S64")
    paths: list[list[bytes]] = [[] for _ in range(n)]
    at = np.arange(n)  # the node above each slot
    for _ in range(min(LEVELS, max(0, int(total - 1).bit_length()))):
        nodes = level.tolist()
        for i, node in enumerate(at.tolist()):
            if (beside := node ^ 1) < len(nodes):
                paths[i].append(bytes.fromhex(nodes[beside].decode()))
        level = np.array([digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)], dtype="S64")
        at >>= 1
    rows = [(grp, block, r, d, b"".join(paths[s])) for r, d, s in zip(rank.tolist(), table.column("digest").to_pylist(), slot.tolist())]
    rows.append((grp, block, None, level[0].decode(), b""))
    batch = _batch(rows, [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary()], ["grp", "block", "rank", "digest", "path"])
    return pa.Table.from_batches([batch])


def tree(nodes: DataFrame, sizes: DataFrame | None, largest: int) -> tuple[DataFrame, DataFrame]:
    """((grp, rank, path), (grp, root)) of nodes (grp, rank, digest), whose groups' sizes are
    (grp, size), `largest` the greatest of them. Without sizes there is one group.

    path: the digests beside a node's path to its root, 32 bytes each, from the lowest level up.
    """
    steps, level, left = [], nodes, largest
    while True:
        if sizes is None:
            rows = level.withColumn("size", F.lit(left).cast("long"))
        else:
            size = sizes.select(F.col("grp").alias("g"), F.expr(f"cast(ceil(size / {FAN ** len(steps)}D) as long)").alias("size"))
            rows = level.join(size, F.col("grp").eqNullSafe(F.col("g")))
        rows = rows.select("grp", F.shiftright("rank", LEVELS).alias("block"), "rank", "digest", "size")
        found = materialize(rows.groupBy("grp", "block").applyInArrow(_reduce, NODE), f"level{len(steps)}")
        steps.append(found.where("rank is not null").select("grp", "rank", "block", "path"))
        level = found.where("rank is null").select("grp", F.col("block").alias("rank"), "digest")
        if left <= FAN:
            break
        left = -(-left // FAN)
    # paths from the top down: each array's own path is that of its top
    above = steps[-1].select("grp", "rank", "path")
    for step in reversed(steps[:-1]):
        up = above.select(F.col("grp").alias("g"), F.col("rank").alias("r"), F.col("path").alias("rest"))
        same = F.col("grp").eqNullSafe(F.col("g")) & (F.col("block") == F.col("r"))
        above = step.join(up, same).select("grp", "rank", F.concat("path", "rest").alias("path"))
    return above, level.select("grp", F.col("digest").alias("root"))


def siblings(rank: int, size: int, path: bytes) -> list[tuple[bool, bytes | None]]:
    """For each level, whether the node beside lies on the left, and its digest as hexadecimal
    bytes, None where a node stands alone."""
    out, at = [], 0
    while size > 1:
        beside = None
        if (rank ^ 1) < size:
            beside, at = path[at : at + 32].hex().encode(), at + 32
        out.append((bool(rank & 1), beside))
        rank, size = rank >> 1, (size + 1) >> 1
    return out


def fold(leaf: bytes, steps: list[tuple[bool, bytes | None]]) -> bytes:
    """The root that a leaf and what lies beside its path make."""
    for left, beside in steps:
        leaf = digest(leaf) if beside is None else digest(beside, leaf) if left else digest(leaf, beside)
    return leaf


def _proof(rank: pa.Array, size: pa.Array, path: pa.Array, grank: pa.Array, gsize: pa.Array, gpath: pa.Array, leaf: pa.Array) -> pa.Array:
    proofs, roots = [], []
    columns = (x.to_pylist() for x in (rank, size, path, grank, gsize, gpath, leaf))
    for r, n, p, gr, gn, gp, own in zip(*columns):
        steps = siblings(r, n, p) + siblings(gr, gn, gp)
        proofs.append(digest(*(b for _, b in steps if b is not None)).decode())
        roots.append(fold(own.encode(), steps).decode())
    return pa.StructArray.from_arrays([pa.array(proofs, pa.string()), pa.array(roots, pa.string())], ["proof", "folded"])


PROOF = "struct<proof:string,folded:string>"


def leaf_of(values: list[Column]) -> Column:
    """SHA-256 of values, each as its number of UTF-8 bytes, a colon and itself, null as a dash."""
    def part(v: Column) -> Column:
        v = v.cast("string")
        return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))

    return F.sha2(F.concat(*map(part, values)), 256)


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
             tamper_col: str = "n_chars", tampered: Column | None = None) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of docs.

    leaf, subroot, root and proof_sha256 (of the digests beside the leaf's path up to the root,
    joined from the lowest level up) are those of docs. folded_root is what the row's proof makes of
    its leaf, where `tampered` holds of the leaf with 1 added to tamper_col; verified is whether
    that is the root. Null groups come first, then groups by their bytes; in a group null ids come
    first, and repeated ids by their leaf. An empty table has no rows.
    """
    tampered = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    changed = [(F.col(c) + 1 if c == tamper_col else F.col(c)) for c in fields]
    original = leaf_of([F.col(c) for c in fields])
    leaves = docs.select(
        F.col(group_col).cast("string").cast("binary").alias("grp"), F.col(id_col).cast("long").alias("id"),
        original.alias("leaf"), F.when(tampered, leaf_of(changed)).otherwise(original).alias("now"),
    )
    leaves = materialize(coordinates(materialize(leaves, "leaves")), "coordinates")
    sizes = materialize(leaves.groupBy("grp").agg(F.count("*").alias("size")), "groups")
    largest = sizes.agg(F.max("size")).first()[0]
    groups = sizes.count()
    paths, subroots = tree(leaves.select("grp", "rank", F.col("leaf").alias("digest")), sizes, largest or 1)
    # the same again over the groups, as the leaves of one group
    one = F.lit(b"").alias("grp")
    tops = ranked(subroots, [], [F.col("grp").asc_nulls_first()], "grank", "subroots")
    above, root = tree(tops.select(one, F.col("grank").alias("rank"), F.col("root").alias("digest")), None, groups or 1)
    above = above.select(F.col("rank").alias("r"), F.col("path").alias("gpath"))
    tops = tops.join(sizes.withColumnRenamed("grp", "s"), F.col("grp").eqNullSafe(F.col("s"))).join(above, F.col("grank") == F.col("r"))
    tops = materialize(tops.select(F.col("grp").alias("t"), F.col("root").alias("subroot"), "grank", "size", "gpath"), "tops")
    whole = root.first()  # of one group, so one row at most
    whole = F.lit(whole.root if whole else None).cast("string")
    rows = leaves.join(paths.select(F.col("grp").alias("g"), F.col("rank").alias("r"), "path"), F.col("grp").eqNullSafe(F.col("g")) & (F.col("rank") == F.col("r")))
    rows = rows.join(tops, F.col("grp").eqNullSafe(F.col("t")))
    checked = F.arrow_udf(_proof, PROOF)("rank", "size", "path", "grank", F.lit(groups).cast("long"), "gpath", "now")
    rows = rows.select("id", "leaf", "subroot", whole.alias("root"), checked.alias("x"))
    return rows.select(
        F.col("id").alias(id_col), "leaf", "subroot", "root", F.col("x.proof").alias("proof_sha256"),
        F.col("x.folded").alias("folded_root"), (F.col("x.folded") == F.col("root")).alias("verified"),
    )
