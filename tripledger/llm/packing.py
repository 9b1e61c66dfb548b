"""Best-fit packing into sequences of several permitted lengths.

A document longer than the longest permitted length is cut into pieces of that length and a
rest. Pieces are dealt to shards of bounded size by a hash; each shard is packed on its own,
so bins never span shards, and a shard of tens of thousands of pieces wastes no more than its
last open bins. Within a shard pieces go from long to short into the open bin they fill best;
where none has room a bin of the least-cost length opens: least cost per word it will hold,
which is its whole length as long as enough words remain, else what remains. That is done with
bins up to each permitted length in turn, and with bins of that one length; the packing of least
total cost wins. In the end each bin is cut down to the shortest permitted length that holds
its contents.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripledger.llm.text import word_count
from tripledger.sources.workdir import materialize

LENGTHS = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 32  # what a sequence costs besides its positions: start, end, one more row to load
SHARD = 50_000


def cost(length: int, overhead: float = OVERHEAD) -> float:
    """Of one sequence: its positions, filled or not, and a fixed part."""
    return length + overhead


def opening(size: int, remaining: int, lengths: list[int], overhead: float) -> int:
    """The length to open for a piece: least cost per word among those that hold it. A bin can
    be filled as long as words remain; the shorter length wins a tie."""
    fit = [c for c in lengths if c >= size]
    return min(fit, key=lambda c: (cost(c, overhead) / min(c, max(remaining, size)), c))


def best_fit(sizes: np.ndarray, lengths: list[int], overhead: float = OVERHEAD, opens: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, length of the bin) for pieces sorted from long to short, none over the
    longest length. opens: the lengths a bin may open with, all unless given. Of bins with equal
    room the one that got it last is filled first."""
    opens = opens or lengths
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    rooms: dict[int, list[int]] = {}  # open bins by room, latest first
    has, used, opened, remaining = 0, [], [], int(sizes.sum())
    for i, size in enumerate(sizes.tolist()):
        above = has >> size
        if above:  # the least room that holds the piece
            room = size + ((above & -above).bit_length() - 1)
            which = rooms[room].pop()
            if not rooms[room]:
                has ^= 1 << room
        else:
            room = opening(size, remaining, opens, overhead)
            which = len(used)
            used.append(0)
            opened.append(room)
        bins[i], offsets[i] = which, used[which]
        used[which] += size
        remaining -= size
        left = room - size
        if left:
            rooms.setdefault(left, []).append(which)
            has |= 1 << left
    final = np.array(lengths)[np.searchsorted(lengths, used)] if used else np.empty(0, np.int64)
    return bins, offsets, final


def pack_pieces(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS, overhead: float = OVERHEAD):
    """best_fit with bins opened up to each permitted length, and at that length only, in turn;
    the cheapest result."""
    lengths, results = sorted(lengths), []
    longest = int(sizes.max(initial=0))
    for top in range(len(lengths)):
        if lengths[top] >= longest:
            for opens in (lengths[: top + 1], [lengths[top]]):
                found = best_fit(sizes, lengths, overhead, opens)
                results.append((sum(cost(c, overhead) for c in found[2].tolist()), len(results), found))
    return min(results, key=lambda r: r[:2])[2]


def _shard(lengths: tuple[int, ...], overhead: float):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "h", "piece", "row"], ascending=[False, True, True, True], kind="stable")
        bins, offsets, final = pack_pieces(pdf["length"].to_numpy(np.int64), lengths, overhead)
        first = int(pdf["shard"].iloc[0]) << 32
        return pd.DataFrame(
            {"id": pdf["id"], "piece": pdf["piece"], "start": pdf["start"], "length": pdf["length"],
             "bin_id": pd.array(bins + first, dtype="Int64"), "capacity": pd.array(final[bins], dtype="Int64"), "at": pd.array(offsets, dtype="Int64")}
        )

    return pack


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = LENGTHS,
         overhead: float = OVERHEAD, shard: int = SHARD, size: Column | None = None) -> DataFrame:
    """One row per piece: id, piece (from 0), start (its first word in the document), length,
    bin_id, capacity (of its bin) and offset (its first place there).

    size: tokens of a row, words unless given. A document without tokens has one piece of length
    0 in no bin: bin_id, capacity and offset are null. Repeated rows are packed as often as they
    stand there. Other columns are ignored, whatever their names. Shards hold about `shard`
    pieces; the hash that deals them takes the row's place in the stored sizes, so that rows
    with equal ids spread too.
    """
    longest = max(lengths)
    sizes = word_count(F.col(text_col)) if size is None else F.coalesce(size.cast("long"), F.lit(0))
    rows = materialize(docs.select(F.col(id_col).alias("id"), sizes.alias("size")), "sizes")
    parts = F.ceil(F.col("size") / longest)
    pieces = rows.where("size > 0").withColumn("row", F.monotonically_increasing_id())
    count = rows.where("size > 0").agg(F.sum(parts)).first()[0] or 0
    shards = max(1, -(-int(count) // shard))
    pieces = pieces.select("id", "size", "row", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("piece"))
    pieces = pieces.select(
        "id", "row", "piece", (F.col("piece") * longest).alias("start"),
        F.least(F.lit(longest).cast("long"), F.col("size") - F.col("piece") * longest).alias("length"),
        F.xxhash64("row", "piece").alias("h"),
    ).withColumn("shard", F.pmod("h", F.lit(shards)))
    kind = dict(rows.dtypes)["id"]
    packed = pieces.groupBy("shard").applyInPandas(
        _shard(tuple(lengths), overhead),
        f"id {kind}, piece long, start long, length long, bin_id long, capacity long, at long",
    )
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    bare = rows.where("size = 0").select(
        "id", zero.alias("piece"), zero.alias("start"), zero.alias("length"),
        none.alias("bin_id"), none.alias("capacity"), none.alias("at"),
    )
    return packed.unionByName(bare).withColumnsRenamed({"id": id_col, "at": "offset"})
