"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a target: its share by weight of the wanted total, at most `epochs` times its
own size, the excess shared anew among the others. Whole repetitions of a source are taken
first. What is left of its target, the budget, is met by some of its documents:

1. documents are counted by exact length;
2. of every length the same fraction is taken, then one document more of as many lengths, from
   the longest down, as fit. This leaves less than the longest document;
3. a few long documents are put back, and a bounded-knapsack dynamic program over the lengths
   left, with their counts, finds a combination that meets the budget exactly, or comes closest
   from below;
4. of each length the chosen number of documents is taken in the order of a seeded hash.

Only counts by (source, length) are gathered. The dynamic program of a source gets at most one
row per length, and its table is as long as the remaining budget: a few longest documents.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripledger.llm.text import word_count
from tripledger.sources.workdir import materialize

BUCKET_BITS = 10
ROOM = 4  # the dynamic program gets a budget of so many longest documents at most, and one more
HELD = "__mixing_row"


def knapsack(lengths: list[int], counts: list[int], budget: int) -> dict[int, int]:
    """How many of each length to take for the greatest total up to the budget, which is the
    budget itself wherever that can be met.

    Sums are bits of one integer. For each sum the first length that reached it is kept, with
    how many of it; a sum it came from was reached earlier, so walking back never takes more
    than there are.
    """
    reached = 1
    mask = (1 << (budget + 1)) - 1
    by_length = np.full(budget + 1, -1, dtype=np.int32)
    copies = np.zeros(budget + 1, dtype=np.int32)
    for i, (length, count) in enumerate(zip(lengths, counts)):
        if length <= 0 or length > budget or count <= 0:
            continue
        if reached >> budget & 1:
            break
        front = reached  # sums whose last step was the k-th copy of this length
        for k in range(1, min(count, budget // length) + 1):
            front = (front << length) & mask & ~reached
            if not front:
                break
            reached |= front
            at = _bits(front, budget)
            by_length[at], copies[at] = i, k
    total, taken = reached.bit_length() - 1, {}
    while total > 0:
        i, k = int(by_length[total]), int(copies[total])
        taken[lengths[i]] = taken.get(lengths[i], 0) + k
        total -= k * lengths[i]
    return taken


def _bits(number: int, budget: int) -> np.ndarray:
    raw = np.frombuffer(number.to_bytes(budget // 8 + 1, "little"), dtype=np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), total: float = 1.5, epochs: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources in order of code points, null last, take the weights in turn. Capping is solved in
    closed form: sources by size per weight are capped from the smallest up, as long as the
    cap is under the level that the rest would get.
    """
    # one row per source, in one task: a window over as many rows as there are sources
    order = Window.orderBy(F.col("source").isNull(), "source")  # Spark compares code points
    turns = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.select("source", "source_size", F.element_at(turns, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).alias("weight"))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    upto = level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    s = s.withColumns(
        {
            "before": F.coalesce(F.sum("cap").over(upto), F.lit(0.0)),
            "open": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)),
            "budget": F.sum("source_size").over(whole) * F.lit(float(total)),
        }
    )
    # the level if this source and those after it were uncapped
    s = s.withColumn("rate", (F.col("budget") - F.col("before")) / F.col("open"))
    s = s.withColumn("fits", F.col("rate") * F.col("weight") <= F.col("cap"))
    # the first that fits has the highest rate of those that fit: a cap takes more than a share
    final = F.max(F.when(F.col("fits"), F.col("rate"))).over(whole)
    share = F.coalesce(final * F.col("weight"), F.col("cap"))
    return s.select("source", "source_size", F.least(share, F.col("cap")).alias("target"))


def _key(source: Column) -> Column:
    """A source as a key that is never null: null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _present(ids: Column) -> Column:
    return F.coalesce(ids.cast("string"), F.lit("null"))


def _pick(seed: int, ids: Column) -> Column:
    return F.xxhash64(F.lit(seed), F.coalesce(ids.cast("string"), F.lit("")))


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    """For one source: rows (key, size, n, budget) to (key, size, extra)."""
    pdf = pdf.sort_values("size", ascending=False, kind="stable")
    size, n = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    budget = int(pdf["budget"].iloc[0])
    held = int((size * n).sum())
    extra = np.zeros(len(size), dtype=np.int64)
    if budget > 0 and held > 0:
        if budget >= held:
            extra, budget = n.copy(), 0
        else:
            extra = np.array([int(c) * budget // held for c in n.tolist()], dtype=np.int64)
            budget -= int((size * extra).sum())
            for i in range(len(size)):  # one more of each length, longest first
                if extra[i] < n[i] and 0 < size[i] <= budget:
                    extra[i] += 1
                    budget -= int(size[i])
            for i in range(len(size)):  # room for the exact fit: some of the longest go back
                back = min(int(extra[i]), max(0, -(-(ROOM * int(size[0]) - budget) // int(size[i]))))
                extra[i] -= back
                budget += back * int(size[i])
            left = n - extra
            more = knapsack(size.tolist(), left.tolist(), budget)
            extra += np.array([more.get(s, 0) for s in size.tolist()], dtype=np.int64)
    return pd.DataFrame({"key": pdf["key"], "size": size, "extra": extra})


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         weights: tuple[float, ...] = (3, 1, 2), total: float = 1.5, epochs: int = 2, seed: int = 17) -> DataFrame:
    """Per row of docs: id, size, source, source_size, target, copies (0 to epochs).

    size is the number of words, 0 for a null text. Rows without words have no copies. A null
    source is a source of its own. Rows with the same id, source and size have the same place in
    the seeded order; which of them is taken makes no difference to the result. Reruns agree.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    rows = materialize(rows.withColumn("key", _key(F.col("source"))), "sizes")
    hist = materialize(rows.groupBy("key", "source", "size").agg(F.count("*").alias("n")), "lengths")
    sizes = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    # target words in whole: rounded down, so that no source exceeds its cap
    goal = targets(sizes, weights, total, epochs).withColumn("words", F.floor(F.col("target") + F.lit(1e-6)))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(F.lit(0))
    goal = goal.withColumn("full", full).withColumn("budget", F.col("words") - F.col("full") * F.col("source_size"))
    goal = materialize(goal.select(_key(F.col("source")).alias("key"), "source_size", "target", "full", "budget"), "targets")
    extra = materialize(
        hist.where("size > 0")
        .join(goal, "key")
        .select("key", "size", "n", "budget")
        .groupBy("key")
        .applyInPandas(_fit, "key string, size long, extra long"),
        "extra",
    )
    # the first `extra` documents of each length by seeded hash: ranks within buckets of the hash
    h = rows.withColumn("h", _pick(seed, F.col("id"))).withColumn("bucket", F.shiftrightunsigned("h", 64 - BUCKET_BITS))
    place = ["key", "size", "bucket"]
    before = Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = h.groupBy(*place).agg(F.count("*").alias("n")).withColumn("skip", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ranked = h.withColumn("rank", F.row_number().over(Window.partitionBy(*place).orderBy("h", "id")))
    placed = ranked.join(counts.select(*place, "skip"), place)
    out = placed.join(extra, ["key", "size"], "left").join(goal, "key")
    more = F.when(F.col("rank") + F.col("skip") <= F.coalesce("extra", F.lit(0)), 1).otherwise(0)
    copies = F.when(F.col("size") > 0, F.col("full") + more).otherwise(0)
    return out.select("id", "size", "source", "source_size", "target", copies.cast("int").alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Per row of docs: id, size, source_size, target, taken (words the mix takes)."""
    return plan(docs, id_col, **options).select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixture itself: every row of docs as often as the mix takes it, with all its columns.

    Rows that share id, source and size share out their copies in the order of their texts.
    """
    same = ["id", "key", "size"]
    share = plan(docs, id_col, text_col, source_col, **options).withColumn("key", _key(F.col("source")))
    share = share.withColumn("id", _present(F.col("id")))
    turn = Window.partitionBy(*same)
    share = share.select(*same, "copies", F.row_number().over(turn.orderBy(F.desc("copies"))).alias("i")).where("copies > 0")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    held = docs.withColumn(HELD, row).select(F.col(HELD).alias("row"))
    field = F.col("row").getField
    held = held.select(
        "row", _present(field(id_col)).alias("id"), _key(field(source_col)).alias("key"), word_count(field(text_col)).alias("size")
    ).where("size > 0")
    held = held.withColumn("i", F.row_number().over(turn.orderBy(field(text_col))))
    taken = held.join(share, [*same, "i"])
    return taken.select("row", F.explode(F.expr("array_repeat(0, copies)")).alias("copy")).select("row.*")
