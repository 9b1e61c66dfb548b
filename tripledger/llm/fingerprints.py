"""Homomorphic fingerprints of documents as multisets of paragraphs. DataFrame functions only.

A paragraph is a line that holds a word. Each is hashed into a wide vector, and a document's
fingerprint is the sum of its paragraphs' vectors, lane by lane modulo 2**32. The order of paragraphs
therefore does not matter, and paragraphs are inserted or deleted by adding or subtracting their
vectors, without reading the rest of the text.

The vector has two parts. The first, eight lanes, is the paragraph's SHA-256: these sums are equal
for equal multisets and, but for chance, for no others. The second serves likeness: a paragraph's
blocks of three words, counted from its start, each add a bit to 128 lanes, and one more counts
the blocks. Taken as signs, the bits make the squared difference of two sums an estimate of how
many blocks the documents do not share: a likeness from 0 to 1 with an error of about 0.09, and
exactly 1 for equal multisets alone.

A fingerprint is a row of long columns: `digest0` to `digest7`, `blocks`, and `sums0` to `sums63`
with two lanes each. Sums are plain aggregates, so generated code adds them up.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGEST = [f"digest{i}" for i in range(8)]
SUMS = [f"sums{i}" for i in range(64)]
PRINT = [*DIGEST, "blocks", *SUMS]
BLOCK = r"(?:[^\x20\x09-\x0D]++[\x20\x09\x0B-\x0D]*+){1,3}"
PAIR = 0x0000000100000001
LANE = 0xFFFFFFFF
KNOTS = 32  # places where the spread of ids is measured
GROUP = 512  # neighbours that are compared together, where that makes at most GROUPS groups
GROUPS = 100_000


def fingerprints(docs: DataFrame, keys: Sequence[str], text: Column) -> DataFrame:
    """keys and the fingerprint of the texts of each group of rows, as one text. Without words all
    lanes are zero. No shuffle where docs is partitioned by some of the keys."""
    lines = docs.select(*keys, F.explode_outer(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("__line"))
    lines = lines.withColumn("__hash", F.sha2("__line", 256))
    found = lines.select(*keys, "__hash", F.posexplode_outer(F.regexp_extract_all("__line", F.lit(BLOCK), F.lit(0))).alias("__at", "__block"))
    trimmed = F.rtrim("__block")
    found = found.select(*keys, "__hash", "__at", F.xxhash64(trimmed).alias("__a"), F.xxhash64(F.lit(1), trimmed).alias("__b"), "__block")
    # a line's digest counts once, with its first block; lines without words have none
    digit = lambda i: F.conv(F.substring("__hash", 8 * i + 1, 8), 16, 10).cast("long")
    once = [F.sum(F.when(F.col("__at") == 0, digit(i))) for i in range(len(DIGEST))]
    # two hashes have the 128 bits of a block; every sum takes two of them
    half = len(SUMS) // 2
    bit = lambda i: F.shiftrightunsigned("__a" if i < half else "__b", i % half).bitwiseAND(F.lit(PAIR))
    sums = [F.sum(F.when(F.col("__block").isNotNull(), bit(i))) for i in range(len(SUMS))]
    out = found.groupBy(*keys).agg(
        *(F.coalesce(x, F.lit(0)).bitwiseAND(F.lit(LANE)).alias(n) for x, n in zip(once, DIGEST)),
        F.count("__block").alias("blocks"),
        *(F.coalesce(x, F.lit(0)).alias(n) for x, n in zip(sums, SUMS)),
    )
    return out


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(LANE))


def _high(x: Column) -> Column:
    return F.shiftrightunsigned(x, 32)


def merge(prints: DataFrame, keys: Sequence[str], sign: str | None = None) -> DataFrame:
    """Per keys the sum of fingerprints; rows whose column `sign` is -1 are subtracted.

    A document whose paragraphs change is its stored fingerprint with those of the paragraphs put
    in (1) and taken out (-1), in any order.
    """
    s = F.col(sign) if sign else F.lit(1)
    lane = lambda x: F.sum(s * x).bitwiseAND(F.lit(LANE))
    pair = lambda n: F.shiftleft(lane(_high(F.col(n))), 32).bitwiseOR(lane(_low(F.col(n))))
    return prints.groupBy(*keys).agg(
        *(lane(F.col(n)).alias(n) for n in DIGEST), F.sum(s * F.col("blocks")).alias("blocks"), *(pair(n).alias(n) for n in SUMS)
    )


def signs(a: str = "") -> Column:
    """The 128 signed lanes of a fingerprint: bits that are set less those that are not. `a` stands
    before its columns' names."""
    n = F.col(a + "blocks")
    return F.array(*[(2 * half(F.col(a + s)) - n).cast("double") for s in SUMS for half in (_low, _high)])


def square(lanes: Column) -> Column:
    return F.aggregate(lanes, F.lit(0.0), lambda total, x: total + x * x)


def likeness(equal: Column, a: Column, b: Column, a2: Column, b2: Column) -> Column:
    """Estimated share of blocks that two documents have in common, of the mean of their numbers
    of blocks; 1 for equal fingerprints alone. a, b: their `signs`; a2, b2: the squares of these."""
    near = 1 - square(F.zip_with(a, b, lambda x, y: x - y)) / F.greatest(a2 + b2, F.lit(1.0))
    return F.when(equal, F.lit(1.0)).otherwise(F.least(F.greatest(near, F.lit(0.0)), F.lit(0.999)))


def as_text(a: str = "") -> Column:
    """A fingerprint as hexadecimal digits: eight for each lane of the digest and the number of
    blocks, then four for each other lane, which are modulo 2**16 here."""
    wide = [F.lpad(F.lower(F.hex(_low(F.col(a + n)))), 8, "0") for n in [*DIGEST, "blocks"]]
    short = lambda x: F.shiftleft(_high(x).bitwiseAND(F.lit(0xFFFF)), 16).bitwiseOR(x.bitwiseAND(F.lit(0xFFFF)))
    return F.array_join(F.array(*wide, *(F.lpad(F.lower(F.hex(short(F.col(a + n)))), 8, "0") for n in SUMS)), "")


def _grouping(ids: DataFrame) -> Column:
    """The number of the group that column `id` falls into, which grows with it: about GROUP
    neighbouring ids. Between KNOTS quantiles, groups are of equal width. Null ids are group -1."""
    rows = ids.count()
    groups = max(1, min(GROUPS, rows // GROUP))
    knots = ids.approxQuantile("id", [i / KNOTS for i in range(KNOTS + 1)], 0.25 / KNOTS) if rows else []
    knots = sorted(set(knots))
    each = max(1, groups // max(1, len(knots) - 1))

    if len(knots) < 2:
        return F.when(F.col("id").isNull(), F.lit(-1)).otherwise(F.lit(0)).cast("long")

    def between(lo: int, hi: int) -> Column:  # the last knot at or under the id
        if hi - lo == 1:
            return F.lit(lo)
        middle = (lo + hi) // 2
        return F.when(F.col("id") >= F.lit(knots[middle]), between(middle, hi)).otherwise(between(lo, middle))

    at = between(0, len(knots) - 1)
    start = F.get(F.array(*map(F.lit, knots)), at)
    width = F.get(F.array(*(F.lit(b - a) for a, b in zip(knots, knots[1:]))), at)
    within = F.least(F.greatest(F.floor((F.col("id") - start) / width * each), F.lit(0)), F.lit(each - 1))
    return F.when(F.col("id").isNull(), F.lit(-1).cast("long")).otherwise((at * each + within).cast("long"))


def edit_and_compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every
    row of docs; repeated rows stay.

    The edited text has its last floor(n_chars / 2) characters replaced by as many of the next
    document's first (or all of them). Next is the row of the next smaller id, null last, rows of
    equal id by a hash of their texts; the first row follows the last. Null texts count as empty.

    Texts are shuffled once, by groups of neighbouring ids, and all else happens there: a group
    also gets the first row of the group after it. Groups sort and spill like any window; a group
    grows beyond GROUP rows where ids repeat.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    group = _grouping(ids)
    # at most GROUPS rows and one, in descending order; the last comes before the first
    order = Window.orderBy(F.desc("group"))
    heads = ids.select("id", group.alias("group")).groupBy("group").agg(F.max("id").alias("head"))
    last = F.last("group").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("head", F.coalesce(F.lag("group").over(order), last).alias("before"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("own", group)
    rows = rows.join(F.broadcast(heads), F.col("id").eqNullSafe(F.col("head")), "left")
    places = F.array(F.struct(F.col("own").alias("group"), F.lit(False).alias("guest")), F.struct(F.col("before").alias("group"), F.lit(True).alias("guest")))
    places = F.filter(places, lambda x: x["group"].isNotNull())
    rows = rows.select("id", "text", F.explode(places).alias("p")).select("id", "text", "p.group", "p.guest")
    rows = rows.repartition("group")

    # the order of the rows of a group; guests come last
    by = Window.partitionBy("group").orderBy("guest", F.col("id").desc_nulls_last(), F.xxhash64("text"), "text")
    rows = rows.withColumns({"n": F.row_number().over(by), "after": F.coalesce(F.lead("text").over(by), F.lit(""))})
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - half), F.substring("after", F.lit(1), half))
    rows = rows.select("group", "n", "guest", "id", "text", size.cast("long").alias("n_chars"), edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    texts = F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))
    keys = ["group", "n", "guest", "id", "n_chars", "edited_sha256"]
    both = rows.select(*keys, F.explode(texts).alias("x")).select(*keys, "x.which", "x.t")
    prints = fingerprints(both, [*keys, "which"], F.col("t"))
    prints = prints.select(*keys, "which", as_text().alias("text"), signs().alias("signs"))
    # own, edited, own, edited ... of the group's rows
    turn = Window.partitionBy("group").orderBy("n", "which")
    own = F.struct("text", "signs", square(F.col("signs")).alias("square"))
    prints = prints.select(*keys, "which", own.alias("own"), F.lead(own, 1).over(turn).alias("new"), F.lead(own, 2).over(turn).alias("next"))

    def near(other: str) -> Column:
        a, b = F.col("own"), F.col(other)
        return likeness(a["text"] == b["text"], a["signs"], b["signs"], a["square"], b["square"])

    return prints.where("which = 0 and not guest").select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256",
        F.col("own.text").alias("fingerprint"), F.col("new.text").alias("edited_fingerprint"),
        near("new").alias("near_edited"), near("next").alias("near_next"),
    )
