"""Secrets, told from copied examples by who has them. DataFrame functions only.

Four kinds of spans are found in a text. The base kinds are always reported: assign (a value
assigned to a name such as password or token), access (access key ids) and hex (long runs of
hexadecimal digits). The fourth, bare, is a long run of key characters with lower case, upper
case and digits that lies in no base span.

The values of all spans are hashed and counted over the whole corpus: how many places, distinct
repositories and distinct owners has each? A value of a single owner is that owner's, in however many
repositories it lies: live-looking. One with `common` owners or more is a copied example, and so is
one that fewer owners share but `wide` repositories or more hold. A bare run is reported if it is live-looking, as a
widely copied one is most likely a file id or a documentation sample; base spans carry the class.

Places are code points. They come from the lengths of what lies between matches, summed per row
by a window over its matches only, so a text with very many matches costs no more per match.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripledger.sources.workdir import materialize

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = {
    "assign": ASSIGN,
    # a run shorter than this is dropped, and no later match inside it could be longer
    "access": "AKIA[A-Z0-9]{14,}",
    "hex": "[0-9a-f]{16,}",
    # a run of 24 or more is looked at whole; what it must contain is checked on the run
    "bare": "[A-Za-z0-9+/_=-]{24,}",
}
BASE = ["assign", "access", "hex"]
ASSIGN_LEAST = 12
COMMON = 3
WIDE = 20  # repositories from which a value that owners share is a copied example


def _hits(text: Column, pattern: str) -> Column:
    """Matches in order: (gap, hit), gap being the code points since the match before."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.transform(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), lambda x: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit")))
    none = F.array().cast("array<struct<gap:int,hit:string>>")
    return F.when(text.rlike(pattern), F.filter(pairs, lambda x: x["hit"].isNotNull())).otherwise(none)


def scan(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """Stored: one row per row of docs with row (its number), id, owner, repo and the matches of
    each kind. Texts are read once and not stored."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return materialize(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).alias("id"),
            F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
            F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("repo"),
            *[_hits(text, p).alias(k) for k, p in KINDS.items()],
        ),
        "hits",
    )


def _numbered(kind: str) -> Column:
    """The matches of a kind with their numbers."""
    fixed = (F.lit(list(KINDS).index(kind)).alias("at"), F.lit(kind).alias("kind"))
    return F.transform(F.col(kind), lambda x, i: F.struct(*fixed, i.alias("i"), x["gap"].alias("gap"), x["hit"].alias("hit")))


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")


def spans(scanned: DataFrame) -> DataFrame:
    """row, owner, repo, kind, at (place of the kind in KINDS), start, end, hash of every span that
    is long enough; bare runs only where they lie outside all base spans."""
    tagged = F.concat(*[_numbered(kind) for kind in KINDS])
    each = scanned.where(" or ".join(f"size({k}) > 0" for k in KINDS)).select("row", "owner", "repo", F.explode(tagged).alias("x"))
    each = each.select("row", "owner", "repo", "x.*").withColumn("size", F.length("hit"))
    so_far = Window.partitionBy("row", "at").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far)).withColumn("start", F.col("end") - F.col("size"))
    value = F.when(F.col("kind") == "assign", F.regexp_extract("hit", ASSIGN, 2)).otherwise(F.col("hit"))
    bare = F.col("hit").rlike("[0-9]") & F.col("hit").rlike("[a-z]") & F.col("hit").rlike("[A-Z]")
    each = each.withColumn("value", value).where(
        F.when(F.col("kind") == "assign", F.length("value") >= ASSIGN_LEAST).when(F.col("kind") == "bare", bare).otherwise(True)
    )
    # bare runs under a base span: those before reach over their start, or the next begins inside
    order = Window.partitionBy("row").orderBy("start", "at")
    base = F.col("kind") != "bare"
    before = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after >= F.col("end"), F.lit(True)))
    each = each.withColumn("free", free).where(base | F.col("free"))
    return each.select("row", "owner", "repo", "kind", "at", "start", "end", F.sha2("value", 256).alias("hash"))


def ownership(found: DataFrame, common: int = COMMON, wide: int = WIDE) -> DataFrame:
    """hash, places, repos, owners, copied of every value. Distinct pairs are counted before they
    are shuffled by value, so one value that stands everywhere costs no task more than others."""
    pairs = found.groupBy("hash", "owner").agg(F.count("*").alias("places"))
    owners = pairs.groupBy("hash").agg(F.sum("places").alias("places"), F.count("*").alias("owners"))
    repos = found.select("hash", "repo").distinct().groupBy("hash").agg(F.count("*").alias("repos"))
    copied = (F.col("owners") >= common) | ((F.col("owners") > 1) & (F.col("repos") >= wide))
    return owners.join(repos, "hash").withColumn("copied", copied)


def _listed(items: Column) -> Column:
    """kind:start:end of sorted structs, comma-joined."""
    return F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
         repo_col: str | None = None, common: int = COMMON, wide: int = WIDE) -> DataFrame:
    """Per row of docs: id, counts of the base kinds, base (their spans), spans (all reported),
    and how many of the reported are live-looking and copied.

    base and spans are arrays of (start, at, kind, end, copied, owners, repos) in order of start and
    kind. Null and empty texts have none. A null owner or repository counts as one of its own.
    repo_col: the document itself unless given.
    """
    scanned = scan(docs, id_col, text_col, owner_col, repo_col or id_col)
    found = materialize(spans(scanned), "spans")
    judged = found.join(ownership(found, common, wide), "hash").where("kind <> 'bare' or not copied")
    item = F.struct("start", "at", "kind", "end", "copied", "owners", "repos")
    per_row = judged.groupBy("row").agg(F.sort_array(F.collect_list(item)).alias("spans"))
    none = F.array().cast(per_row.schema["spans"].dataType)
    out = scanned.select("row", "id").join(per_row, "row", "left").withColumn("spans", F.coalesce("spans", none))
    return out.select(
        F.col("id").alias(id_col),
        *[_count(kind).alias(f"n_{kind}") for kind in BASE],
        F.filter("spans", lambda x: x["kind"] != "bare").alias("base"),
        "spans",
        F.size(F.filter("spans", lambda x: ~x["copied"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda x: x["copied"])).cast("long").alias("n_copied"),
    )


def report(docs: DataFrame, **options) -> DataFrame:
    """`find` with the spans as text and the base spans as their SHA-256, and `seen`: for each of
    the spans how many repositories and owners its value has, as repositories:owners."""
    found = find(docs, **options)
    each = F.transform("spans", lambda x: F.concat_ws(":", x["repos"].cast("string"), x["owners"].cast("string")))
    found = found.withColumn("seen", F.array_join(each, ","))
    return found.withColumns({"base_sha256": F.sha2(_listed(F.col("base")), 256), "spans": _listed(F.col("spans"))}).drop("base")
