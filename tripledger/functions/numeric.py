"""Numeric column helpers."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_finite(value: Column) -> Column:
    """TRUE for ordinary numbers, FALSE for NaN and infinities, NULL for NULL.

    Spark orders NaN above infinity, so one comparison covers all three cases.
    """
    return F.abs(value) < F.lit(float("inf"))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Ratio that is NULL for a zero or NULL denominator."""
    return numerator / F.nullif(denominator, F.lit(0))


def to_bigint(value: Column, source: T.DataType) -> Column:
    """Strict cast to BIGINT. Fractional sources round to even instead of truncating,
    so an id column that one file stores as double keeps its value."""
    if isinstance(source, (T.DoubleType, T.FloatType)):
        value = F.rint(value)
    elif isinstance(source, T.DecimalType):
        value = F.round(value)
    return value.cast("bigint")


# Exact sums. A finite double is a whole number of at most 53 bits times a power of two, so a sum
# is a whole number in digits of LIMB bits: digit p stands for 2 ** (LIMB * p - OFFSET). LIMBS
# digits hold any sum of doubles. Digits are added up as BIGINT without carrying, which half a
# trillion rows per group cannot overflow (Spark would raise), and carried once at the end.
#
# Nearly all values lie within the CORE digits, which are plain SUM columns. A value outside
# gives rows of its own, one per digit, so a group has at most 1 + columns * LIMBS partial rows.
LIMB = 24
MASK = 2**LIMB - 1
OFFSET = 1152
LIMBS = 92
CORE = range(45, 50)  # 2 ** -72 up to 2 ** 48
LEAST = 2.0**-19  # lowest bit at 2 ** -71
MOST = 2.0**48
SLOT = "_slot"  # CORE_SLOT, or column * LIMBS + digit
CORE_SLOT = -1
WIDE = "decimal(38,0)"


# Expressions are SQL text below: hundreds of columns would take longer to build than to run.


def _scaled(value: str, exponent: str) -> str:
    """value * 2 ** exponent in two steps, since the power alone may be out of range."""
    first = f"least(greatest({exponent}, -1000), 1000)"
    return f"({value} * pow(2D, {first}) * pow(2D, {exponent} - {first}))"


def _bind(name: str, value: str, body: str) -> str:
    """body, in which name stands for value, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _finite(value: str) -> str:
    return f"(abs({value}) < double('infinity'))"


def _is_core(value: str) -> str:
    return f"(abs({value}) < {MOST!r}D AND (abs({value}) >= {LEAST!r}D OR {value} = 0))"


def _outside(values: Sequence[str]) -> str:
    """(slot, limb) of the digits of all values that are finite and not within the core."""
    every = ", ".join(f"struct({i} AS i, {v} AS v)" for i, v in enumerate(values))
    wide = f"filter(array({every}), x -> x.v IS NOT NULL AND {_finite('x.v')} AND NOT {_is_core('x.v')})"
    # a whole number of at most 56 bits, and the place of its lowest one
    low = "(cast(floor(log2(abs(x.v))) AS int) - 54)"
    number = f"struct(cast({_scaled('abs(x.v)', '-' + low)} AS bigint) AS m, {low} + {OFFSET} AS at, x.i AS i, x.v AS v)"
    parts = [f"shiftleft(shiftright(y.m, {LIMB * k}) & {MASK}L, y.at % {LIMB})" for k in range(3)]
    first = f"({parts[1]} + shiftright({parts[0]}, {LIMB}))"
    second = f"({parts[2]} + shiftright({first}, {LIMB}))"
    limbs = [f"{parts[0]} & {MASK}L", f"{first} & {MASK}L", f"{second} & {MASK}L", f"shiftright({second}, {LIMB})"]
    slot, sign = f"y.i * {LIMBS} + cast(floor(y.at / {LIMB}) AS int)", "if(y.v < 0, -1, 1)"
    digits = ", ".join(f"struct({slot} + {k} AS slot, ({x}) * {sign} AS limb)" for k, x in enumerate(limbs))
    return f"filter(flatten(transform({wide}, x -> {_bind('y', number, f'array({digits})')})), z -> z.limb != 0)"


def _names(columns: Sequence[str]) -> list[str]:
    return [f"`{c.replace('`', '``')}`" for c in columns]


def exact_sums(
    df: DataFrame, keys: Sequence[str], values: dict[str, Column], counters: Sequence[str] = ()
) -> DataFrame:
    """Per group: keys, row_count, the SUM of each BIGINT column in counters, and for each value
    its sum and, as ``<name>_count``, how many are not NULL.

    The sum is exact: all finite doubles are added with unlimited precision and the total is
    rounded once, so it does not depend on the order of rows, on partitioning or on retries. NaN
    and infinities add up as SUM adds them. A sum is NULL where all values are NULL.
    """
    return merge_sums(partial_sums(df, keys, values, counters), keys, list(values), counters)


def partial_sums(
    df: DataFrame, keys: Sequence[str], values: dict[str, Column], counters: Sequence[str] = ()
) -> DataFrame:
    """The first half of ``exact_sums``: one row per keys and SLOT, which ``merge_sums`` merges."""
    n = range(len(values))
    keys, counters = _names(keys), _names(counters)
    rows = df.select(*keys, *counters, *(v.cast("double").alias(f"_v{i}") for i, v in enumerate(values.values())))
    # what several steps use is a projection of its own, computed once
    for step in (
        [f"if({_is_core(f'_v{i}')}, abs(_v{i}), 0D) AS _x{i}" for i in n],
        [f"floor(_x{i}) AS _hi{i}" for i in n],
        [f"(_x{i} - _hi{i}) * {2.0**48!r}D AS _mid{i}" for i in n],
        [f"floor(_mid{i}) AS _lo{i}" for i in n],
    ):
        rows = rows.selectExpr("*", *step)
    inside = " AND ".join(f"(_v{i} IS NULL OR NOT {_finite(f'_v{i}')} OR {_is_core(f'_v{i}')})" for i in n) or "true"
    plain = f"array(struct({CORE_SLOT} AS slot, 0L AS limb))"
    more = f"concat({plain}, {_outside([f'_v{i}' for i in n])})" if n else plain
    rows = rows.selectExpr("*", f"explode(if({inside}, {plain}, {more})) AS _e")
    own = f"_e.slot = {CORE_SLOT}"
    sums = [f"count_if({own}) AS _n", *(f"sum(if({own}, {c}, NULL)) AS {c}" for c in counters), "sum(_e.limb) AS _limb"]
    for i in n:
        limbs = [f"cast((_mid{i} - _lo{i}) * {2.0**LIMB!r}D AS bigint)", f"_lo{i} & {MASK}L", f"shiftright(_lo{i}, {LIMB})"]
        limbs += [f"_hi{i} & {MASK}L", f"shiftright(_hi{i}, {LIMB})"]
        sums += [f"sum(if({own}, if(_v{i} < 0, -({x}), {x}), NULL)) AS _l{i}_{k}" for k, x in enumerate(limbs)]
        sums.append(f"sum(if({own} AND NOT {_finite(f'_v{i}')}, _v{i}, NULL)) AS _odd{i}")
        sums.append(f"count(if({own}, _v{i}, NULL)) AS _count{i}")
    return rows.groupBy(*keys, F.col("_e.slot").alias(SLOT)).agg(*map(F.expr, sums))


def combine_sums(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Partial sums of several sets of rows as those of all the rows, again one row per keys and
    SLOT."""
    sums = [c for c in parts.columns if c not in (*keys, SLOT)]
    return parts.groupBy(*keys, SLOT).agg(*(F.sum(c).alias(c) for c in sums)).select(*parts.columns)


def _carried(limbs: str) -> str:
    """(carry, digits): limbs carried from the lowest up; carry is 0, or -1 for a negative total."""
    here = "(s.carry + d)"
    step = f"struct(shiftright({here}, {LIMB}) AS carry, concat(s.digits, array({here} & {MASK}L)) AS digits)"
    start = "struct(0L AS carry, cast(array() AS array<bigint>) AS digits)"
    return f"aggregate(concat({limbs}, array(0L, 0L, 0L)), {start}, (s, d) -> {step})"


def _rounded(digits: str) -> str:
    """The double nearest to digits, even on a tie."""
    # four digits from the top hold more bits than a double; a bit beyond marks a rest
    lead = " + ".join(
        f"cast(coalesce(get(t.d, t.top - {k}), 0L) AS decimal(8,0)) * cast('{2 ** (LIMB * (3 - k))}' AS decimal(23,0))" for k in range(4)
    )
    rest = "coalesce(exists(slice(t.d, 1, greatest(t.top - 3, 0)), x -> x != 0), false)"
    marked = f"if({rest} AND pmod(l, cast(2 AS {WIDE})) = 0, cast(l + 1 AS {WIDE}), l)"
    size = _scaled(f"cast({_bind('l', f'cast({lead} AS {WIDE})', marked)} AS double)", f"({LIMB} * (t.top - 3) - {OFFSET})")
    found = f"struct({digits} AS d, array_max(transform({digits}, (x, i) -> if(x != 0, i, NULL))) AS top)"
    return _bind("t", found, f"if(t.top IS NULL, 0D, {size})")


def _total(limbs: Sequence[str]) -> str:
    """The correctly rounded sum of LIMBS columns, NULL where a digit was never met."""
    core = [f"coalesce({limbs[p]}, 0L)" for p in CORE]
    # a total below 2 ** 53 with nothing outside the core fits one decimal
    plain = f"cast({core[-1]} AS {WIDE})"
    for limb in reversed(core[:-1]):
        plain = f"cast(cast({plain} * cast({2**LIMB} AS decimal(8,0)) AS {WIDE}) + cast({limb} AS decimal(20,0)) AS {WIDE})"
    small = f"abs({core[-1]}) < {2**29} AND abs({core[-2]}) < {2**52}L"
    alone = f"coalesce({', '.join(c for p, c in enumerate(limbs) if p not in CORE)}) IS NULL"
    # else carried for the total and its negative: that which is not negative counts
    every = f"array({', '.join(f'coalesce({c}, 0L)' for c in limbs)})"
    both = f"transform(array(1L, -1L), sign -> {_carried('transform(e, x -> x * sign)')})"
    signed = f"if(p[0].carry < 0, -({_bind('n', 'p[1].digits', _rounded('n'))}), {_bind('n', 'p[0].digits', _rounded('n'))})"
    general = _bind("e", every, _bind("p", both, signed))
    return f"if({alone} AND {small}, {_scaled(f'cast({plain} AS double)', str(LIMB * CORE[0] - OFFSET))}, {general})"


def merge_sums(
    parts: DataFrame, keys: Sequence[str], names: Sequence[str], counters: Sequence[str] = ()
) -> DataFrame:
    """The second half of ``exact_sums``: LIMBS sums per group and column, plain aggregates of
    fixed size, and one rounding each."""
    kinds = {"_count": "bigint", "_odd": "double", "_n": "bigint"} | {c: parts.schema[c].dataType.simpleString() for c in counters}
    quoted = dict(zip(kinds, _names(kinds)))

    def entry(column: int | str, place: int | str = "NULL", limb: str = "NULL", **more: str) -> str:
        rest = [f"cast({more.get(c, 'NULL')} AS {kind}) AS {quoted[c]}" for c, kind in kinds.items()]
        return f"struct({column} AS _i, cast({place} AS int) AS _place, cast({limb} AS bigint) AS _limb, {', '.join(rest)})"

    own = [entry(-1, _n="_n", **{c: quoted[c] for c in counters})]
    for i in range(len(names)):
        own.append(entry(i, _count=f"_count{i}", _odd=f"_odd{i}"))
        own += [entry(i, p, f"_l{i}_{k}") for k, p in enumerate(CORE)]
    other = entry(f"cast(floor({SLOT} / {LIMBS}) AS int)", f"{SLOT} % {LIMBS}", "_limb")
    key = _names(keys)
    rows = parts.selectExpr(*key, f"inline(if({SLOT} = {CORE_SLOT}, array({', '.join(own)}), array({other})))")
    if keys:  # both groupings that follow need no other shuffle
        rows = rows.repartition(*key)
    limbs = [f"_p{p}" for p in range(LIMBS)]
    sums = [f"sum(if(_place = {p}, _limb, NULL)) AS {c}" for p, c in enumerate(limbs)] + [f"sum({c}) AS {c}" for c in quoted.values()]
    totals = rows.groupBy(*key, "_i").agg(*map(F.expr, sums))
    counted = _names(counters)
    totals = totals.selectExpr(*key, "_i", f"if(_count > 0, coalesce(_odd, {_total(limbs)}), NULL) AS _total", "_count", "_n", *counted)
    pick = lambda c, i: f"max(if(_i = {i}, {c}, NULL))"
    out = ["coalesce(max(_n), 0L) AS row_count", *(f"max({c}) AS {c}" for c in counted)]
    for i, n in enumerate(_names(names)):
        out += [f"{pick('_total', i)} AS {n}", f"coalesce({pick('_count', i)}, 0L) AS `{n[1:-1]}_count`"]
    return totals.groupBy(*key).agg(*map(F.expr, out))


def mean_of(name: str) -> Column:
    """AVG from the columns of ``exact_sums``."""
    return F.col(name) / F.nullif(F.col(f"{name}_count"), F.lit(0))


def failures(condition: Column) -> Column:
    """Aggregate: number of rows for which a condition is TRUE (0 on empty input)."""
    return F.count_if(condition)
