"""The registered queries in plain SQL, written against the same tables."""

from tripledger.contract import COLUMN_COMMENTS

#: No given value has a bit below 1 / SCALE.
SCALE = 2**60

EVENT_TYPES = ["view", "signup", "error", "click", "purchase"]
DAILY_DOUBLES = [
    "total_revenue",
    "average_fare",
    "average_tip_percentage",
    "average_trip_distance",
    "average_trip_duration",
    "fare_sum",
    "tip_sum",
    "distance_sum",
]


def total(x: str) -> str:
    """The exact SUM of doubles, rounded once: scaled by a power of two the given values are whole
    numbers, HUGEINT adds them without rounding, and text is read as the nearest double."""
    return f"(CAST(CAST(SUM(CAST(({x}) * {SCALE}::DOUBLE AS HUGEINT)) AS VARCHAR) AS DOUBLE) / {SCALE}::DOUBLE)"


def mean(x: str) -> str:
    return f"({total(x)} / NULLIF(COUNT({x}), 0))"


RAW = """
raw AS (
    SELECT o_orderdate AS tpep_pickup_datetime, l_shipdate AS tpep_dropoff_datetime,
        c_nationkey AS PULocationID, s_nationkey AS DOLocationID,
        CAST(l_linenumber AS DOUBLE) AS passenger_count, l_quantity AS trip_distance,
        l_linenumber AS payment_type, l_extendedprice AS fare_amount,
        l_extendedprice * l_discount AS tip_amount, l_extendedprice * l_tax AS tolls_amount,
        l_extendedprice + l_extendedprice * l_discount + l_extendedprice * l_tax AS total_amount
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
)"""

RAW_ZONES = """
raw_zones AS (
    SELECT n_nationkey AS LocationID, r_name AS Borough, n_name AS Zone,
        r_name || ' zone' AS service_zone
    FROM nation JOIN region ON n_regionkey = r_regionkey
)"""

DIM = """
dim_zones AS (
    SELECT LocationID::BIGINT AS zone_id, Borough AS borough, Zone AS zone_name, service_zone
    FROM raw_zones
)"""

# Payment codes and labels.
LABELS = """(VALUES (1, 'credit_card'), (2, 'cash'), (3, 'no_charge'), (4, 'dispute'),
        (5, 'unknown'), (6, 'voided')) AS labels(code, label)"""

TYPED = f"""
typed AS (
    SELECT tpep_pickup_datetime AS pickup_datetime, tpep_dropoff_datetime AS dropoff_datetime,
        PULocationID::BIGINT AS pickup_zone_id, DOLocationID::BIGINT AS dropoff_zone_id,
        passenger_count, trip_distance, coalesce(label, 'unknown') AS payment_type, fare_amount,
        tip_amount, tolls_amount, total_amount, tpep_pickup_datetime::DATE AS pickup_date,
        hour(tpep_pickup_datetime)::INTEGER AS pickup_hour,
        date_diff('microsecond', tpep_pickup_datetime, tpep_dropoff_datetime) / 1e6 / 60
            AS trip_duration_minutes
    FROM raw LEFT JOIN {LABELS} ON code = payment_type
)"""

# The first rule a trip breaks.
REASONS = """CASE WHEN pickup_datetime IS NULL THEN 'missing_pickup'
        WHEN dropoff_datetime IS NULL THEN 'missing_dropoff'
        WHEN trip_duration_minutes < 0 THEN 'negative_duration'
        WHEN trip_duration_minutes > 525600 THEN 'excessive_duration'
        WHEN NOT coalesce(isfinite(trip_distance) AND trip_distance >= 0, FALSE)
            THEN 'invalid_distance'
        WHEN NOT coalesce(isfinite(total_amount) AND total_amount >= 0
            AND total_amount <= 90000, FALSE) THEN 'invalid_total'
        WHEN NOT coalesce(isfinite(fare_amount), FALSE) THEN 'invalid_fare'
        WHEN NOT coalesce(isfinite(tip_amount), FALSE) THEN 'invalid_tip'
        WHEN NOT coalesce(isfinite(tolls_amount), FALSE) THEN 'invalid_tolls'
        ELSE 'accepted' END"""

STG = f"""
stg_trips AS (SELECT * FROM typed WHERE {REASONS} = 'accepted')"""


def fct(name: str = "fct_trips", revenue: str = "fare_amount") -> str:
    return f"""
{name} AS (
    SELECT trip.*, origin.zone_name AS pickup_zone, goal.zone_name AS dropoff_zone,
        {revenue} AS revenue,
        CASE WHEN trip_distance <> 0 THEN ({revenue}) / trip_distance END AS revenue_per_mile,
        CASE WHEN fare_amount <> 0 THEN 100 * tip_amount / fare_amount END AS tip_percentage
    FROM stg_trips AS trip, dim_zones AS origin, dim_zones AS goal
    WHERE origin.zone_id = pickup_zone_id AND goal.zone_id = dropoff_zone_id
)"""


def daily(name: str = "daily_metrics", source: str = "fct_trips", where: str = "TRUE") -> str:
    return f"""
{name} AS (
    SELECT pickup_date AS date, COUNT(*) AS trip_count, {total("revenue")} AS total_revenue,
        {mean("fare_amount")} AS average_fare,
        {mean("tip_percentage")} AS average_tip_percentage,
        {mean("trip_distance")} AS average_trip_distance,
        {mean("trip_duration_minutes")} AS average_trip_duration,
        {total("fare_amount")} AS fare_sum, {total("tip_amount")} AS tip_sum,
        {total("trip_distance")} AS distance_sum
    FROM {source} WHERE {where} GROUP BY pickup_date
)"""


def zone(name: str = "zone_metrics", source: str = "fct_trips") -> str:
    return f"""
{name} AS (
    SELECT pickup_zone_id, pickup_zone, COUNT(*) AS trip_count,
        {total("revenue")} AS total_revenue, {mean("fare_amount")} AS average_fare,
        {mean("trip_distance")} AS average_trip_distance
    FROM {source} GROUP BY pickup_zone_id, pickup_zone
)"""


def growth(source: str, columns: str, keys: str = "") -> str:
    """Each month next to the calendar month before it, by a self join."""
    same = f"AND now.{keys} = before.{keys}" if keys else ""
    shown = ", ".join(f"now.{column.strip()}" for column in columns.split(","))
    changes = ", ".join(
        f"CASE WHEN before.{c} <> 0 THEN (now.{c} - before.{c}) / before.{c} END AS {name}"
        for c, name in (
            ("trip_count", "month_over_month_trip_growth"),
            ("revenue", "month_over_month_revenue_growth"),
        )
    )
    return f"""
    SELECT {shown}, {changes} FROM {source} AS now
    LEFT JOIN {source} AS before ON now.month = before.month + INTERVAL 1 MONTH {same}"""


MONTHLY_COLUMNS = "month, trip_count, revenue, average_fare, average_tip, average_distance"


def monthly(name: str = "monthly_metrics", source: str = "daily_metrics") -> str:
    trips = "SUM(trip_count)::BIGINT"
    return f"""
{name}_rollup AS (
    SELECT date_trunc('month', date)::DATE AS month, {trips} AS trip_count,
        {total("total_revenue")} AS revenue, {total("fare_sum")} / {trips} AS average_fare,
        {total("tip_sum")} / {trips} AS average_tip,
        {total("distance_sum")} / {trips} AS average_distance
    FROM {source} GROUP BY 1
),
{name} AS ({growth(f"{name}_rollup", MONTHLY_COLUMNS)})"""


def zone_monthly(name: str = "zone_monthly", where: str = "TRUE") -> str:
    return f"""
{name} AS (
    SELECT pickup_zone_id, CAST(DATE_TRUNC('month', pickup_date) AS DATE) AS month,
        COUNT(*) AS trip_count, {total("revenue")} AS revenue
    FROM fct_trips WHERE {where} GROUP BY 1, 2
)"""


FAULTY = """
faulty AS (
    SELECT * REPLACE (
        CASE WHEN passenger_count = 7 THEN NULL ELSE dropoff_datetime END AS dropoff_datetime,
        CASE WHEN passenger_count = 3 THEN NULL ELSE pickup_zone_id END AS pickup_zone_id,
        CASE WHEN tolls_amount = 0 THEN 999 ELSE dropoff_zone_id END AS dropoff_zone_id,
        CASE WHEN trip_distance = 50 THEN -1.0 ELSE trip_distance END AS trip_distance,
        CASE WHEN trip_distance = 49 THEN 'NaN'::DOUBLE ELSE total_amount END AS total_amount,
        CASE WHEN trip_distance = 1 THEN NULL ELSE trip_duration_minutes END
            AS trip_duration_minutes)
    FROM fct_trips
)"""

REVENUE_B = "fare_amount + tip_amount + tolls_amount"
EARLY = "dropoff_datetime < TIMESTAMP '1999-01-01'"
BAD_TRIP = {
    "timestamps": "NOT coalesce(pickup_datetime <= dropoff_datetime, FALSE)",
    "distance": "NOT coalesce(isfinite(trip_distance) AND trip_distance >= 0, FALSE)",
    "total_amount": "NOT coalesce(isfinite(total_amount) AND total_amount >= 0 "
    "AND total_amount <= 90000, FALSE)",
    "duration": "NOT coalesce(trip_duration_minutes >= 0 AND trip_duration_minutes <= 525600, FALSE)",
}


def unknown(role: str) -> str:
    """No zone has this id; a NULL id counts as unknown."""
    return f"NOT coalesce({role}_zone_id IN (SELECT zone_id FROM dim_zones), FALSE)"


MISSING_ZONE = f"({unknown('pickup')} OR {unknown('dropoff')})"

BASE = [RAW, RAW_ZONES, DIM, TYPED, STG, fct()]

#: For checks of references: the dimension without the zones of one region.
LACKING = """
lacking AS (SELECT * FROM dim_zones WHERE borough <> 'MIDDLE EAST')"""


def lacking(condition: str) -> str:
    return condition.replace("dim_zones", "lacking")

CORRECTED = [
    RAW.replace("raw AS", "original AS"),
    """
raw AS (
    SELECT * REPLACE (CASE WHEN DATE_TRUNC('month', tpep_dropoff_datetime) = TIMESTAMP '1998-03-01'
        THEN fare_amount + 1 ELSE fare_amount END AS fare_amount)
    FROM original
)""",
    *BASE[1:],
]

RECORDS = """
records AS (
    SELECT 'events' AS run_id, event_type AS implementation, 'u' || user_id AS scenario,
        'events' AS dataset_kind, CAST(month(ts) AS BIGINT) AS dataset_months,
        CAST(year(ts) AS BIGINT) AS dataset_year, CAST(NULL AS BIGINT) AS start_month,
        k AS input_rows, value - 1.0 AS execution_seconds, 'stream' AS strategy,
        CASE WHEN k <= 95 THEN CAST(k AS DOUBLE) END AS database_size_mb,
        CAST(event_id AS VARCHAR) AS timestamp,
        CASE WHEN value > 50 THEN 1 ELSE 0 END AS exit_code,
        CASE WHEN value > 100 THEN 'failed' ELSE 'verified' END AS status, k <> 13 AS equivalent
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
)"""

SUMMARY = (
    "scenario, implementation, dataset_months, input_rows, execution_seconds, "
    "database_size_mb, strategy"
)


def sql(body: str, *ctes: str) -> str:
    return (f"WITH {','.join(ctes)}\n" if ctes else "") + body


GIVEN = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
#: Their timestamps, written to the microsecond.
TIMES = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}


def _checksum(name: str) -> str:
    def part(start: int) -> str:
        return (
            f"CAST(COALESCE(SUM(CAST('0x' || substr(h, {start}, 15) AS HUGEINT)), 0) AS VARCHAR)"
        )

    time = TIMES.get(name)
    exact = f" REPLACE (strftime({time}, '%Y-%m-%dT%H:%M:%S.%f') AS {time})" if time else ""
    if name == "embeddings":
        exact = (
            " REPLACE (list_transform(embedding, lambda x: "
            "CAST(floor(x::DOUBLE * 1099511627776) AS BIGINT)) AS embedding)"
        )
    return (
        f"SELECT '{name}' AS table_name, COUNT(*) AS row_count, {part(1)} || '-' || {part(16)} "
        f"AS checksum FROM (SELECT sha256(CAST(to_json(t) AS VARCHAR)) AS h "
        f"FROM (SELECT *{exact} FROM {name}) t)"
    )


def _order_files(body: str) -> str:
    """Over the text files of a thousand order keys each: part, bytes, sha256."""
    return f"""
        WITH written AS (
            SELECT o_orderkey // 1000 AS part, string_agg(
                o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority, chr(10) ORDER BY o_orderkey
            ) || chr(10) AS content
            FROM orders GROUP BY 1
        ), files AS (SELECT part, strlen(content) AS bytes, sha256(content) AS sha256 FROM written)
        {body}"""


#: Each altered table: what the report says about it.
SCHEMA_ERRORS = {
    "orders": None,
    "events": "column 4: ('value', 'double') against ('value', 'decimal(20,6)')",
    "customer": "column 1: ('c_name', 'string') against ('C_name', 'string')",
    "part": "column 0: ('p_partkey', 'bigint') against ('p_name', 'string'); "
    "column 1: ('p_name', 'string') against ('p_partkey', 'bigint')",
    "supplier": "4 columns against 3",
    "nation": "3 columns against 4",
    "region": "region missing in altered",
}


def _schema_row(name: str, error: str | None) -> str:
    rows = "CAST(NULL AS BIGINT)" if name == "region" else f"(SELECT COUNT(*) FROM {name})"
    same = "NULL::BOOLEAN" if name == "region" else str(error is None)
    text = "NULL::VARCHAR" if error is None else "'" + error.replace("'", "''") + "'"
    return (
        f"SELECT '{name}' AS table_name, {same} AS same_schema, {rows} AS baseline_rows, "
        f"{rows} AS candidate_rows, {'0' if error is None else 'NULL'}::BIGINT AS nonfinite_rows, "
        f"{error is None} AS equivalent, {text} AS error"
    )


def _completeness(group: str, member: str, expected: list[str], source: str) -> str:
    names = ", ".join(f"'{name}'" for name in expected)
    counts = [
        f"SELECT {group}, '{name}' AS member, COUNT(*) FILTER (WHERE {member} = '{name}') "
        f"AS occurrences, 1 AS wanted FROM {source} GROUP BY {group}"
        for name in expected
    ]
    counts.append(
        f"SELECT {group}, '(other)', COUNT(*) FILTER (WHERE {member} NOT IN ({names})), 0 "
        f"FROM {source} GROUP BY {group}"
    )
    return (
        f"SELECT {group}, member, occurrences FROM ({' UNION ALL '.join(counts)}) "
        "WHERE occurrences <> wanted"
    )


def _uniform(group: str, field: str, source: str) -> str:
    return (
        f"SELECT {group}, '{field}' AS field, MIN({field}) AS lowest, MAX({field}) AS highest, "
        f"COUNT(*) - COUNT({field}) AS nulls FROM {source} GROUP BY {group} "
        f"HAVING MIN({field}) <> MAX({field}) OR COUNT({field}) NOT IN (0, COUNT(*))"
    )


def _changed_rows(name: str, a: str, b: str) -> str:
    return f"""SELECT '{name}' AS table_name, (SELECT COUNT(*) FROM {a}) AS baseline_rows,
        (SELECT COUNT(*) FROM {b}) AS candidate_rows,
        (SELECT COUNT(*) FROM (SELECT * FROM {a} EXCEPT ALL SELECT * FROM {b}))
        + (SELECT COUNT(*) FROM (SELECT * FROM {b} EXCEPT ALL SELECT * FROM {a}))
        AS differing_rows"""


def _tolerance(left: str, right: str, twice: str, epsilon: float) -> str:
    """``right`` has the keys for which ``twice`` holds two times."""
    cells = [
        f"""SELECT l.date, '{c}' AS column_name, CAST(l.{c} AS DOUBLE) AS left_value,
            CAST(r.{c} AS DOUBLE) AS right_value
        FROM {left} l JOIN {right} r ON l.date = r.date
        WHERE NOT (r.{twice}) AND l.{c} IS DISTINCT FROM r.{c}
            AND NOT COALESCE(abs(l.{c} - r.{c}) <= {epsilon}::DOUBLE
                * greatest(abs(l.{c}), abs(r.{c})), FALSE)"""
        for c in ("trip_count", *DAILY_DOUBLES)
    ]
    for label, a, b in (("only_left", left, right), ("only_right", right, left)):
        cells.append(
            f"SELECT date, '{label}', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM {a} "
            f"WHERE date NOT IN (SELECT date FROM {b})"
        )
    cells.append(
        f"SELECT r.date, 'repeated_right', CAST(l.date IS NOT NULL AS DOUBLE), 2::DOUBLE "
        f"FROM {right} r LEFT JOIN {left} l ON l.date = r.date WHERE r.{twice}"
    )
    return "\nUNION ALL\n".join(cells)


SORTED = ", ".join(
    f"{c} NULLS LAST"
    for c in (
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"
    )
)

CASE_FATES = {
    "card": "fact",
    "cash": "fact",
    "zero_distance": "fact",
    "zero_fare": "fact",
    "unknown_payment": "fact",
    "null_passengers": "fact",
    "null_pickup": "missing_pickup",
    "negative_duration": "negative_duration",
    "negative_distance": "invalid_distance",
    "excessive_total": "invalid_total",
    "invalid_pickup_zone": "unmatched",
    "invalid_dropoff_zone": "unmatched",
    "excessive_duration": "excessive_duration",
    "null_dropoff": "missing_dropoff",
    "negative_total": "invalid_total",
    "month_boundary": "fact",
}


def oracles() -> dict[str, str]:
    fates = ", ".join(f"('{case}', '{fate}')" for case, fate in CASE_FATES.items())
    checks = [
        f"SELECT '{name}' AS check_name, (SELECT COUNT(*) FROM faulty WHERE {bad}) AS failures"
        for name, bad in BAD_TRIP.items()
    ]
    apart = (
        "SELECT '{0}' AS check_name, abs(rows.n - coalesce(parts.n, 0)) AS failures FROM "
        "(SELECT COUNT(*) AS n FROM {1}) AS rows, "
        "(SELECT SUM(trip_count)::BIGINT AS n FROM {2}) AS parts"
    )
    not_in = (
        "pickup_zone_id NOT IN (SELECT zone_id FROM dim_zones) "
        "OR dropoff_zone_id NOT IN (SELECT zone_id FROM dim_zones)"
    )
    not_null_columns = [
        "pickup_datetime",
        "dropoff_datetime",
        "pickup_zone_id",
        "trip_duration_minutes",
    ]
    doubles = [
        "passenger_count",
        "trip_distance",
        "fare_amount",
        "tip_amount",
        "tolls_amount",
        "total_amount",
        "trip_duration_minutes",
        "revenue",
        "revenue_per_mile",
        "tip_percentage",
    ]
    in_range = "pickup_date BETWEEN DATE '1997-07-01' AND DATE '1998-12-31'"
    range_overwritten = sql(
        "SELECT * FROM target WHERE date NOT BETWEEN DATE '1997-07-01' AND DATE '1998-12-31' "
        "UNION ALL SELECT * FROM restated",
        *BASE,
        daily("target", where=EARLY),
        daily("restated", where=f"payment_type <> 'cash' AND {in_range}"),
    )
    key_replaced = sql(
        "SELECT * FROM target WHERE date NOT IN (SELECT date FROM fresh) "
        "UNION ALL SELECT * FROM fresh",
        *BASE,
        daily("target", where=EARLY),
        daily("fresh", where="pickup_date >= (SELECT MAX(date) FROM target)"),
    )
    all_daily = sql("SELECT * FROM daily_metrics", *BASE, daily())
    all_monthly = sql("SELECT * FROM monthly_metrics", *BASE, daily(), monthly())
    all_zone_monthly = sql(
        growth(
            "zone_monthly", "pickup_zone_id, month, trip_count, revenue", "pickup_zone_id"
        ),
        *BASE,
        zone_monthly(),
    )
    rejects = sql(
        f"SELECT {REASONS} AS reject_reason, COUNT(*) AS trip_count FROM typed GROUP BY 1",
        RAW,
        TYPED,
    )
    published = {
        "stg_trips": "stg_trips",
        "dim_zones": "dim_zones",
        "fct_trips": "fct_trips",
        "daily_metrics": "daily_metrics",
        "zone_metrics": "zone_metrics",
        "monthly_metrics": "monthly_metrics",
    }
    tables = [*BASE, daily(), zone(), monthly()]
    variant_b = [
        fct("fct_b", revenue=REVENUE_B),
        daily("daily_b", "fct_b"),
        zone("zone_b", "fct_b"),
        monthly("monthly_b", "daily_b"),
    ]
    changed = [
        _changed_rows(name, name, {"fct_trips": "fct_b", "daily_metrics": "daily_b",
                                   "zone_metrics": "zone_b", "monthly_metrics": "monthly_b"}.get(name, name))
        for name in published
    ]
    return {
        "stg_trips": sql("SELECT * FROM stg_trips", RAW, TYPED, STG),
        "payment_mix": sql(
            f"SELECT payment_type, COUNT(*) AS trip_count, {total('total_amount')} AS total_amount "
            "FROM stg_trips GROUP BY payment_type",
            RAW, TYPED, STG,
        ),
        "reject_reasons": rejects,
        "dim_zones": sql("SELECT * FROM dim_zones", RAW_ZONES, DIM),
        "fct_trips": sql("SELECT * FROM fct_trips", *BASE),
        "fct_trips_revenue_b": sql("SELECT * FROM fct_b", *BASE, fct("fct_b", revenue=REVENUE_B)),
        "unmatched_zones": sql(
            " UNION ALL ".join(
                f"SELECT '{role}' AS role, COUNT(*) AS unmatched_trips FROM stg_trips WHERE {lost}"
                for role, lost in (
                    ("pickup", lacking(unknown("pickup"))),
                    ("dropoff", lacking(unknown("dropoff"))),
                    ("either", lacking(MISSING_ZONE)),
                )
            ),
            *BASE, LACKING,
        ),
        "daily_metrics": all_daily,
        "daily_metrics_range": sql(
            "SELECT * FROM daily_metrics",
            *BASE,
            daily(where="pickup_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'"),
        ),
        "zone_metrics": sql("SELECT * FROM zone_metrics", *BASE, zone()),
        "monthly_metrics": all_monthly,
        "monthly_growth_lag": all_monthly,
        "monthly_growth_selfjoin": all_monthly,
        "zone_monthly_growth": all_zone_monthly,
        "zone_monthly_growth_shifted": all_zone_monthly,
        "date_bounds": sql(
            "SELECT least(MIN(CAST(tpep_pickup_datetime AS DATE)), DATE '1996-01-01') AS start_date, "
            "greatest(MAX(CAST(tpep_pickup_datetime AS DATE)), DATE '1996-06-30') AS end_date FROM raw",
            RAW,
        ),
        "top_days": sql(
            "SELECT * FROM daily_metrics ORDER BY total_revenue DESC, date LIMIT 10", *BASE, daily()
        ),
        "ordered_zone_metrics": sql("SELECT * FROM zone_metrics ORDER BY ALL", *BASE, zone()),
        "category_order": "SELECT event_type, COUNT(*) AS event_count, CAST(list_position(["
        + ", ".join(f"'{name}'" for name in EVENT_TYPES)
        + "], event_type) AS BIGINT) AS position FROM events GROUP BY event_type ORDER BY position",
        "quality_report": sql(
            "\nUNION ALL\n".join(
                [
                    "SELECT 'zone_keys' AS check_name, SUM(CASE WHEN zone_id IS NULL THEN n "
                    "ELSE n - 1 END)::BIGINT AS failures "
                    "FROM (SELECT zone_id, COUNT(*) AS n FROM twice GROUP BY zone_id)",
                    *checks,
                    f"SELECT 'zone_references', (SELECT COUNT(*) FROM faulty WHERE {MISSING_ZONE})",
                    apart.format("daily_trip_count", "faulty", "daily_metrics"),
                    apart.format("monthly_trip_count", "faulty", "monthly_metrics"),
                    apart.format("zone_trip_count", "faulty", "zone_metrics"),
                ]
            ),
            *BASE,
            FAULTY,
            "\ntwice AS (SELECT * FROM dim_zones UNION ALL "
            "SELECT * FROM dim_zones WHERE borough = 'ASIA')",
            daily(where="tip_amount > 0"),
            zone(),
            monthly(),
        ),
        "audit_rows": sql(
            f"SELECT * FROM faulty WHERE {' OR '.join(BAD_TRIP.values())} OR {lacking(not_in)}", *BASE, LACKING, FAULTY
        ),
        "refs_not_exists": sql(
            f"SELECT * FROM faulty WHERE {lacking(MISSING_ZONE)}", *BASE, LACKING, FAULTY
        ),
        "refs_not_in": sql(
            f"SELECT * FROM faulty WHERE {lacking(not_in)}", *BASE, LACKING, FAULTY
        ),
        "not_null": sql(
            " UNION ALL ".join(
                f"SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS failures FROM faulty"
                for c in not_null_columns
            ),
            *BASE, FAULTY,
        ),
        "accepted_range": sql(
            " UNION ALL ".join(
                f"SELECT '{name}' AS check_name, COUNT(*) AS failures FROM faulty WHERE {c} IS NULL "
                f"OR NOT isfinite({c}) OR NOT ({good})"
                for name, c, good in (
                    ("distance", "trip_distance", "trip_distance BETWEEN 0 AND 40"),
                    ("total", "total_amount", "total_amount >= 1000"),
                    ("tip", "tip_percentage", "tip_percentage BETWEEN 0 AND 8"),
                )
            ),
            *BASE, FAULTY,
        ),
        "order_check": sql(
            "SELECT 'dropoff_after_pickup' AS check_name, COUNT(*) AS failures FROM typed "
            "WHERE pickup_datetime IS NULL OR dropoff_datetime IS NULL OR passenger_count = 7 "
            "OR dropoff_datetime < pickup_datetime",
            RAW, TYPED,
        ),
        "unique_keys": "SELECT l_orderkey, l_linenumber, COUNT(*) AS occurrences FROM lineitem "
        "WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL "
        "GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1",
        "surplus_keys": sql(
            "SELECT COUNT(*) - COUNT(DISTINCT pickup_zone_id) AS failures FROM faulty", *BASE, FAULTY
        ),
        "relationships": "SELECT doc_id, lang, source, n_chars FROM documents d "
        "WHERE doc_id IS NOT NULL AND NOT EXISTS "
        "(SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
        "conservation": sql(
            apart.format("daily_trip_count", "fct_trips", "daily_metrics")
            + " UNION ALL "
            + apart.format("zone_trip_count", "fct_trips", "zone_metrics"),
            *BASE, daily(where=EARLY), zone(),
        ),
        "nonfinite_output": sql(
            " UNION ALL ".join(
                f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE NOT isfinite({c})) AS failures "
                "FROM faulty"
                for c in doubles
            ),
            *BASE, FAULTY,
        ),
        "group_completeness": _completeness(
            "user_id, day",
            "event_type",
            EVENT_TYPES,
            "(SELECT *, CAST(ts AS DATE) AS day FROM events)",
        ),
        "uniform_within_group": " UNION ALL ".join(
            _uniform("o_custkey", field, "orders") for field in ("o_orderstatus", "o_orderpriority")
        ),
        "pivot": "SELECT user_id, "
        + ", ".join(
            f"ROUND(MAX(value) FILTER (WHERE event_type = '{name}'), 3) AS {name}"
            for name in EVENT_TYPES[:4]
        )
        + ", COUNT(*) FILTER (WHERE event_type = 'purchase') AS other_rows, CAST("
        + " + ".join(
            f"greatest(COUNT(*) FILTER (WHERE event_type = '{name}') - 1, 0)"
            for name in EVENT_TYPES[:4]
        )
        + " AS BIGINT) AS repeated_rows FROM events GROUP BY user_id",
        "max_per_group": "SELECT event_type, MAX(value) AS max_value FROM events GROUP BY event_type",
        "delete_insert": key_replaced,
        "overwrite_partitions": sql(
            "SELECT * FROM early WHERE month NOT IN (SELECT month FROM late) "
            "UNION ALL SELECT * FROM late",
            *BASE, zone_monthly("early", EARLY), zone_monthly("late", f"NOT {EARLY}"),
        ),
        "overwrite_range": range_overwritten,
        "table_overwrite_range": sql(
            "SELECT * FROM early WHERE month NOT BETWEEN DATE '1997-07-01' AND DATE '1998-12-31' "
            "UNION ALL SELECT * FROM restated "
            "WHERE month BETWEEN DATE '1997-07-01' AND DATE '1998-12-31'",
            *BASE, zone_monthly("early", EARLY),
            zone_monthly("restated", "DATE_TRUNC('quarter', pickup_date) <> DATE '1998-04-01'"),
        ),
        "touched_dates": all_daily,
        "restated_daily": sql("SELECT * FROM daily_metrics", *CORRECTED, daily()),
        "restated_monthly": sql("SELECT * FROM monthly_metrics", *CORRECTED, daily(), monthly()),
        "logic_change_diff": sql(
            "SELECT *, differing_rows = 0 AS equivalent FROM ("
            + "\nUNION ALL\n".join(changed)
            + ")",
            *tables, *variant_b,
        ),
        "missing_days": "SELECT user_id, missing_date FROM (SELECT DISTINCT user_id FROM events), "
        "(SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', "
        "INTERVAL 1 DAY)) AS DATE) AS missing_date) "
        "EXCEPT SELECT user_id, CAST(ts AS DATE) FROM events",
        "day_ranges": _ranges("events", "ts", "user_id", 7),
        "day_ranges_all": sql(_ranges("stg_trips", "pickup_date", "", 30), RAW, TYPED, STG),
        "multiset_diff": "SELECT * EXCLUDE (side), CAST(SUM(side) AS BIGINT) AS copies_delta "
        "FROM (SELECT *, -1 AS side FROM lineitem UNION ALL "
        "SELECT *, 1 FROM lineitem WHERE l_returnflag <> 'R' UNION ALL "
        "SELECT *, 1 FROM lineitem WHERE l_returnflag = 'A') GROUP BY ALL HAVING SUM(side) <> 0",
        "positional_mismatches": sql(
            "SELECT (SELECT COUNT(*) FROM a) AS left_rows, (SELECT COUNT(*) FROM b) AS right_rows, "
            "COUNT(*) AS mismatches FROM a FULL JOIN b ON a.rn = b.rn "
            "WHERE a.rn IS NULL OR b.rn IS NULL OR a.o IS DISTINCT FROM b.o",
            f"\na AS (SELECT o, row_number() OVER (ORDER BY {SORTED}) AS rn FROM orders o)",
            f"\nb AS (SELECT o, row_number() OVER (ORDER BY {SORTED}) AS rn FROM (SELECT * REPLACE ("
            "NULLIF(o_orderpriority, '1-URGENT') AS o_orderpriority) FROM orders "
            "WHERE o_orderstatus <> 'P') o)",
        ),
        "tolerance_diff": sql(
            _tolerance("a", "b", "date >= DATE '1998-07-01'", 0.05), *BASE, daily("a"), daily("b", where="tip_amount > 0")
        ),
        "table_checksum": " UNION ALL ".join(
            _checksum(name) for name in GIVEN
        ),
        "build_counts": sql(
            "SELECT 'input' AS measure, (SELECT COUNT(*) FROM raw) AS row_count UNION ALL "
            + " UNION ALL ".join(
                f"SELECT '{name}', (SELECT COUNT(*) FROM {source})"
                for name, source in published.items()
            )
            + " UNION ALL SELECT 'rejected_staging', (SELECT COUNT(*) FROM raw) - "
            "(SELECT COUNT(*) FROM stg_trips) UNION ALL SELECT 'rejected_zone', "
            "(SELECT COUNT(*) FROM stg_trips) - (SELECT COUNT(*) FROM fct_trips)",
            *tables,
        ),
        "new_month": all_daily,
        "schema_report": " UNION ALL ".join(_schema_row(*item) for item in SCHEMA_ERRORS.items()),
        "text_manifest": _order_files("SELECT part, bytes, sha256 FROM files"),
        "text_storage": _order_files(
            "SELECT 'orders' AS table_name, COUNT(*) AS files, SUM(bytes) / 1048576.0::DOUBLE AS size_mib FROM files"
        ),
        "records_read": """
            SELECT 'valid' AS record_set, TRUE AS accepted, scenario, implementation,
                COALESCE(MAX(value) FILTER (WHERE event_type = implementation), 0) AS execution_seconds,
                COUNT(*) AS input_rows
            FROM (SELECT *, 'h' || strftime(ts, '%H') AS scenario FROM events),
                unnest(['view', 'signup', 'error', 'click', 'purchase']) AS kinds(implementation)
            GROUP BY scenario, implementation
            UNION ALL SELECT unnest(['failed', 'incomplete', 'mixed']), FALSE, NULL, NULL, NULL, NULL""",
        "write_audit_publish": sql(
            " UNION ALL ".join(
                f"SELECT '{name}' AS table_name, (SELECT COUNT(*) FROM {source}) AS row_count"
                for name, source in published.items()
            ),
            *tables,
        ),
        "dev_environment": sql(
            "SELECT date, trip_count, average_fare + 1.0 AS dev_average_fare, "
            "average_fare AS prod_average_fare FROM daily_metrics",
            *BASE, daily(),
        ),
        "prod_unchanged": " UNION ALL ".join(
            f"SELECT '{step}' AS step, '{name}' AS table_name, "
            f"{name != 'daily_metrics' or step == 'development'} AS unchanged"
            for step in ("development", "promotion")
            for name in published
        ),
        "table_schemas": "SELECT table_name, CAST(column_index AS INTEGER) AS position, "
        "column_name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' "
        "WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN "
        "'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' WHEN 'DOUBLE[]' THEN 'array<double>' "
        "ELSE data_type END AS column_type FROM duckdb_columns() WHERE table_name IN ("
        + ", ".join(f"'{name}'" for name in GIVEN)
        + ")",
        "published_comments": "SELECT * FROM (VALUES "
        + ", ".join(
            f"('{name}', '{column}', '{comment}')"
            for name, columns in COLUMN_COMMENTS.items()
            for column, comment in columns.items()
        )
        + ") AS c(table_name, column_name, comment)",
        "input_gate": "SELECT * FROM (VALUES ('good', TRUE), ('empty', FALSE), "
        "('repeated', FALSE), ('no_id', FALSE)) AS c(lookup, accepted)",
        "union_by_name": "SELECT l_orderkey, l_linenumber, CASE WHEN l_shipdate < TIMESTAMP "
        "'1998-01-01' THEN CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) ELSE l_quantity END "
        "AS l_quantity, l_discount, CASE WHEN l_shipdate >= TIMESTAMP '1998-01-01' THEN l_tax END "
        "AS l_tax FROM lineitem",
        "month_drift": sql(
            "SELECT CAST(DATE_TRUNC('month', tpep_dropoff_datetime) AS DATE) AS file_month, "
            "CAST(DATE_TRUNC('month', tpep_pickup_datetime) AS DATE) AS event_month, "
            "COUNT(*) AS trip_count FROM raw WHERE year(tpep_dropoff_datetime) = 1998 GROUP BY 1, 2",
            RAW,
        ),
        "zone_csv": sql("SELECT * FROM dim_zones", RAW_ZONES, DIM),
        "csv_records": r"""SELECT doc_id, version, CASE version WHEN 0 THEN text WHEN 2 THEN ''
                WHEN 1 THEN '  ' || text || ' , "quoted" ' || chr(13) || chr(10) || ' \ ' END AS text,
            lang, source, n_chars, '{"source":"' || source || '"}' AS tags
            FROM documents, (SELECT unnest([0, 1, 2, 3])::INTEGER AS version)""",
        "json_records": sql(
            "SELECT timestamp, implementation, execution_seconds, database_size_mb, equivalent, "
            "input_rows AS output_row_count, implementation AS first_model FROM records",
            RECORDS,
        ),
        "changed_files": sql(
            "SELECT DISTINCT 'upload_year=' || year(tpep_dropoff_datetime) AS path, CASE WHEN "
            "year(tpep_dropoff_datetime) = 1998 THEN 'changed' ELSE 'unchanged' END AS status "
            "FROM raw",
            RAW,
        ),
        "case_matrix": f"""
            SELECT case_name, fate, COUNT(*) AS trip_count,
                CAST(SUM(CASE WHEN case_name = 'zero_fare' THEN 0 ELSE 10 + month(o_orderdate) END)
                    AS DOUBLE) AS fare_sum,
                CAST(SUM(CASE case_name WHEN 'null_pickup' THEN NULL WHEN 'null_dropoff' THEN NULL
                    WHEN 'negative_duration' THEN -1 WHEN 'excessive_duration' THEN 2880
                    ELSE 15 END) AS DOUBLE) AS minutes
            FROM orders, (VALUES {fates}) AS cases(case_name, fate) GROUP BY case_name, fate""",
        "validate_records": sql(
            """SELECT implementation, CASE
                WHEN NOT (status = 'verified' AND equivalent AND exit_code = 0) THEN 'not_verified'
                WHEN implementation NOT IN ('view', 'signup', 'error', 'click')
                    THEN 'unknown_member'
                WHEN NOT COALESCE(isfinite(execution_seconds) AND execution_seconds >= 0, FALSE)
                    THEN 'invalid_seconds'
                WHEN NOT COALESCE(isfinite(database_size_mb) AND database_size_mb >= 0, FALSE)
                    THEN 'invalid_size' END AS reject_reason, COUNT(*) AS record_count
            FROM records GROUP BY ALL""",
            RECORDS,
        ),
        "record_set_problems": sql(
            "SELECT scenario, CASE WHEN occurrences = 0 THEN 'missing_member' ELSE "
            "'surplus_member' END AS problem, member AS detail FROM ("
            + _completeness("scenario", "implementation", EVENT_TYPES, "records")
            + ") UNION ALL "
            + " UNION ALL ".join(
                f"SELECT scenario, 'mixed_scenario_field', '{field}' FROM records GROUP BY scenario "
                f"HAVING COUNT(DISTINCT {source}) > 1"
                for field, source in (
                    ("dataset_months", "dataset_months"),
                    ("input_rows", "input_rows"),
                    ("output_rows", "input_rows"),
                )
            )
            + " UNION ALL SELECT NULL, 'mixed_run_field', 'start_month'",
            RECORDS,
        ),
        "run_summary": sql(f"SELECT {SUMMARY} FROM records", RECORDS),
        "executed_steps": "SELECT event_id, event_type AS step FROM events WHERE value > 5",
        "run_status": """
            SELECT user_id, exit_code, equivalent, CASE WHEN exit_code <> 0 THEN 'failed'
                WHEN equivalent IS NULL THEN 'built' WHEN equivalent THEN 'verified'
                ELSE 'invalid' END AS status
            FROM (SELECT user_id, MAX(CASE WHEN value > 300 THEN 1 ELSE 0 END) AS exit_code
                FROM events GROUP BY user_id)
            LEFT JOIN (SELECT user_id, bool_and(value < 40) AS equivalent FROM events
                WHERE event_type = 'click' GROUP BY user_id)
            USING (user_id)""",
        "stream_touched_dates": all_daily,
        "stream_daily": all_daily,
        "stream_rejects": rejects,
    }


def _ranges(source: str, date: str, key: str, longest: int) -> str:
    keys = f"{key}, " if key else ""
    over = f"(PARTITION BY {key} ORDER BY day)" if key else "(ORDER BY day)"
    return f"""
        SELECT {keys}CAST(MIN(day) AS DATE) AS start_date, CAST(MAX(day) + 1 AS DATE) AS end_date,
            COUNT(*) AS days
        FROM (
            SELECT *, (row_number() OVER (PARTITION BY {keys}island ORDER BY day) - 1)
                // {longest} AS piece
            FROM (
                SELECT *, day - CAST(row_number() OVER {over} AS INTEGER) AS island
                FROM (SELECT DISTINCT {keys}CAST({date} AS DATE) AS day FROM {source})
            )
        ) GROUP BY {keys}island, piece"""
