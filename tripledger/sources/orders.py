"""Order lines seen as trips: from the order date to the ship date, from the customer's nation
to the supplier's nation. It gives the raw trip layout over an order database."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger.contract import Bounds

# Order lines "travel" for up to a year and cost more than a taxi ride.
ORDER_BOUNDS = Bounds(max_minutes=525_600.0, max_total=90_000.0)


# Declared, so that opening a table needs no job to read file footers.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def order_trips(spark: SparkSession, folder: str) -> DataFrame:
    """Raw trips, one per order line. No join is hinted: which side is small depends on the
    scale, and Spark sees the file sizes."""
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer")
    suppliers = table(spark, folder, "supplier")
    joined = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    )
    price = F.col("l_extendedprice")
    tip, tolls = price * F.col("l_discount"), price * F.col("l_tax")
    return joined.select(
        F.col("o_orderdate").alias("tpep_pickup_datetime"),
        F.col("l_shipdate").alias("tpep_dropoff_datetime"),
        F.col("c_nationkey").alias("PULocationID"),
        F.col("s_nationkey").alias("DOLocationID"),
        F.col("l_linenumber").cast("double").alias("passenger_count"),
        F.col("l_quantity").alias("trip_distance"),
        F.col("l_linenumber").alias("payment_type"),
        price.alias("fare_amount"),
        tip.alias("tip_amount"),
        tolls.alias("tolls_amount"),
        (price + tip + tolls).alias("total_amount"),
    )


def order_zones(spark: SparkSession, folder: str, without: str | None = None) -> DataFrame:
    """Raw zone lookup: nations by region. One region may be left out, so that some trips refer to
    zones that the lookup does not have."""
    nations, regions = table(spark, folder, "nation"), table(spark, folder, "region")
    if without is not None:
        regions = regions.where(F.col("r_name") != without)
    return nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("LocationID"),
        F.col("r_name").alias("Borough"),
        F.col("n_name").alias("Zone"),
        F.concat(F.col("r_name"), F.lit(" zone")).alias("service_zone"),
    )
