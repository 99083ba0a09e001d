"""Event streams derived from the given tables: order events, their log, and the changes of two tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.folders import new_folder
from millrace.functions.schemas import LOG_SCHEMA, change_envelope
from millrace.operators.decode import to_log
from millrace.streaming.files import SharedFiles

# Fixed values of order events.
STATUSES = ("PENDING", "CONFIRMED", "SHIPPED", "DELIVERED")
PAYMENT_METHODS = ("CREDIT_CARD", "PAYPAL", "APPLE_PAY", "DEBIT_CARD")

#: Rows of a table that one task makes messages of.
ROWS_OF_A_TASK = 20_000
#: Rows of the events table that one task feeds to a stream, as a file for each turn.
EVENTS_OF_A_TASK = 200_000

EVENTS_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
# The columns a history of changes is made from.
_CUSTOMER = "c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string"
_SUPPLIER = "s_suppkey bigint, s_name string, s_acctbal double"
# The default order event with exact prices, so that sums do not depend on the order of rows.
EXACT_ORDER = {
    "order_id": "string",
    "customer_id": "string",
    "product_id": "string",
    "quantity": "integer",
    "unit_price": "decimal(12,2)",
    "event_time": "timestamp",
    "event_type": "string",
}
ACCOUNT_ROW = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("acctbal", T.DoubleType()),
    ]
)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def order_events(source: DataFrame) -> DataFrame:
    """The events table as order events; a delivery's ``kafka_timestamp`` comes some minutes after the event."""
    return source.select(
        F.col("event_id").cast("string").alias("order_id"),
        F.col("user_id").cast("string").alias("customer_id"),
        (F.col("event_id") % 500).cast("string").alias("product_id"),
        F.from_json("props", "k int")["k"].alias("quantity"),
        F.col("value").cast("decimal(12,2)").alias("unit_price"),
        F.col("ts").alias("event_time"),
        "event_type",
        arrival(F.col("event_id"), F.col("ts")).alias("kafka_timestamp"),
    )


def arrival(event_id: Column, time: Column) -> Column:
    """Every twentieth event is delayed by 1 to 180 minutes."""
    minutes = F.when(event_id % 20 == 0, (event_id * 7) % 180 + 1).otherwise(0)
    return time + F.make_dt_interval(mins=minutes.cast("int"))


def order_log(source: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The events table as messages of topic ``orders`` in three partitions, with status and metadata."""
    orders = order_events(source.withColumn("ts", F.col("ts").cast("timestamp")))
    number = F.col("order_id").cast("long")
    described = orders.withColumns(
        {
            "status": _pick(STATUSES, number),
            "payment_method": _pick(PAYMENT_METHODS, F.col("customer_id").cast("long")),
            "_metadata": F.struct(
                F.lit("tables").alias("producer"),
                (F.col("kafka_timestamp") > F.col("event_time")).alias("is_late"),
                F.col("kafka_timestamp").alias("produced_at"),
            ),
        }
    )
    return to_log(
        described,
        key="order_id",
        columns=[name for name in described.columns if name != "kafka_timestamp"],
        topic="orders",
        partition=number % 3,
        offset=F.expr("cast(order_id as bigint) div 3"),
        timestamp=F.col("kafka_timestamp"),
        keep=keep,
    )


def spoiled_log(source: DataFrame) -> DataFrame:
    """``order_log`` where the messages of some events with a quantity below 25 are spoiled by event type.

    ``error``: cut off; ``view``: no event time; ``click``: text for the quantity; ``signup``: no value at all;
    ``purchase``: a JSON list. Quantities 25 to 49 get a field that no schema knows.
    """
    kind, quantity = F.col("event_type"), F.col("quantity")
    told = order_log(source, ("event_type", "quantity")).withColumn("text", F.col("value").cast("string"))
    low = (
        F.when(kind == "error", F.expr("left(text, length(text) - 10)"))
        .when(kind == "view", F.regexp_replace("text", '"event_time":"[^"]*",', ""))
        .when(kind == "click", F.regexp_replace("text", '"quantity":[0-9]+', '"quantity":"zz"'))
        .when(kind == "purchase", F.lit("[1]"))
    )
    extra = F.concat(F.expr("left(text, length(text) - 1)"), F.lit(',"unknown_field":1}'))
    spoiled = F.when(quantity < 25, low).when(quantity < 50, extra).otherwise(F.col("text"))
    return told.withColumn("value", spoiled.cast("binary")).select(*LOG_SCHEMA.names)


def redelivered(source: DataFrame) -> DataFrame:
    """Order events delivered one to three times, each ``copy`` a minute after the one before."""
    copies = F.sequence(F.lit(0), (F.col("order_id").cast("long") % 3).cast("int"))
    return order_events(source).withColumn("copy", F.explode(copies)).withColumn(
        "kafka_timestamp", F.col("kafka_timestamp") + F.make_dt_interval(mins=F.col("copy"))
    )


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of topic ``cdc-accounts``: a coherent history of the customer and supplier tables.

    Rows of market segment MACHINERY come from a snapshot (``r``), all others are created (``c``). Segments
    AUTOMOBILE and BUILDING, and all suppliers, gain 100 in their balance (``u``). Rows whose balance began
    below zero are deleted (``d``). Each supplier also has a message with an operation nobody knows (``t``).
    """
    customers = spark.read.schema(_CUSTOMER).parquet(f"{sf_dir}/customer.parquet").select(
        F.lit("customers").alias("table"),
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("acctbal"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "r").otherwise("c").alias("first_op"),
        F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING").alias("updated"),
        F.lit(False).alias("truncated"),
    )
    suppliers = spark.read.schema(_SUPPLIER).parquet(f"{sf_dir}/supplier.parquet").select(
        F.lit("suppliers").alias("table"),
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        F.col("s_acctbal").alias("acctbal"),
        F.lit("c").alias("first_op"),
        F.lit(True).alias("updated"),
        F.lit(True).alias("truncated"),
    )
    rows = dealt(customers.unionByName(suppliers), "table", "id")
    was = F.struct("id", "name", "acctbal")
    gained = F.struct("id", "name", (F.col("acctbal") + 100).alias("acctbal"))
    now = F.when(F.col("updated"), gained).otherwise(was)
    nothing = F.lit(None).cast(ACCOUNT_ROW)
    steps = F.array(
        _step(F.lit(True), 0, F.col("first_op"), nothing, was),
        _step(F.col("updated"), 1, F.lit("u"), was, gained),
        _step(F.col("acctbal") < 0, 2, F.lit("d"), now, nothing),
        _step(F.col("truncated"), 3, F.lit("t"), nothing, nothing),
    )
    changes = rows.select("table", "id", F.explode(F.filter(steps, lambda s: s["happens"])).alias("s"))
    ts_ms = F.lit(1704067200000) + F.col("s.step") * 3600000 + F.col("id")
    source = F.struct(
        F.lit("2.4.0").alias("version"),
        F.lit("postgresql").alias("connector"),
        F.lit("accounts").alias("name"),
        (ts_ms - F.col("id") % 1000).alias("ts_ms"),
        F.lit("accounts").alias("db"),
        F.lit("public").alias("schema"),
        F.col("table").alias("table"),
    )
    envelope = changes.select(
        "id",
        "s.step",
        ts_ms.alias("ts_ms"),
        F.struct(F.lit("struct").alias("type"), F.concat("table", F.lit(".Envelope")).alias("name")).alias("schema"),
        F.struct(
            F.col("s.before").alias("before"),
            F.col("s.after").alias("after"),
            source.alias("source"),
            F.col("s.op").alias("op"),
            ts_ms.alias("ts_ms"),
        ).alias("payload"),
    )
    return to_log(
        envelope,
        key="id",
        columns=change_envelope(ACCOUNT_ROW).names,
        topic="cdc-accounts",
        partition=F.col("id") % 3,
        offset=F.col("id") * 4 + F.col("step"),
        timestamp=F.timestamp_millis("ts_ms"),
    )


def dealt(rows: DataFrame, *keys: str, each: int = ROWS_OF_A_TASK) -> DataFrame:
    """``rows`` of tables, dealt over tasks by their keys: a file is read by few tasks, and messages are many times as large."""
    tasks = -(-rows.count() // each)
    return rows.repartition(tasks, *keys) if tasks > 1 else rows


def spoiled_change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``change_log`` where the messages of some rows are spoiled, by the last digit of the key (``offset div 4 % 10``).

    1: cut off; 2: text for a balance; 3: no row images; 4: no key in the images; 5: no operation.
    """
    log = change_log(spark, sf_dir).withColumn("text", F.col("value").cast("string"))
    digit = F.expr("offset div 4 % 10")
    spoiled = (
        F.when(digit == 1, F.expr("left(text, length(text) - 8)"))
        .when(digit == 2, F.regexp_replace("text", '"acctbal":[-0-9.E]+', '"acctbal":"zz"'))
        .when(digit == 3, F.regexp_replace("text", '"(before|after)":\\{[^}]*\\}', '"$1":null'))
        .when(digit == 4, F.regexp_replace("text", '"id":[0-9]+', '"id":null'))
        .when(digit == 5, F.regexp_replace("text", '"op":"."', '"op":null'))
        .otherwise(F.col("text"))
    )
    return log.withColumn("value", spoiled.cast("binary")).select(*LOG_SCHEMA.names)


def _step(happens: Column, step: int, op: Column, before: Column, after: Column) -> Column:
    return F.struct(
        happens.alias("happens"),
        F.lit(step).alias("step"),
        op.alias("op"),
        before.cast(ACCOUNT_ROW).alias("before"),
        after.cast(ACCOUNT_ROW).alias("after"),
    )


def fed_in_turns(df: DataFrame, turn: str) -> Iterator[str]:
    """Make ``df`` appear in a folder turn by turn, in the order of column ``turn``, and yield the folder.

    All turns are written at once; then one more directory is moved into the folder before each yield. A stream
    over the folder, run to the end of what is there, gets one turn as one micro-batch.
    """
    spark = df.sparkSession
    files = SharedFiles(spark)
    folder = new_folder(spark, "turns")
    staged = f"{folder}-staged"
    df.write.partitionBy(turn).parquet(staged)
    for name in files.names(staged):
        if name.startswith(f"{turn}="):
            files.publish(f"{staged}/{name}", f"{folder}/{name}")
            yield folder


def _pick(values: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(value) for value in values]), (number % len(values) + 1).cast("int"))
