"""Queries for change events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.folders import new_folder
from millrace.functions.schemas import LOG_SCHEMA
from millrace.operators.cdc import (
    capture_delay,
    change_counts_per_window,
    changed_fields,
    decode_changes,
    decode_changes_checked,
    latest_state,
    operation_counts,
    route_changes,
    row_image,
    split_changes,
    write_routed,
)
from millrace.operators.history import as_of, chain_breaks, history
from millrace.operators.windows import EventWindow
from millrace.plans.registry import query
from millrace.plans.window_queries import plain
from millrace.sources.tables import ACCOUNT_ROW, change_log, fed_in_turns, spoiled_change_log
from millrace.streaming.sinks import run, table_sink
from millrace.streaming.triggers import AVAILABLE_NOW
from millrace.streaming.upsert import ChangeTable

# The history in SQL: one row per change, with the balance before and after it.
ACCOUNTS = """
  select 'customers' "table", c_custkey id, c_name name, c_acctbal bal,
         case when c_mktsegment = 'MACHINERY' then 'r' else 'c' end first_op,
         c_mktsegment in ('AUTOMOBILE', 'BUILDING') updated, false truncated from customer
  union all
  select 'suppliers', s_suppkey, s_name, s_acctbal, 'c', true, true from supplier"""
CHANGES = f"""
  select "table" source_table, id, name, op, step, ts_ms, ts_ms - id % 1000 source_ts_ms, bal_before, bal_after,
         (id % 3)::int "partition", id * 4 + step "offset"
  from (select *, 1704067200000 + step * 3600000 + id ts_ms from (
    select "table", id, name, first_op op, 0 step, null bal_before, bal bal_after from ({ACCOUNTS})
    union all select "table", id, name, 'u', 1, bal, bal + 100 from ({ACCOUNTS}) where updated
    union all select "table", id, name, 'd', 2, case when updated then bal + 100 else bal end, null
              from ({ACCOUNTS}) where bal < 0
    union all select "table", id, name, 't', 3, null, null from ({ACCOUNTS}) where truncated))"""
OPERATION = "case op when 'c' then 'create' when 'u' then 'update' when 'd' then 'delete' when 'r' then 'read' end"
STATE = f"""
  select "table" source_table, id, name, case when updated then bal + 100 else bal end acctbal
  from ({ACCOUNTS}) where not bal < 0"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_changes(change_log(spark, sf_dir), ACCOUNT_ROW)


@query(
    "cdc_decode",
    f"""select op, ts_ms, make_timestamp(ts_ms * 1000) change_time, '2.4.0' source_version, 'postgresql' source_connector,
          'accounts' source_name, source_ts_ms, 'accounts' source_db, 'public' source_schema, source_table,
          coalesce(bal_before, -1000000) before_acctbal, coalesce(bal_after, -1000000) after_acctbal,
          "partition", "offset"
        from ({CHANGES})""",
)
def cdc_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = F.lit(-1000000.0)
    flat = changes(spark, sf_dir).withColumns(
        {
            "before_acctbal": F.coalesce("before.acctbal", missing),
            "after_acctbal": F.coalesce("after.acctbal", missing),
        }
    )
    return plain(flat.drop("before", "after"))


@query(
    "cdc_op_counts",
    f"""select source_table, coalesce({OPERATION}, 'unknown') operation, count(*) change_count
        from ({CHANGES}) group by 1, 2""",
)
def cdc_op_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operation_counts(changes(spark, sf_dir), "source_table").fillna("unknown", ["operation"])


@query("cdc_quarantine", f"select source_table, op, ts_ms from ({CHANGES}) where op = 't'")
def cdc_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_changes(changes(spark, sf_dir))[1].select("source_table", "op", "ts_ms")


@query(
    "cdc_row_image",
    f"""select source_table, op, id row_key, name, case when op = 'd' then bal_before else bal_after end acctbal
        from ({CHANGES}) where op <> 't'""",
)
def cdc_row_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = row_image(split_changes(changes(spark, sf_dir))[0])
    return images.select("source_table", "op", "row_key", "image.name", "image.acctbal")


@query("cdc_latest_state", STATE)
def cdc_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_state(changes(spark, sf_dir))


@query("cdc_apply_stream", STATE)
def cdc_apply_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes applied by a stream in the worst order, deletes first."""
    work = new_folder(spark, "changes")
    table = ChangeTable(f"{work}/table")
    rank = F.when(F.col("op") == "d", 0).when(F.col("op") == "u", 1).otherwise(2)
    source = changes(spark, sf_dir).withColumn("turn", rank)
    for folder in fed_in_turns(source, "turn"):
        stream = spark.readStream.schema(source.schema).parquet(folder)
        run(table_sink(stream, table.apply_batch, "append", f"{work}/checkpoint"), AVAILABLE_NOW).awaitTermination()
    return table.read(spark)


@query(
    "cdc_changed_fields",
    f"select source_table, id row_key, ts_ms, 'acctbal' field, bal_before old_value, bal_after new_value "
    f"from ({CHANGES}) where op = 'u'",
)
def cdc_changed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values compared as numbers, as text of floating point numbers differs between engines."""
    fields = changed_fields(changes(spark, sf_dir))
    return fields.withColumns({name: F.col(name).cast("double") for name in ("old_value", "new_value")})


@query(
    "cdc_route",
    f"select source_table routed_to, op, ts_ms, \"offset\" from ({CHANGES})",
)
def cdc_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables written in one pass and read back by directory."""
    folder = new_folder(spark, "routed")
    write_routed(changes(spark, sf_dir), folder)
    routed = route_changes(spark.read.parquet(folder), ["customers", "suppliers"])
    parts = [part.select(F.lit(table).alias("routed_to"), "op", "ts_ms", "offset") for table, part in routed.items()]
    return parts[0].unionByName(parts[1])


@query(
    "cdc_window_counts",
    f"""select time_bucket(interval '1 minute', t) window_start, time_bucket(interval '1 minute', t) + interval '1 minute'
          window_end, source_table, coalesce({OPERATION}, 'unknown') operation, count(*) change_count
        from (select *, make_timestamp(ts_ms * 1000) t from ({CHANGES})) group by all""",
)
def cdc_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = change_counts_per_window(changes(spark, sf_dir), EventWindow("tumbling", "1 minute"))
    return plain(counts.fillna("unknown", ["operation"]))


@query(
    "cdc_delay",
    f"""select source_table, count(*) change_count, min(ts_ms - source_ts_ms) min_delay_ms,
          max(ts_ms - source_ts_ms) max_delay_ms, avg(ts_ms - source_ts_ms) avg_delay_ms
        from ({CHANGES}) group by 1""",
)
def cdc_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture_delay(changes(spark, sf_dir))


_SPOILED = f"""
  select source_table, op, "partition", "offset", case
      when id % 10 = 1 then 'malformed_json'
      when id % 10 = 2 and op <> 't' then 'malformed_json'
      when id % 10 in (3, 4) and op <> 't' then 'missing_required'
      when id % 10 = 5 then 'missing_required'
      when op = 't' then 'unknown_operation' end reason
  from ({CHANGES})"""


def spoiled_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_changes_checked(spoiled_change_log(spark, sf_dir), ACCOUNT_ROW)


@query(
    "cdc_quarantine_malformed",
    f"""select 'cdc-accounts' topic, "partition", "offset", reason, true has_text from ({_SPOILED}) where reason is not null""",
)
def cdc_quarantine_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken messages with their text and their place in the log."""
    bad = split_changes(spoiled_changes(spark, sf_dir))[1]
    has_text = F.coalesce(F.length("raw_value") > 0, F.lit(False))
    return bad.select("topic", "partition", "offset", F.col("quarantine_reason").alias("reason"), has_text.alias("has_text"))


@query("cdc_latest_state_dirty", f"select * from ({STATE}) where id % 10 not between 1 and 5")
def cdc_latest_state_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current rows from a log with broken messages, through the stream: only good changes count."""
    work = new_folder(spark, "dirty")
    spoiled_change_log(spark, sf_dir).write.parquet(f"{work}/log")
    log = spark.readStream.schema(LOG_SCHEMA).parquet(f"{work}/log")
    table = ChangeTable(f"{work}/table")
    changes = decode_changes_checked(log, ACCOUNT_ROW)
    run(table_sink(changes, table.apply_batch, "append", f"{work}/checkpoint"), AVAILABLE_NOW).awaitTermination()
    return table.read(spark)


#: The history with holes: some updates, and the beginnings of some rows, never came.
_HOLES = "not (op = 'u' and id % 5 = 0) and not (op in ('c', 'r') and id % 7 = 0)"


@query(
    "cdc_chain_breaks",
    f"""select source_table, id row_key, ts_ms, "offset", op, reason from (
          select *, case when op = 'r' then null when number = 1 and bal_before is not null then 'no_beginning'
                         when number > 1 and bal_before is distinct from former then 'changed_between' end reason
          from (select *, lag(bal_after) over w former, row_number() over w number
                from ({CHANGES}) where op <> 't' and {_HOLES}
                window w as (partition by source_table, id order by ts_ms, "offset")))
        where reason is not null""",
)
def cdc_chain_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = row_image(split_changes(changes(spark, sf_dir))[0])
    return chain_breaks(known.withColumn("id", F.col("row_key")).where(_HOLES).drop("id", "row_key", "image"))


@query(
    "cdc_history",
    f"""select source_table, id row_key, ts_ms valid_from,
          lead(ts_ms) over (partition by source_table, id order by ts_ms, "offset") valid_to, name, bal_after::double acctbal
        from ({CHANGES}) where op <> 't' qualify op <> 'd'""",
)
def cdc_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = history(split_changes(changes(spark, sf_dir))[0])
    return plain(found.select("source_table", "row_key", "valid_from", "valid_to", "image.name", "image.acctbal"))


@query(
    "cdc_as_of",
    f"""select o_orderkey, row_key, at_ms, bal_after::double acctbal
        from (select o_orderkey, o_custkey::int row_key, 1704067200000 + (o_orderkey * 7919) % 12000000 at_ms from orders) l
        asof left join (select * from ({CHANGES}) where op <> 't' and source_table = 'customers') c
          on l.row_key = c.id and l.at_ms >= c.ts_ms""",
)
def cdc_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The account of each order's customer as it was at some time of the history."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    at = (F.lit(1704067200000) + (F.col("o_orderkey").cast("long") * 7919) % 12_000_000).alias("at_ms")
    asked = orders.select("o_orderkey", F.lit("customers").alias("source_table"), F.col("o_custkey").cast("int").alias("row_key"), at)
    found = as_of(split_changes(changes(spark, sf_dir))[0], asked)
    return plain(found.select("o_orderkey", "row_key", "at_ms", F.col("image.acctbal").alias("acctbal")))
