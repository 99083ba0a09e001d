"""What a stream has begun and not yet written: open windows, read from the state in its checkpoint."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.measures import Measure, column_type, measure_types, parse_measures
from millrace.operators.windows import EventWindow

#: What Spark calls the operators that keep windows, in the metadata of a checkpoint.
_SAVING = ("stateStoreSave", "sessionWindowStateStoreSaveExec")


def open_windows(
    spark: SparkSession,
    checkpoint: str,
    events: DataFrame,
    window: EventWindow,
    *,
    group_by: Sequence[str] = (),
    aggregations: Mapping[str, str] | None = None,
    batch_id: int | None = None,
) -> DataFrame:
    """The windows in the state of a stream that ran ``aggregate_windows`` with these arguments, in its result's shape.

    In append mode a window is written once the watermark has passed its end, so the last ones stay in the state for
    as long as no later event comes. With what the sink has, these are all windows of all events read so far. In
    update mode they are those that may still change. ``events`` is what the stream aggregates, for its types; no row of
    it is read. Spark's state reader reads the state in parallel, as it was after ``batch_id``, by default the last
    finished batch; the stream may go on meanwhile.
    """
    measures, keys = parse_measures(aggregations), list(group_by)
    types = measure_types(events, measures)
    reader = spark.read.format("statestore").option("operatorId", _operator(spark, checkpoint))
    if batch_id is not None:
        reader = reader.option("batchId", batch_id)
    state = reader.load(checkpoint)
    session = window.kind == "session"
    head = [T.StructField("session_window", _WINDOW), *[T.StructField(key, column_type(events, key)) for key in keys]] if session else []
    buffers, results = _buffers(events, measures, types)
    value = T.StructType([*head, *buffers])
    found = len(state.schema["value"].dataType.fields)
    if found != len(value.fields):
        raise ValueError(f"the state has {found} values per window, not {len(value.fields)}: it is of other measures or windows")
    at, of = ("value.session_window", "value") if session else ("key.window", "key")
    named = state.select("key", F.col("value").cast(value).alias("value"))
    return named.select(
        F.col(f"{at}.start").alias("window_start"),
        F.col(f"{at}.end").alias("window_end"),
        *[F.col(f"{of}.{key}").alias(key) for key in keys],
        *[result.cast(types[name]).alias(name) for name, result in results.items()],
    )


_WINDOW = T.StructType([T.StructField("start", T.TimestampType()), T.StructField("end", T.TimestampType())])


def _operator(spark: SparkSession, checkpoint: str) -> int:
    known = spark.read.format("state-metadata").load(checkpoint).where(F.col("operatorName").isin(*_SAVING))
    found = [row["operatorId"] for row in known.select("operatorId").distinct().collect()]
    if len(found) != 1:
        raise ValueError(f"{checkpoint} has {len(found)} operators that keep windows, not one")
    return found[0]


def _buffers(events: DataFrame, measures: list[Measure], types: Mapping[str, T.DataType]) -> tuple[list[T.StructField], dict[str, Column]]:
    """The partial results Spark keeps per window, in order, and the measures made of them.

    Measures that are equal but for their names share theirs.
    """
    fields: list[T.StructField] = []
    shared: dict[tuple[str, str], Column] = {}
    for measure in measures:
        key = (measure.function, measure.column)
        if key in shared:
            continue
        parts = [types[name] for name in measure.merges()]
        if measure.function == "sum" and isinstance(parts[0], T.DecimalType):
            parts.append(T.BooleanType())
        names = [f"b{len(fields) + k}" for k in range(len(parts))]
        fields += [T.StructField(name, kind) for name, kind in zip(names, parts, strict=True)]
        first, *second = [F.col(f"value.{name}") for name in names]
        if measure.function == "avg":
            first = first / F.nullif(second[0], F.lit(0))
        elif second:
            first = F.when(~second[0], first)
        shared[key] = first
    return fields, {m.name: shared[m.function, m.column] for m in measures}
