import pytest
from pyspark.sql import types as T

from millrace.functions import parse_measures, resolve_type, schema_from_config, to_micros
from millrace.functions.measures import DEFAULT_SPEC


@pytest.mark.parametrize(
    ("text", "micros"),
    [
        ("5 minutes", 300_000_000),
        ("1 hour 30 minutes", 5_400_000_000),
        ("INTERVAL 1 Day", 86_400_000_000),
        ("2 weeks", 1_209_600_000_000),
        ("1500 milliseconds", 1_500_000),
        ("7 microseconds", 7),
    ],
)
def test_durations(text, micros):
    assert to_micros(text) == micros


@pytest.mark.parametrize("text", ["", "5", "minutes", "0 minutes", "-1 minute", "1 month", "5 minutes or so", "1.5 hours"])
def test_durations_without_fixed_length_are_refused(text):
    with pytest.raises(ValueError):
        to_micros(text)


@pytest.mark.parametrize(
    ("name", "kind"),
    [
        ("string", T.StringType()),
        ("Integer", T.IntegerType()),
        ("LONG", T.LongType()),
        ("double", T.DoubleType()),
        ("timestamp", T.TimestampType()),
        ("decimal(12,2)", T.DecimalType(12, 2)),
        ("array<int>", T.ArrayType(T.IntegerType())),
        ("map<string,double>", T.MapType(T.StringType(), T.DoubleType())),
        ("struct<a:int>", T.StructType([T.StructField("a", T.IntegerType())])),
        ("boolean", T.BooleanType()),
        ("date", T.DateType()),
    ],
)
def test_type_names(spark, name, kind):
    assert resolve_type(name) == kind


@pytest.mark.parametrize("name", ["strin", "a int", "", "decimal(99,2)"])
def test_unknown_type_names_are_refused(spark, name):
    with pytest.raises(ValueError):
        resolve_type(name)


def test_schema_from_config(spark):
    schema = schema_from_config({"order_id": "string", "quantity": "integer", "event_time": "timestamp"})
    assert schema.simpleString() == "struct<order_id:string,quantity:int,event_time:timestamp>"
    with pytest.raises(ValueError):
        schema_from_config({})


def test_measures():
    spec = {"n": "count(*)", "qty": "sum(quantity)", "a": "avg( unit_price )", "lo": "min(p)", "hi": "max(p)"}
    assert [(m.name, m.function, m.column) for m in parse_measures(spec)] == [
        ("n", "count", "*"),
        ("qty", "sum", "quantity"),
        ("a", "avg", "unit_price"),
        ("lo", "min", "p"),
        ("hi", "max", "p"),
    ]
    assert [m.name for m in parse_measures(None)] == list(DEFAULT_SPEC)


@pytest.mark.parametrize("text", ["median(x)", "sum(*)", "sum(abs(x))", "count", "sum()", "sum(x) + 1", "SUM(x)"])
def test_unknown_measures_are_refused(text):
    with pytest.raises(ValueError):
        parse_measures({"m": text})


def test_an_empty_specification_is_refused():
    with pytest.raises(ValueError):
        parse_measures({})
