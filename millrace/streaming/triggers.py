"""Triggers given as ``{"available_now": True}`` or ``{"processing_time": "1 minute"}``."""

from __future__ import annotations

from pyspark.sql.streaming import DataStreamWriter

AVAILABLE_NOW = {"available_now": True}


def triggered(writer: DataStreamWriter, trigger: dict | None) -> DataStreamWriter:
    if trigger is None:
        return writer
    if trigger == AVAILABLE_NOW:
        return writer.trigger(availableNow=True)
    if set(trigger) == {"processing_time"}:
        return writer.trigger(processingTime=trigger["processing_time"])
    raise ValueError(f"unknown trigger: {trigger!r}")
