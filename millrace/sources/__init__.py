from millrace.sources.event_log import read_log, replay, stream_log, write_log
from millrace.sources.kafka import kafka_replay, kafka_stream, replay_options, stream_options

__all__ = [
    "kafka_replay",
    "kafka_stream",
    "read_log",
    "replay",
    "replay_options",
    "stream_log",
    "stream_options",
    "write_log",
]
