"""Stored series: Parquet tables and fixed-record logs."""

from tidemark.sources.log import decode_logs, encode_logs, export_log, header_of, read_logs, ring_state
from tidemark.sources.log_source import RecordLogSource, record_log
from tidemark.sources.store import SeriesStore

__all__ = ["RecordLogSource", "SeriesStore", "decode_logs", "encode_logs", "export_log", "header_of", "read_logs", "record_log", "ring_state"]
