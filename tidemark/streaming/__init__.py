"""Streams of records: admission, numbering, running aggregates and bounded sinks."""

from tidemark.streaming.ingest import admit_stream, number_stream, state_session
from tidemark.streaming.sinks import latest_version, retained_sink
from tidemark.streaming.views import running_latest, running_stats, windowed_stats

__all__ = ["admit_stream", "latest_version", "number_stream", "retained_sink", "running_latest", "running_stats", "state_session", "windowed_stats"]
