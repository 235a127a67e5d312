"""Structured Streaming: incremental upkeep of the per-user first-event table."""

from cohortscope.streaming.first_events import (  # noqa: F401
    first_event_updates,
    read_first_events,
    start_first_events,
)
