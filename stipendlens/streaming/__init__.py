"""Structured Streaming versions of tick ingest (T1) and the daily
dashboard (T2)."""

from stipendlens.streaming.ticks import (current_ticks, dashboard_stream, earliest_ticks, event_tick_stream, late_ticks, open_ticks,
                                         read_dashboard, run_tick_streams, start_dashboard, start_tick_ingest,
                                         stream_daily_dashboard, stream_ticks, tick_stream)

__all__ = ["current_ticks", "dashboard_stream", "earliest_ticks", "event_tick_stream", "late_ticks", "open_ticks", "read_dashboard",
           "run_tick_streams", "start_dashboard", "start_tick_ingest", "stream_daily_dashboard", "stream_ticks", "tick_stream"]
