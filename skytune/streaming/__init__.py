"""Incremental daily roll-ups over a stream of chart files.

The reference has no streaming operator: its chunked reads are bounded
batches (re-expressed as ordinary partitioned scans).  What a stream adds is
day files arriving over time; ``daily_stream`` keeps the day-level stream
metrics (G1) up to date with Structured Streaming state instead of re-reading
history.  Exact medians need the whole day and stay batch-only.
"""

from .daily import current_days, daily_stream, start_daily_stream

__all__ = ["current_days", "daily_stream", "start_daily_stream"]
