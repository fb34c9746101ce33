"""Structured Streaming jobs (jobs): job queue, latest rows with refresh, log sync
(new files and files that grow), windowed period statistics; idempotent
per-batch sinks and change-log state."""
