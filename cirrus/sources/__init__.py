"""Readers and writers: declared-schema table loading (tables) and file sources and
sinks (files: typed records, JSON metadata, object listings, text, CSV/JSON
reports, salted partitioned writes, bucketed tables)."""
