"""cirrus: operations analytics as Spark DataFrame operators.

Subpackages
-----------
sources    readers and writers (typed records, JSON metadata, listings, text, CSV/JSON sinks)
functions  Column -> Column expressions (formatting, parsing, status logic, time)
operators  DataFrame -> DataFrame operators (filters, joins, usage, quota, metering, graph, jobs)
plans      the query catalogue: each registered query wires operators onto the driver tables
streaming  Structured Streaming versions of the polling behaviours
"""

from cirrus.session import get_session, scratch_dir  # noqa: F401

__all__ = ["get_session", "scratch_dir"]
