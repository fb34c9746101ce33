"""The query catalogue: one module per SURVEY section 2 subsection.

q_sources    2.1  sources and sinks          q_time     2.7  date and time
q_filters    2.2  projections, filters       q_scalar   2.8  scalar functions
q_joins      2.3  joins                      q_graph    2.9  topology and listings
q_aggregates 2.4  aggregations               q_streams  2.10 streaming
q_sorts      2.5  sorts, paging, top-k       q_udf      2.11 user functions
q_setops     2.6  set operations

``registry.query`` registers each callable ``(spark, sf_dir) -> DataFrame`` with
its DuckDB oracle SQL; ``views`` maps the operations concepts (servers,
flavors, tenant quotas) onto the shared tables, in Spark and in SQL.
"""
