"""DataFrame -> DataFrame operators.

table       TableSpec, filters (contains, regex, wildcard, conditions, time ranges), paging, summary row
joins       size-checked broadcast lookups, semi/anti joins on distinct keys
enrich      ordered arrays and texts, id-array expansion, diffs, endpoint resolution
usage       usage records and summaries        quota     quota/limit accounting
metering    period statistics and chart points aggregates summary-method registry
sorting     sort keys (size text, IPs, struct arrays), per-group last n
setops      typed unions, keyed merges, set differences
graph       listings, dependency edges, topology nodes, devices per network
quality     row rules (ports, protocols, IPv4/IPv6 networks) with pass/fail counts
jobs        word count, user map/reduce programs, total-order sort, generated rows
udf         column chains, filter actions, user programs over folders
"""
