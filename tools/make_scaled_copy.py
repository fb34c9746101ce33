"""Derive a larger, multi-file copy of the shared tables for scaling checks.

    python tools/make_scaled_copy.py --src /root/testdata/sf0.1 --out /tmp/run-XXXX/x10 --copies 10 --files 16

Every table except the fixed dimensions (region, nation) is repeated ``copies``
times with its keys shifted per copy (foreign keys shifted the same way, so
joins keep their shape), and written as a folder of ``files`` parquet files
named like the original table. The rows are the given rows; nothing is
generated.
"""

from __future__ import annotations

import argparse
import os
import sys
from functools import reduce

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# key columns per table and the table whose key space they live in
KEYS = {
    "customer": {"c_custkey": "customer"},
    "supplier": {"s_suppkey": "supplier"},
    "part": {"p_partkey": "part"},
    "orders": {"o_orderkey": "orders", "o_custkey": "customer"},
    "lineitem": {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"},
    "events": {"event_id": "events", "user_id": "customer"},
    "documents": {"doc_id": "documents"},
    "labels": {"doc_id": "documents"},
    "pages": {"page_id": "pages"},
    "benchmark": {"item_id": "benchmark"},
    "conversations": {"conv_id": "conversations"},
    "embeddings": {"vec_id": "embeddings"},
}
PRIMARY = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey",
           "events": "event_id", "documents": "doc_id", "pages": "page_id", "benchmark": "item_id",
           "conversations": "conv_id", "embeddings": "vec_id"}


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--src", default="/root/testdata/sf0.1")
    ap.add_argument("--out", required=True)
    ap.add_argument("--copies", type=int, default=10)
    ap.add_argument("--files", type=int, default=16)
    args = ap.parse_args()

    from pyspark.sql import functions as F
    from cirrus.session import get_session
    from cirrus.sources.tables import TABLES, load

    spark = get_session("local[8]", shuffle_partitions=8)
    span = {t: load(spark, args.src, t).agg(F.max(k)).first()[0] + 1 for t, k in PRIMARY.items()}
    for t in TABLES:
        df = load(spark, args.src, t)
        if t in KEYS:
            copies = [df.select(*[(F.col(c) + F.lit(i * span[KEYS[t][c]])).cast(df.schema[c].dataType).alias(c)
                                  if c in KEYS[t] else F.col(c) for c in df.columns])
                      for i in range(args.copies)]
            df = reduce(lambda a, b: a.unionByName(b), copies)
        df.repartition(args.files).write.mode("overwrite").parquet(f"{args.out}/{t}.parquet")
        print(t, spark.read.parquet(f"{args.out}/{t}.parquet").count())
    spark.stop()


if __name__ == "__main__":
    main()
