"""The Parquet tables of a folder, with their declared order."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..plans.frame import Frame

#: Unique keys; line items have none shorter than all columns.
ORDER = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"],
    "orders": ["o_orderkey"], "events": ["event_id"], "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"],
    "benchmark": ["item_id"], "labels": ["doc_id"], "conversations": ["conv_id", "turn"],
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
}


def table(spark: SparkSession, folder: str, name: str) -> Frame:
    """One table of a folder as a frame in the order of its key."""
    return Frame(spark.read.parquet(f"{folder}/{name}.parquet"), ORDER[name])
