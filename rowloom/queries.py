"""One query for each operator over the tables of a folder, and its twin in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import types as L
from .functions.math import math
from .operators import aggregate, generate, mutate, search, sort, vector
from .operators import join as joins
from .operators.workspace import Workspace
from .plans.frame import POS, Frame
from .plans.selector import condition, select_expr, table_filter
from .sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _pos(name: str, key: str, cols: str = "*") -> str:
    return f"(SELECT {cols}, row_number() OVER (ORDER BY {key}) - 1 AS pos FROM {name})"


_LINE_ALL = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


# ---- search -------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS pos FROM lineitem WHERE l_quantity > 45")
def flagship_expensive_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    big = Frame(lines.df.where(search.matches(lines, 45.0, "l_quantity", "gt")), lines.order)
    return sort.sort(big, "l_extendedprice", decreasing=True, columns=["l_orderkey", "l_extendedprice"]).df


@query(f"SELECT {_LINE_ALL} FROM lineitem WHERE l_quantity > 45")
def search_gt_all(spark, d):
    lines = table(spark, d, "lineitem")
    return search.search(lines, 45.0, "l_quantity", "gt", all=True, inline=True)


@query("SELECT count(*) AS n FROM lineitem WHERE NOT (l_quantity > 45)")
def search_not_gt(spark, d):
    return search.count(table(spark, d, "lineitem"), 45.0, "l_quantity", "gt", negate=True)


@query(f"SELECT pos FROM {_pos('customer', 'c_custkey')} WHERE c_nationkey < 5")
def search_lt_positions(spark, d):
    return search.search(table(spark, d, "customer"), 5, "c_nationkey", "lt", all=True).select(POS)


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) = lower('building')")
def search_eq_nocase(spark, d):
    return search.search(table(spark, d, "customer"), "building", "c_mktsegment", nocase=True, all=True, inline=True)


@query("SELECT p_partkey, p_type FROM part WHERE p_type GLOB '*[ST]*[A-N]*'")
def search_glob(spark, d):
    return search.search(table(spark, d, "part"), "*[ST]*[A-N]*", "p_type", "pat", all=True, inline=True)


@query("SELECT p_partkey, p_type FROM part WHERE lower(p_type) GLOB '*st?nd*d'")
def search_glob_nocase(spark, d):
    return search.search(table(spark, d, "part"), "*sT?nD*d", "p_type", "pat", nocase=True, all=True, inline=True)


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^[a-s]+ .*[iu]{1}[nd]g')")
def search_regex(spark, d):
    return search.search(table(spark, d, "part"), "^[a-s]+ .*[iu]{1}[nd]g", "p_name", "re", all=True, inline=True)


@query("SELECT count(*) AS n FROM part WHERE NOT regexp_matches(p_name, 'r.*i')")
def search_not_regex(spark, d):
    return search.count(table(spark, d, "part"), "r.*i", "p_name", "re", negate=True)


@query(f"SELECT coalesce(min(pos), -1)::BIGINT AS found FROM {_pos('orders', 'o_orderkey')} WHERE o_totalprice > 400000")
def search_first(spark, d):
    return search.search(table(spark, d, "orders"), 400000.0, "o_totalprice", "gt")


@query("SELECT coalesce(min(o_orderkey), -1)::BIGINT AS found FROM orders WHERE o_orderstatus = 'no such'")
def search_first_missing(spark, d):
    return search.search(table(spark, d, "orders"), "no such", "o_orderstatus")


@query("SELECT arg_min(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders WHERE o_orderpriority > '3'")
def search_first_inline(spark, d):
    return search.search(table(spark, d, "orders"), "3", "o_orderpriority", "gt", inline=True)


@query(f"SELECT pos, value > 50 AS found FROM {_pos('events', 'event_id')}")
def search_bitmap(spark, d):
    return search.search(table(spark, d, "events"), 50.0, "value", "gt", bitmap=True)


@query(f"WITH a(ord, p) AS (VALUES (0, 5), (1, 2), (2, 5), (3, 99999999), (4, 0), (5, 7)) SELECT ord::BIGINT AS ord, pos FROM a JOIN {_pos('supplier', 's_suppkey')} ON pos = p WHERE s_acctbal > 1000")
def search_among(spark, d):
    return search.search(table(spark, d, "supplier"), 1000.0, "s_acctbal", "gt", all=True, among=[5, 2, 5, 99999999, 0, 7])


@query(f"SELECT pos FROM {_pos('orders', 'o_orderkey')} WHERE pos BETWEEN 100 AND 499 AND o_orderstatus = 'F'")
def search_range(spark, d):
    return search.search(table(spark, d, "orders"), "F", "o_orderstatus", all=True, span=(100, 499)).select(POS)


@query(f"SELECT count(*) AS n FROM (VALUES (1), (1), (3), (8)) a(p) JOIN {_pos('nation', 'n_nationkey')} ON pos = p WHERE n_regionkey > 0")
def count_among(spark, d):
    return search.count(table(spark, d, "nation"), 0, "n_regionkey", "gt", among=[1, 1, 3, 8])


@query("SELECT count(*) AS n FROM lineitem WHERE l_discount > 0.05")
def count_matches(spark, d):
    return search.count(table(spark, d, "lineitem"), 0.05, "l_discount", "gt")


@query(f"SELECT pos FROM {_pos('events', 'event_id')} WHERE NOT (value > 50)")
def search_boolean(spark, d):
    events = table(spark, d, "events")
    return search.search(Frame(events.df.withColumn("big", F.col("value") > 50), events.order), False, "big", all=True).select(POS)


@query("SELECT count(*) AS n FROM events WHERE value > 50")
def count_bits(spark, d):
    events = table(spark, d, "events")
    return search.bits_set(Frame(events.df.withColumn("big", F.col("value") > 50), events.order), "big")


@query(f"SELECT k AS key, coalesce(min(pos), -1)::BIGINT AS found FROM (VALUES ('FRANCE'), ('NATION_3'), ('nowhere')) a(k) LEFT JOIN {_pos('nation', 'n_nationkey')} ON n_name = k GROUP BY k")
def lookup_key(spark, d):
    return search.lookup(table(spark, d, "nation"), ["FRANCE", "NATION_3", "nowhere"], "n_name")


# ---- columns and rows ---------------------------------------------------------------------------


@query("SELECT o_totalprice, o_orderkey FROM orders")
def slice_columns(spark, d):
    return table(spark, d, "orders").slice(["o_totalprice", "o_orderkey"]).df


@query(f"SELECT a.pos AS pos, c_custkey, c_name FROM (VALUES (0, 7), (1, 3), (2, 7), (3, 0)) a(pos, p) JOIN {_pos('customer', 'c_custkey')} c ON c.pos = p".replace("a.pos AS pos", "a.pos::BIGINT AS pos"))
def get_indices(spark, d):
    return mutate.get(table(spark, d, "customer"), [7, 3, 7, 0], ["c_custkey", "c_name"]).df


@query(f"SELECT pos - 10 AS pos, c_custkey FROM {_pos('customer', 'c_custkey')} WHERE pos BETWEEN 10 AND 29")
def range_rows(spark, d):
    return sort.span(table(spark, d, "customer").slice(["c_custkey"]), 10, 29).df


@query(f"SELECT c_custkey, c_name FROM {_pos('customer', 'c_custkey')} WHERE pos = 4")
def index_row(spark, d):
    row = mutate.index(table(spark, d, "customer").slice(["c_custkey", "c_name"]), 4)
    return spark.createDataFrame([row], "c_custkey long, c_name string")


@query(f"SELECT pos, s_suppkey, 100.5::DOUBLE AS s_acctbal FROM {_pos('supplier', 's_suppkey')}")
def replace_column(spark, d):
    supplier = table(spark, d, "supplier").slice(["s_suppkey", "s_acctbal"])
    return supplier.with_column("s_acctbal", generate.constant(spark, 100.5, supplier.size(), "double")).df


@query("SELECT count(*) AS n, 5::INTEGER AS width FROM customer")
def table_size(spark, d):
    customer = table(spark, d, "customer")
    return spark.createDataFrame([(customer.size(), customer.width)], "n long, width int")


@query(f"SELECT pos, n_name, n_nationkey FROM {_pos('nation', 'n_nationkey')}")
def zip_columns(spark, d):
    nation = table(spark, d, "nation")
    return Frame.zip(["n_name", "n_nationkey"], [nation.slice(["n_name"]), nation.slice(["n_nationkey"])]).df


# ---- order --------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders")
def sort_inc(spark, d):
    return sort.sort(table(spark, d, "orders"), "o_orderdate", columns=["o_orderkey", "o_orderdate"]).df


@query("SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderpriority DESC, o_orderkey) - 1 AS pos FROM orders")
def sort_dec(spark, d):
    return sort.sort(table(spark, d, "orders"), "o_orderpriority", decreasing=True, columns=["o_orderkey", "o_orderpriority"]).df


@query("SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY lower(c_mktsegment), c_custkey) - 1 AS pos FROM customer")
def sort_nocase(spark, d):
    return sort.sort(table(spark, d, "customer"), "c_mktsegment", nocase=True, columns=["c_custkey", "c_mktsegment"]).df


@query(f"SELECT row_number() OVER (ORDER BY p_retailprice, pos) - 1 AS pos, pos AS value FROM {_pos('part', 'p_partkey')}")
def sort_indices(spark, d):
    return sort.sort_positions(table(spark, d, "part"), "p_retailprice")


@query(f"SELECT row_number() OVER (ORDER BY lower(c_mktsegment), pos) - 1 AS pos, pos AS value FROM {_pos('customer', 'c_custkey')} WHERE c_nationkey < 9")
def sort_indirect_nocase(spark, d):
    return sort.sort_indirect(table(spark, d, "customer"), F.col("c_nationkey") < 9, ["c_mktsegment"], nocase=True)


@query(f"SELECT row_number() OVER (ORDER BY p_brand, p_size, pos) - 1 AS pos, pos AS value FROM {_pos('part', 'p_partkey')} WHERE p_size > 20")
def sort_indirect_multikey(spark, d):
    part = table(spark, d, "part")
    return sort.sort_indirect(part, F.col("p_size") > 20, ["p_size", "p_brand"])


@query("SELECT * FROM (SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS pos, o_orderkey, o_totalprice FROM orders) WHERE pos < 20")
def top_k(spark, d):
    return sort.top_k(table(spark, d, "orders"), 20, "o_totalprice").df.select(POS, "o_orderkey", "o_totalprice")


@query("SELECT row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS pos, o_orderkey FROM orders")
def reverse_rows(spark, d):
    return sort.reverse(table(spark, d, "orders").slice(["o_orderkey"])).df


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25")
def head_rows(spark, d):
    return sort.head(table(spark, d, "orders").slice(["o_orderkey"]), 25).df


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 25")
def tail_rows(spark, d):
    return sort.tail(table(spark, d, "orders").slice(["o_orderkey"]), 25).df


@query(None)
def shuffle_rows(spark, d):
    return sort.shuffle(table(spark, d, "nation"), 7).df


# ---- joins and sets -----------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_basic(spark, d):
    return joins.join(table(spark, d, "orders"), table(spark, d, "customer"), ["o_custkey", "c_custkey"], t0cols=["o_orderkey", "o_custkey"], t1cols=["c_name"])


@query("SELECT n.*, r.* FROM nation n JOIN region r ON n_regionkey = r_regionkey")
def join_on_pair(spark, d):
    return joins.join(table(spark, d, "nation"), table(spark, d, "region"), ["n_regionkey", "r_regionkey"])


@query("SELECT a.n_name AS n_name, b.n_name AS n_name_again, row_number() OVER (ORDER BY a.n_regionkey, a.n_nationkey, b.n_nationkey) - 1 AS pos FROM nation a JOIN nation b USING (n_regionkey)")
def join_ordered_suffix(spark, d):
    nation = table(spark, d, "nation")
    return joins.join(nation, nation, "n_regionkey", t0cols=["n_name"], t1cols=["n_name"], suffix="_again", ordered=True)


@query("SELECT l_orderkey, l_extendedprice, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey")
def join_projected(spark, d):
    return joins.join(table(spark, d, "lineitem"), table(spark, d, "part"), ["l_partkey", "p_partkey"], t0cols=["l_orderkey", "l_extendedprice"], t1cols=["p_brand"])


@query("SELECT a.c_custkey, b.s AS s FROM customer a JOIN (VALUES ('Building', 1), ('MACHINERY', 2)) b(seg, s) ON lower(a.c_mktsegment) = lower(b.seg)")
def join_nocase(spark, d):
    few = Frame.create(spark, [("seg", "string"), ("s", "int")], [("Building", 1), ("MACHINERY", 2)])
    return joins.join(table(spark, d, "customer"), few, ["c_mktsegment", "seg"], nocase=True, t0cols=["c_custkey"], t1cols=["s"])


@query("SELECT c_nationkey AS value FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def intersect3_common(spark, d):
    return joins.intersect3(table(spark, d, "customer"), table(spark, d, "supplier"), "c_nationkey", "s_nationkey")[0]


@query("SELECT c_nationkey AS value FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def intersect3_a_only(spark, d):
    return joins.intersect3(table(spark, d, "customer"), table(spark, d, "supplier"), "c_nationkey", "s_nationkey")[1]


@query("SELECT o_custkey % 11 AS value FROM orders EXCEPT ALL SELECT c_nationkey FROM customer")
def intersect3_b_only(spark, d):
    orders = table(spark, d, "orders")
    folded = Frame(orders.df.withColumn("o_custkey", (F.col("o_custkey") % 11).cast("int")), orders.order)
    return joins.intersect3(table(spark, d, "customer"), folded, "c_nationkey", "o_custkey")[2]


@query("SELECT 'both' AS side, value, count(*) AS n FROM (SELECT value > 50 AS value FROM events INTERSECT ALL SELECT o_totalprice > 250000 FROM orders) GROUP BY ALL UNION ALL SELECT 'a', value, count(*) FROM (SELECT value > 50 AS value FROM events EXCEPT ALL SELECT o_totalprice > 250000 FROM orders) GROUP BY ALL UNION ALL SELECT 'b', value, count(*) FROM (SELECT o_totalprice > 250000 AS value FROM orders EXCEPT ALL SELECT value > 50 FROM events) GROUP BY ALL")
def intersect3_boolean(spark, d):
    events, orders = table(spark, d, "events"), table(spark, d, "orders")
    parts = joins.intersect3(Frame(events.df.withColumn("big", F.col("value") > 50), events.order), Frame(orders.df.withColumn("dear", F.col("o_totalprice") > 250000), orders.order), "big", "dear")
    out = [p.groupBy("value").agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "value", "n") for side, p in zip(("both", "a", "b"), parts, strict=True)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT lower(c_mktsegment) AS value FROM customer INTERSECT ALL SELECT lower(c_mktsegment) FROM customer WHERE c_acctbal > 0")
def intersect3_nocase(spark, d):
    customer = table(spark, d, "customer")
    other = Frame(customer.df.where("c_acctbal > 0").withColumn("c_mktsegment", F.initcap("c_mktsegment")), customer.order)
    return joins.intersect3(customer, other, "c_mktsegment", "c_mktsegment", nocase=True)[0].select(F.lower("value").alias("value"))


def _same(a: str, b: str) -> str:
    """SQL for whether two ordered selections hold the same rows in the same places."""
    return f"SELECT (SELECT count(*) FROM ({a}) a FULL JOIN ({b}) b ON a = b WHERE a.pos IS NULL OR b.pos IS NULL) = 0 AS equal"


_ORDERS = "SELECT row_number() OVER (ORDER BY {0}) - 1 AS pos, o_orderkey, {1} AS o_custkey FROM orders"


@query(_same(_ORDERS.format("o_orderkey", "o_custkey"), _ORDERS.format("-(-o_orderkey)", "o_custkey + 0")) + " UNION ALL " + _same(_ORDERS.format("o_orderkey", "o_custkey"), _ORDERS.format("o_orderkey", "CASE WHEN o_orderkey = 77 THEN -1 ELSE o_custkey END")))
def table_equal(spark, d):
    orders = table(spark, d, "orders").slice(["o_orderkey", "o_custkey"])
    changed = Frame(orders.df.withColumn("o_custkey", F.when(F.col("o_orderkey") == 77, -1).otherwise(F.col("o_custkey"))), orders.order)
    return search.equality(orders, sort.reverse(sort.reverse(orders))).unionByName(search.equality(orders, changed))


@query("SELECT typeof(any_value(n_nationkey)) = typeof(any_value(n_nationkey::TINYINT)) AS equal FROM nation UNION ALL " + _same(_pos("nation", "n_nationkey")[1:-1], _pos("nation", "n_nationkey")[1:-1]))
def table_identical(spark, d):
    nation = table(spark, d, "nation")
    return search.equality(nation, vector.cast(nation, "n_nationkey", "byte"), strict=True).unionByName(search.equality(nation, nation, strict=True))


@query(_same(_pos("(SELECT c_nationkey AS v, c_custkey FROM customer)", "c_custkey", "v")[1:-1], _pos("(SELECT c_nationkey + 0 AS v, c_custkey FROM customer)", "c_custkey", "v")[1:-1]) + " UNION ALL " + _same(_pos("(SELECT c_nationkey AS v, c_custkey FROM customer)", "c_custkey", "v")[1:-1], _pos("(SELECT c_nationkey AS v, c_custkey FROM customer)", "-c_custkey", "v")[1:-1]))
def column_equal(spark, d):
    customer = table(spark, d, "customer")
    keys = customer.slice(["c_nationkey"])
    return search.equality(keys, vector.cast(keys, 0, "wide")).unionByName(search.equality(keys, sort.reverse(keys)))


# ---- aggregation --------------------------------------------------------------------------------


@query("SELECT sum(o_custkey)::BIGINT AS sum FROM orders")
def sum_column(spark, d):
    return aggregate.sum(table(spark, d, "orders"), "o_custkey")


@query("SELECT round(sum(l_extendedprice), 1) AS sum FROM lineitem")
def sum_double(spark, d):
    return aggregate.fold(table(spark, d, "lineitem"), "+", "l_extendedprice").select(F.round("sum", 1).alias("sum"))


@query("SELECT min(p_retailprice) AS min, max(p_retailprice) AS max FROM part")
def minmax_values(spark, d):
    return aggregate.minmax(table(spark, d, "part"), "p_retailprice")


@query(f"SELECT arg_min(pos, (p_size, pos)) AS min, arg_max(pos, (p_size, -pos)) AS max FROM {_pos('part', 'p_partkey')}")
def minmax_indices(spark, d):
    return aggregate.minmax(table(spark, d, "part"), "p_size", positions=True)


_SIZES = "b AS (SELECT min(p_size) lo, max(p_size) hi, greatest(1, (max(p_size) - min(p_size) + 6) // 7) AS step FROM part), h AS (SELECT least(6, (p_size - lo) // step) AS bucket, p_size, pos FROM {0}, b), k AS (SELECT range AS bucket FROM range(7))".format(_pos("part", "p_partkey"))


@query(f"WITH {_SIZES} SELECT k.bucket, (lo + k.bucket * step)::BIGINT AS \"LowerBound\", count(h.bucket) AS \"Data\" FROM k CROSS JOIN b LEFT JOIN h ON h.bucket = k.bucket GROUP BY ALL")
def hist_count(spark, d):
    return aggregate.histogram(table(spark, d, "part"), 7, "p_size")


@query(f"WITH {_SIZES} SELECT k.bucket, (lo + k.bucket * step)::BIGINT AS \"LowerBound\", coalesce(sum(p_size), 0)::BIGINT AS \"Data\" FROM k CROSS JOIN b LEFT JOIN h ON h.bucket = k.bucket GROUP BY ALL")
def hist_sum(spark, d):
    return aggregate.histogram(table(spark, d, "part"), 7, "p_size", compute="sum")


@query("SELECT k.range AS bucket, (10 + k.range * 5)::BIGINT AS lower, count(p_size) AS n FROM range(4) k LEFT JOIN part ON p_size BETWEEN 10 AND 29 AND least(3, (p_size - 10) // 5) = k.range GROUP BY ALL")
def hist_minmax_opts(spark, d):
    return aggregate.histogram(table(spark, d, "part"), 4, "p_size", low=10, high=29, names=("lower", "n"))


@query("SELECT k.range AS bucket, k.range AS \"LowerBound\", count(value) AS \"Data\" FROM range(2) k LEFT JOIN events ON (value > 50)::BIGINT = k.range GROUP BY ALL")
def hist_boolean(spark, d):
    events = table(spark, d, "events")
    return aggregate.histogram(Frame(events.df.withColumn("big", F.col("value") > 50), events.order), 2, "big")


@query("SELECT k.range AS bucket, round(k.range * 25.0, 3)::DOUBLE AS lower, count(value) AS n FROM range(4) k LEFT JOIN events ON value BETWEEN 0 AND 100 AND least(3, floor(value / 25))::BIGINT = k.range GROUP BY ALL")
def hist_double(spark, d):
    return aggregate.histogram(table(spark, d, "events"), 4, "value", low=0.0, high=100.0, names=("lower", "n"))


@query(f"SELECT k.range AS bucket, count(pos) AS n, coalesce(min(pos), -1) AS first FROM range(5) k LEFT JOIN {_pos('part', 'p_partkey')} ON least(4, (p_size - 1) // 10) = k.range AND p_size BETWEEN 1 AND 50 GROUP BY ALL")
def hist_positions(spark, d):
    got = aggregate.histogram(table(spark, d, "part"), 5, "p_size", compute="positions", low=1, high=50)
    return got.select("bucket", F.size("Data").cast("long").alias("n"), F.coalesce(F.get("Data", F.lit(0)), F.lit(-1)).cast("long").alias("first"))


@query("SELECT k.range AS bucket, count(p_size) AS n, coalesce(sum(p_size), 0)::BIGINT AS total, coalesce(arg_min(p_size, p_partkey), -1)::BIGINT AS first FROM range(5) k LEFT JOIN part ON least(4, (p_size - 1) // 10) = k.range AND p_size BETWEEN 1 AND 50 GROUP BY ALL")
def hist_values(spark, d):
    got = aggregate.histogram(table(spark, d, "part"), 5, "p_size", compute="values", low=1, high=50)
    total = F.aggregate("Data", F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    return got.select("bucket", F.size("Data").cast("long").alias("n"), total.alias("total"), F.coalesce(F.get("Data", F.lit(0)), F.lit(-1)).cast("long").alias("first"))


@query(f"SELECT min(pos) AS first, CASE WHEN o_totalprice > 250000 THEN 'dear' ELSE 'cheap' END AS \"Category\", count(*) AS n FROM {_pos('orders', 'o_orderkey')} WHERE o_totalprice >= 50000 AND pos < 700 GROUP BY 2")
def categorize_function(spark, d):
    def price(pos, value):
        if pos >= 700:
            raise aggregate.Stop
        if value < 50000:
            raise aggregate.Skip
        return "dear" if value > 250000 else "cheap"

    got = aggregate.categorize_with(table(spark, d, "orders"), price, "o_totalprice", ltype="string")
    return got.select("first", "Category", F.size("Data").cast("long").alias("n"))


@query(f"SELECT min(pos) AS first, o_orderpriority AS \"Category\", count(*) AS n FROM {_pos('orders', 'o_orderkey')} GROUP BY o_orderpriority")
def categorize_values(spark, d):
    got = aggregate.categorize(table(spark, d, "orders"), "o_orderpriority")
    return got.select("first", "Category", F.size("Data").cast("long").alias("n"))


@query(f"SELECT min(pos) AS first, o_orderkey % 7 AS \"Category\", count(*) AS n, max(pos) AS last FROM {_pos('orders', 'o_orderkey')} WHERE pos < (SELECT min(pos) FROM {_pos('orders', 'o_orderkey')} WHERE o_totalprice > 499000) AND o_orderstatus <> 'P' GROUP BY 2")
def categorize_udf_expr(spark, d):
    got = aggregate.categorize(table(spark, d, "orders"), "o_orderkey", by=F.col("o_orderkey") % 7, positions=True, stop=F.col("o_totalprice") > 499000, skip=F.col("o_orderstatus") == "P")
    return got.select("first", "Category", F.size("Data").cast("long").alias("n"), F.array_max("Data").alias("last"))


@query("SELECT event_type AS \"Category\", count(*)::INTEGER AS \"Summary\" FROM events GROUP BY event_type")
def summarize_count(spark, d):
    return aggregate.summarize(aggregate.categorize(table(spark, d, "events"), "event_type")).drop("first")


@query("SELECT event_type AS \"Category\", sum(user_id)::BIGINT AS \"Summary\" FROM events GROUP BY event_type")
def summarize_sum(spark, d):
    return aggregate.summarize_by(table(spark, d, "events"), "event_type", "user_id", "sum")


@query("SELECT event_type AS \"Category\", sum(user_id)::BIGINT AS total FROM events GROUP BY event_type")
def summarize_nested_sum(spark, d):
    got = aggregate.categorize(table(spark, d, "events"), "user_id", by=F.col("event_type"))
    return aggregate.summarize(got, compute="sum", name="total").drop("first")


@query("SELECT event_type AS \"Category\", round(avg(value), 4) AS \"Summary\" FROM events GROUP BY event_type")
def summarize_avg_udf(spark, d):
    @F.pandas_udf("double")
    def mean(v: pd.Series) -> float:
        return float(v.mean())

    got = aggregate.summarize_by(table(spark, d, "events"), "event_type", "value", mean)
    return got.select("Category", F.round("Summary", 4).alias("Summary"))


@query(f"SELECT min(pos) AS first, p_brand AS value FROM {_pos('part', 'p_partkey')} GROUP BY p_brand")
def distinct_first(spark, d):
    return aggregate.distinct(table(spark, d, "part"), "p_brand")


# ---- vector math --------------------------------------------------------------------------------


def _math(spark, d, name, key, **made) -> DataFrame:
    """Each operand built from the named table, under its name beside the key."""
    frame = table(spark, d, name)
    column = lambda n: vector.operand(frame, n)
    out = {n: f(column) for n, f in made.items()}
    return frame.df.select(key, *(o.c.alias(n) for n, o in out.items()))


@query("SELECT p_partkey, p_size + p_partkey + 5 AS v, round(p_size + p_retailprice, 2) AS w, p_size - 1 AS x, (p_size * 2)::INTEGER AS y FROM part")
def math_add_mixed(spark, d):
    got = _math(spark, d, "part", "p_partkey", v=lambda c: math("+", c("p_size"), c("p_partkey"), 5), w=lambda c: math("+", c("p_size"), c("p_retailprice")), x=lambda c: math("-", c("p_size"), 1), y=lambda c: math("*", c("p_size"), 2))
    return got.withColumn("w", F.round("w", 2))


@query("SELECT p_partkey, floor((p_size - 25) / -7.0)::INTEGER AS a, floor((25 - p_size) / 4.0)::INTEGER AS b FROM part")
def math_floor_div(spark, d):
    return _math(spark, d, "part", "p_partkey", a=lambda c: math("/", math("-", c("p_size"), 25), -7), b=lambda c: math("/", math("-", 25, c("p_size")), 4))


@query("SELECT s_suppkey, CASE WHEN s_nationkey = 0 THEN 'inf' ELSE round(100.0 / s_nationkey, 6)::VARCHAR END AS v FROM supplier")
def math_divide_double(spark, d):
    got = _math(spark, d, "supplier", "s_suppkey", v=lambda c: math("/", 100.0, c("s_nationkey")))
    return got.select("s_suppkey", F.when(F.col("v") == float("inf"), "inf").otherwise(F.round("v", 6).cast("string")).alias("v"))


@query("SELECT p_partkey, round(pow(1.01, pow(p_size, 2.0) / 1.0), 6) AS v FROM part WHERE p_size < 20")
def math_pow_right(spark, d):
    got = _math(spark, d, "part", "p_partkey", v=lambda c: math("**", 1.01, c("p_size"), 2), size=lambda c: c("p_size"))
    return got.where("size < 20").select("p_partkey", F.round("v", 6).alias("v"))


@query("SELECT p_partkey, p_size & 12 AS a, p_size | 3 AS o, xor(p_size, 21) AS x FROM part")
def math_bitops(spark, d):
    return _math(spark, d, "part", "p_partkey", a=lambda c: math("&", c("p_size"), 12), o=lambda c: math("|", c("p_size"), 3), x=lambda c: math("^", c("p_size"), 21))


@query("SELECT p_partkey, ((((p_size::BIGINT * 100000007) % 4294967296) + 6442450944) % 4294967296 - 2147483648)::INTEGER AS v FROM part")
def math_wrap_int(spark, d):
    return _math(spark, d, "part", "p_partkey", v=lambda c: math("*", c("p_size"), 100000007))


@query("SELECT p_partkey, (((p_partkey::HUGEINT * 4611686018427387905) % 18446744073709551616 + 9223372036854775808) % 18446744073709551616 - 9223372036854775808)::BIGINT AS v FROM part")
def math_wrap_wide(spark, d):
    return _math(spark, d, "part", "p_partkey", v=lambda c: math("*", c("p_partkey"), 4611686018427387905))


@query("SELECT p_partkey, (10 < p_size AND p_size < 40) AS v, p_size <> 7 AS w FROM part")
def math_chain_cmp(spark, d):
    return _math(spark, d, "part", "p_partkey", v=lambda c: math("<", 10, c("p_size"), 40), w=lambda c: math("!=", c("p_size"), 7))


@query("SELECT s_suppkey, s_nationkey::VARCHAR < s_name AS v FROM supplier")
def math_compare_text(spark, d):
    return _math(spark, d, "supplier", "s_suppkey", v=lambda c: math("<", c("s_nationkey"), c("s_name")))


@query("SELECT s_suppkey, (s_nationkey <> 0 AND s_acctbal <> 0) AS a, (s_nationkey <> 0 OR s_acctbal <> 0) AS o, ((s_nationkey <> 0) <> (s_acctbal <> 0)) AS x FROM supplier")
def math_logic(spark, d):
    return _math(spark, d, "supplier", "s_suppkey", a=lambda c: math("&&", c("s_nationkey"), c("s_acctbal")), o=lambda c: math("||", c("s_nationkey"), c("s_acctbal")), x=lambda c: math("^^", c("s_nationkey"), c("s_acctbal")))


@query("SELECT p_partkey, ((p_size * 17) & 255)::SMALLINT AS b, trunc(p_retailprice)::INTEGER AS i, (trunc(-p_retailprice)::BIGINT & 4294967295)::BIGINT AS u, p_size <> 0 AS t, p_size::VARCHAR AS s FROM part")
def cast_lossy(spark, d):
    part = table(spark, d, "part")
    size, price = vector.operand(part, "p_size"), vector.operand(part, "p_retailprice")
    return part.df.select("p_partkey", L.cast(math("*", size, 17).c, "int", "byte").alias("b"), L.cast(price.c, "double", "int").alias("i"), L.cast(-price.c, "double", "uint").alias("u"), L.cast(size.c, "int", "boolean").alias("t"), L.cast(size.c, "int", "string").alias("s"))


# ---- writing by position ------------------------------------------------------------------------

_NATIONS = _pos("nation", "n_nationkey", "n_nationkey, n_name")


@query(f"SELECT pos, n_nationkey, CASE WHEN pos IN (1, 3, 24) OR n_nationkey > 20 THEN 'X' ELSE n_name END AS n_name FROM {_NATIONS}")
def fill_selected(spark, d):
    nation = table(spark, d, "nation").slice(["n_nationkey", "n_name"])
    filled = mutate.fill(nation, "X", [1, 3, 24], columns=["n_name"])
    return mutate.fill(filled, "X", F.col("n_nationkey") > 20, columns=["n_name"]).df


@query(f"SELECT pos, n_nationkey, n_name FROM {_NATIONS} WHERE pos NOT IN (2, 4) UNION ALL VALUES (2, 101, 'b'), (4, 102, 'c'), (26, 104, 'e'), (25, 103, 'd')")
def place_values(spark, d):
    nation = table(spark, d, "nation").slice(["n_nationkey", "n_name"])
    return mutate.place(nation, [(100, "a"), (101, "b"), (102, "c"), (104, "e"), (103, "d")], [2, 2, 4, 26, 25]).df


@query(f"SELECT pos, n_nationkey, n_name FROM {_NATIONS} WHERE pos < 23 UNION ALL VALUES (23, 1, 'p'), (24, 2, 'q'), (25, 3, 'r')")
def put_range(spark, d):
    nation = table(spark, d, "nation").slice(["n_nationkey", "n_name"])
    return mutate.put(nation, [(1, "p"), (2, "q"), (3, "r")], "end-2").df


@query(f"SELECT CASE WHEN pos >= 5 THEN pos + 3 ELSE pos END AS pos, n_nationkey, n_name FROM {_NATIONS} UNION ALL VALUES (5, 7, 'new'), (6, 7, 'new'), (7, 7, 'new')")
def insert_rows(spark, d):
    return mutate.insert(table(spark, d, "nation").slice(["n_nationkey", "n_name"]), (7, "new"), 5, 3).df


@query(f"SELECT CASE WHEN pos >= 10 THEN pos + 5 ELSE pos END AS pos, n_nationkey, n_name FROM {_NATIONS} UNION ALL SELECT pos + 10, r_regionkey, r_name FROM {_pos('region', 'r_regionkey')}")
def inject_rows(spark, d):
    return mutate.inject(table(spark, d, "nation").slice(["n_nationkey", "n_name"]), table(spark, d, "region").slice(["r_regionkey", "r_name"]), 10).df


@query(f"SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, n_nationkey, n_name FROM {_NATIONS} WHERE pos NOT IN (0, 3, 24)")
def delete_rows(spark, d):
    return mutate.delete(table(spark, d, "nation").slice(["n_nationkey", "n_name"]), [3, 0, 3, 24, 4000]).df


@query(f"SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, o_orderkey FROM {_pos('orders', 'o_orderkey')} WHERE pos NOT BETWEEN 100 AND 299")
def delete_range(spark, d):
    return mutate.delete(table(spark, d, "orders").slice(["o_orderkey"]), low=100, high=299).df


# ---- generators ---------------------------------------------------------------------------------


@query("SELECT range AS pos, (5 + range * 3)::INTEGER AS value FROM range(32)")
def series(spark, d):
    return generate.series(spark, 5, 100, 3).df


@query("SELECT range AS pos, round(range * 0.75, 6)::DOUBLE AS value FROM range(17)")
def linspace(spark, d):
    return generate.linspace(spark, 0, 12, 17).df.select(POS, F.round("value", 6).alias("value"))


@query("SELECT range AS pos, round(pow(2.0, range * 0.5), 6)::DOUBLE AS value FROM range(9)")
def logspace(spark, d):
    return generate.logspace(spark, 0, 4, 9, base=2).df.select(POS, F.round("value", 6).alias("value"))


@query("SELECT range AS pos, range IN (1, 3, 8) AS value FROM range(12)")
def bitmap0(spark, d):
    return generate.bitmap0(spark, 12, [3, 1, 8]).df


@query("SELECT range AS pos, 1::INTEGER AS value FROM range(40)")
def ones(spark, d):
    return generate.ones(spark, 40).df


@query("SELECT range AS pos, 0::DOUBLE AS value FROM range(7)")
def zeroes(spark, d):
    return generate.zeroes(spark, 7, "double").df


@query("SELECT range AS pos, range NOT IN (0, 4) AS value FROM range(6)")
def bitmap1(spark, d):
    return generate.bitmap1(spark, 6, [4, 0]).df


@query("SELECT range AS pos, trunc(range * 2.5)::INTEGER AS value FROM range(8)")
def linspace_open(spark, d):
    return generate.linspace(spark, 0, 20, 8, ltype="int", open=True).df


@query(None)
def random_values(spark, d):
    return generate.random(spark, "int", 1000, -50, 50, (1, 2)).df


# ---- selector language --------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE (o_totalprice > 50000 AND o_orderstatus <> 'F') OR lower(o_orderpriority) = '1-urgent' AND o_custkey * 2 + 1 < 100")
def selector_string(spark, d):
    orders = table(spark, d, "orders")
    got = orders.df.where(condition(orders, "(o_totalprice > 50000 && o_orderstatus != 'F') || o_orderpriority =^ '1-URGENT' && o_custkey * 2 + 1 < 100"))
    return got.select("o_orderkey", "o_totalprice", "o_orderstatus")


@query(f"SELECT o_orderkey FROM {_pos('orders', 'o_orderkey')} WHERE pos BETWEEN 9 AND 110 AND regexp_matches(o_orderpriority, '^[1-3]') AND o_custkey > 10")
def selector_range(spark, d):
    return select_expr(table(spark, d, "orders"), "9:110 && o_orderpriority ~ '^[1-3]' && @@.o_custkey > $least", {"least": 10}).df.select("o_orderkey")


@query("SELECT event_id, event_type, value FROM events WHERE event_type GLOB '*i*' AND NOT (value > 80) AND user_id <> 3")
def ui_filter(spark, d):
    events = table(spark, d, "events")
    return events.df.where(table_filter(events, {"event_type": "* *i*", "value": "<= 80", "user_id": "!= 3"})).select("event_id", "event_type", "value")


@query("SELECT max(length(p_name))::INTEGER AS width FROM part")
def column_width(spark, d):
    from .operators.display import text_width

    return text_width(table(spark, d, "part"), "p_name")




@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def csv_round_trip(spark, d):
    from .plans.scratch import scratch_path
    from .sources.csv import csv_export, csv_import

    path = scratch_path(spark, "csv")
    csv_export(table(spark, d, "supplier").slice(["s_suppkey", "s_name", "s_acctbal"]), path, header=["s_suppkey", "s_name", "s_acctbal"])
    return csv_import(spark, path, header=True).values


@query(f"SELECT pos, o_orderkey, CASE WHEN o_totalprice < 20000 THEN o_totalprice + 1000 ELSE o_totalprice END AS o_totalprice FROM {_pos('orders', 'o_orderkey')} WHERE pos < 400")
def statement_assignment(spark, d):
    work = Workspace(spark, Orders=table(spark, d, "orders").slice(["o_orderkey", "o_totalprice"]))
    work.run("Orders = Orders[0:399]")
    return work.run("Orders.o_totalprice[Orders.o_totalprice < 20000] = Orders.o_totalprice[Orders.o_totalprice < 20000] + 1000").df


@query(f"SELECT (SELECT count(*) FROM supplier) AS size, (SELECT min(pos) FROM {_pos('supplier', 's_suppkey')} WHERE s_name = 'Supplier#000000007') AS key, (SELECT sum(s_nationkey)::BIGINT FROM supplier) AS total, (SELECT min(pos) FROM {_pos('supplier', 's_suppkey')} WHERE s_acctbal > 5000) AS hit")
def statement_values(spark, d):
    work = Workspace(spark, S=table(spark, d, "supplier"))
    values = [work.run(x) for x in ("%S", "S.s_name.'Supplier#000000007'", "@sum(S.s_nationkey)", "@search S.s_acctbal > 5000")]
    return spark.createDataFrame([tuple(values)], "size long, key long, total long, hit long")


@query(f"SELECT row_number() OVER (ORDER BY s_acctbal DESC, pos) - 1 AS pos, s_acctbal FROM {_pos('supplier', 's_suppkey')} WHERE NOT (s_nationkey < 10)")
def statement_sort(spark, d):
    work = Workspace(spark, S=table(spark, d, "supplier"))
    work.run("S = @delete(S, S.s_nationkey < 10)")
    return work.run("@sort S.s_acctbal decreasing").df
