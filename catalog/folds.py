"""Seeded splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views
from catalog.registry import query
from seriesloom.operators import split


def _order(column: str, seed: int = 42) -> str:
    return f"md5(concat_ws('|', cast({column} AS varchar), '{seed}')), cast({column} AS varchar)"


def _fold(rank: str, n: str, k: int) -> str:
    """Fold of a 1-based rank when n ids go into k folds, the first n % k of them one larger."""
    big, size = f"({n} % {k})", f"({n} // {k})"
    return (
        f"cast(CASE WHEN {rank} <= {big} * ({size} + 1) THEN ({rank} - 1) // ({size} + 1) "
        f"ELSE {big} + ({rank} - 1 - {big} * ({size} + 1)) // {size} END AS int)"
    )


_CUSTOMERS = f"""SELECT o_custkey, row_number() OVER (ORDER BY {_order("o_custkey")}) AS r, count(*) OVER () AS n
    FROM (SELECT DISTINCT o_custkey FROM orders)"""


@query(
    "split_by_id",
    f"""SELECT o_orderkey, o_custkey, CASE WHEN r <= floor(0.8 * n) THEN 'a' ELSE 'b' END AS part
    FROM orders JOIN ({_CUSTOMERS}) USING (o_custkey)""",
)
def split_by_id(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    a, b = split.split_by_id(orders, "o_custkey", 0.8)
    return a.withColumn("part", F.lit("a")).unionByName(b.withColumn("part", F.lit("b")))


@query(
    "split_rows",
    f"""SELECT l_orderkey, l_linenumber, CASE WHEN r <= floor(0.7 * n) THEN 'a' ELSE 'b' END AS part FROM (
    SELECT *, row_number() OVER (ORDER BY {_order("concat_ws('|', l_orderkey, l_linenumber)")}) AS r, count(*) OVER () AS n
    FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) JOIN (SELECT l_orderkey, l_linenumber FROM lineitem)
    USING (l_orderkey, l_linenumber)""",
)
def split_rows(spark, sf_dir):
    lines = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    a, b = split.split_rows(lines, ["l_orderkey", "l_linenumber"], 0.7)
    return a.withColumn("part", F.lit("a")).unionByName(b.withColumn("part", F.lit("b")))


def _subset_sql(limit: str) -> str:
    return f"""SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY {_order("o_orderkey")}) AS r,
        count(*) OVER () AS n FROM orders) WHERE r <= {limit}"""


@query("subset_rows", _subset_sql("floor(0.25 * n)"))
def subset_rows(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return split.subset_rows(orders, "o_orderkey", 0.25)


@query("subset_rows_count", _subset_sql("500"))
def subset_rows_count(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return split.subset_rows(orders, "o_orderkey", 500)


@query(
    "group_kfold",
    f"""SELECT o_orderkey, o_custkey, {_fold("r", "n", 5)} AS fold
    FROM orders JOIN ({_CUSTOMERS}) USING (o_custkey)""",
)
def group_kfold(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return split.group_kfold(orders, "o_custkey", 5)


@query(
    "inner_cv",
    f"""SELECT o_orderkey, o_orderstatus, {_fold("r", "n", 5)} AS fold FROM (
    SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_order("o_orderkey")}) AS r,
    count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)""",
)
def inner_cv(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return split.stratified_kfold(orders, "o_orderkey", "o_orderstatus", 5)


@query(
    "leave_one_group_out",
    """SELECT o_custkey, o_orderkey, c_mktsegment AS fold FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE c_nationkey <> 3""",
)
def leave_one_group_out(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    groups = (
        views.table(spark, sf_dir, "customer")
        .filter("c_nationkey <> 3")
        .select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("group"))
    )
    return split.leave_one_group_out(orders, groups, on="o_custkey")


@query(
    "hash_rank",
    f"""SELECT o_orderkey, row_number() OVER (ORDER BY {_order("o_orderkey", 7)}) AS place FROM orders""",
)
def hash_rank(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders").select("o_orderkey")
    return split.hash_rank(orders, "o_orderkey", 7, "place")
