"""The table query clauses over lineitem, orders and customer."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrylens.operators.lineage import cut
from quarrylens.plans.table_plan import TablePlan, TableQuery, parse_filter
from quarrylens.queries.registry import query
from quarrylens.sources.star_events import read_table

# Some statuses and priorities read as null, for the null rules.
NULLED = """(SELECT o_orderkey, o_custkey, o_totalprice, nullif(o_orderstatus, 'P') AS status,
  nullif(o_orderpriority, '5-LOW') AS priority, nullif(o_custkey % 7, 3) AS bucket FROM orders)"""


def _orders(spark, sf_dir):
    rows = read_table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_totalprice",
        F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"),
        F.nullif(F.col("o_custkey") % 7, F.lit(3)).alias("bucket"),
    )
    return TableQuery(rows, (F.col("o_orderkey").asc(),))


def _filters(name, clauses, where):
    sql = f"SELECT * FROM {NULLED} WHERE {where}"

    @query(name, sql)
    def run(spark, sf_dir):
        table = _orders(spark, sf_dir)
        for column, op, value in clauses:
            table = table.where(column, op, value)
        return table.rows()

    return run


_filters("b02_where_equal", [("status", "=", "F")], "status = 'F'")
_filters("b02_where_equal_null", [("status", "=", None)], "status IS NULL")
_filters("b02_where_equal_other_type", [("o_custkey", "=", "7")], "FALSE")
_filters("b03_where_not_equal", [("status", "!=", "F")], "status IS DISTINCT FROM 'F'")
_filters("b04_where_in", [("priority", "in", ["1-URGENT", None])], "priority IS NULL OR priority = '1-URGENT'")
_filters("b04_where_in_scalar", [("bucket", "in", 2)], "coalesce(bucket = 2, FALSE)")
_filters("b05_where_contains", [("priority", "contains", "EDI")], "coalesce(contains(priority, 'EDI'), FALSE)")
_filters("b06_where_starts_with", [("priority", "startsWith", "1-")], "coalesce(starts_with(priority, '1-'), FALSE)")
_filters("b07_where_ends_with", [("o_custkey", "endsWith", "7")], "ends_with(CAST(o_custkey AS VARCHAR), '7')")
_filters("b08_where_greater", [("bucket", ">", 4)], "coalesce(bucket > 4, FALSE)")
_filters("b09_where_at_least", [("status", ">=", "O")], "coalesce(status >= 'O', FALSE)")
_filters("b10_where_less", [("bucket", "<", 2)], "bucket IS NULL OR bucket < 2")
_filters("b11_where_at_most", [("priority", "<=", "2-HIGH")], "priority IS NULL OR priority <= '2-HIGH'")
_filters("b12_where_between", [("o_totalprice", "between", [100000, 200000])], "o_totalprice BETWEEN 100000 AND 200000")
_filters("b12_where_between_open", [("bucket", "between", {"lower": 1, "upper": 4})], "coalesce(bucket BETWEEN 1 AND 4, FALSE)")
_filters("b14_where_all", [("status", "=", "O"), ("bucket", ">=", 2), ("priority", "!=", None)], "status = 'O' AND bucket >= 2 AND priority IS NOT NULL")


@query("b01_select", "SELECT l_orderkey, l_quantity, CAST(NULL AS VARCHAR) AS missing FROM lineitem WHERE l_returnflag = 'R'")
def select_columns(spark, sf_dir):
    table = TableQuery(read_table(spark, sf_dir, "lineitem"))
    return table.where("l_returnflag", "=", "R").select(["l_orderkey", "l_quantity", "missing"]).rows()


def _positions(rows):
    """``rows`` with their places in the order they come in, found without a window over all of them."""
    written = cut(rows.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = written.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.col("_at") - F.shiftleft("_part", 33)
    return written.withColumn("_part", part).join(starts, "_part").withColumn("position", F.col("_start") + inside).drop("_at", "_part", "_start")


def _mixed_case(spark, sf_dir):
    """Customers whose segment is in lower case for every other one."""
    name = F.concat(F.left("c_name", F.lit(1)), "c_mktsegment")
    mixed = F.when(F.col("c_custkey") % 2 == 0, F.lower(name)).otherwise(name).alias("s")
    return read_table(spark, sf_dir, "customer").select("c_custkey", mixed)


@query(
    "b13_collated_order",
    """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN lower(left(c_name, 1) || c_mktsegment) ELSE left(c_name, 1) || c_mktsegment END AS s FROM customer)
SELECT c_custkey, s, row_number() OVER (ORDER BY lower(s), s = lower(s) DESC, c_custkey) - 1 AS position FROM c
WHERE lower(s) > 'cfurniture' OR s = 'CFURNITURE'""",
)
def collated_order(spark, sf_dir):
    """Letters before case, and lower case first where only the case differs."""
    table = TableQuery(_mixed_case(spark, sf_dir), (F.col("c_custkey").asc(),), collation="UNICODE")
    kept = table.where("s", ">=", "cFURNITURE").order_by("s")
    return _positions(kept.select(["c_custkey", "s"]).rows())


@query(
    "b17_order_by",
    f"""SELECT o_orderkey, status, priority,
  row_number() OVER (ORDER BY priority DESC NULLS LAST, status ASC NULLS FIRST, o_orderkey) - 1 AS position FROM {NULLED}""",
)
def order_by(spark, sf_dir):
    plan = TablePlan(order_by=(("priority", "desc"), ("status", "asc")))
    return _positions(_orders(spark, sf_dir).query(plan).select(["o_orderkey", "status", "priority"]).rows())


@query(
    "b17_order_by_replaced",
    f"SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS position FROM {NULLED}",
)
def order_by_replaced(spark, sf_dir):
    table = _orders(spark, sf_dir).order_by("status").order_by("o_totalprice", "desc")
    return _positions(table.select(["o_orderkey"]).rows())


@query("b18_offset", f"SELECT o_orderkey, o_totalprice FROM {NULLED} ORDER BY o_totalprice, o_orderkey OFFSET 100")
def offset(spark, sf_dir):
    table = _orders(spark, sf_dir).order_by("o_totalprice").offset(100)
    return table.select(["o_orderkey", "o_totalprice"]).rows()


@query("b19_limit", "SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_partkey LIMIT 10")
def limit(spark, sf_dir):
    order = (F.col("l_orderkey").asc(), F.col("l_partkey").asc())
    table = TableQuery(read_table(spark, sf_dir, "lineitem"), order)
    top = table.order_by("l_extendedprice", "desc").limit(10)
    return top.select(["l_orderkey", "l_partkey", "l_extendedprice"]).rows()


@query("b20_first", f"SELECT o_orderkey, status FROM {NULLED} WHERE status = 'F' ORDER BY o_orderkey LIMIT 1")
def first(spark, sf_dir):
    return _orders(spark, sf_dir).where("status", "=", "F").limit(1).select(["o_orderkey", "status"]).rows()


@query("b21_count", f"SELECT count(*) AS n FROM {NULLED} WHERE bucket IS NULL OR bucket < 5")
def count(spark, sf_dir):
    counted = _orders(spark, sf_dir).where("bucket", "<", 5).limit(3).offset(2)
    return spark.createDataFrame([(counted.count(),)], "n bigint")


@query(
    "b21_count_collated",
    "SELECT count(*) AS n FROM customer WHERE lower(left(c_name, 1) || c_mktsegment) < 'cf'",
)
def count_collated(spark, sf_dir):
    """Letters before case: half of the names are in lower case."""
    table = TableQuery(_mixed_case(spark, sf_dir), collation="UNICODE")
    return spark.createDataFrame([(table.where("s", "<", "cF").count(),)], "n bigint")


@query(
    "b22_plan_merge",
    f"""SELECT o_orderkey, bucket FROM {NULLED} WHERE status = 'O' AND bucket > 1
ORDER BY bucket DESC NULLS LAST, o_orderkey LIMIT 40 OFFSET 10""",
)
def plan_merge(spark, sf_dir):
    base = _orders(spark, sf_dir).where("status", "=", "O").order_by("status").limit(5)
    extra = {
        "where": [{"column": "bucket", "op": ">", "value": 1}],
        "orderBy": [{"column": "bucket", "direction": "desc"}],
        "offset": 10,
        "limit": 40,
        "select": ["o_orderkey", "bucket"],
    }
    return base.query(extra).rows()


@query("b23_text_filter", f"SELECT o_orderkey, bucket, priority FROM {NULLED} WHERE (bucket IS NULL OR bucket <= 3) AND priority IS NOT NULL")
def text_filter(spark, sf_dir):
    clauses = (parse_filter("bucket:<=:3"), parse_filter("priority:!=:null"))
    table = _orders(spark, sf_dir).query(TablePlan(where=clauses))
    return table.select(["o_orderkey", "bucket", "priority"]).rows()
