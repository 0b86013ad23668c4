import pytest
from pyspark.sql import functions as F

from quarrylens.plans.table_plan import Filter, PlanError, TablePlan, TableQuery, parse_filter

ROWS = [
    (1, "RunTask", 500, True),
    (2, "RunTask", 1500, None),
    (3, "Paint", 1800, False),
    (4, None, None, True),
    (5, "apple", 2500, False),
]


@pytest.fixture(scope="module")
def table(spark):
    df = spark.createDataFrame(ROWS, "id int, name string, durUs int, ok boolean")
    return TableQuery(df, (F.col("id").asc(),))


def ids(query):
    return [r["id"] for r in query.rows().collect()]


@pytest.mark.parametrize(
    "column,op,value,want",
    [
        ("durUs", "between", [1000, 2000], [2, 3]),
        ("durUs", "between", {"lower": None, "upper": 600}, [1, 4]),
        ("name", "=", "RunTask", [1, 2]),
        ("name", "=", None, [4]),
        ("id", "=", "1", []),
        ("ok", "=", True, [1, 4]),
        ("name", "!=", "RunTask", [3, 4, 5]),
        ("id", "!=", "1", [1, 2, 3, 4, 5]),
        ("name", "in", ["Paint", None], [3, 4]),
        ("name", "contains", "a", [1, 2, 3, 5]),
        ("name", "startsWith", "P", [3]),
        ("durUs", "endsWith", 500, [1, 2, 5]),
        ("durUs", ">", 1500, [3, 5]),
        ("durUs", ">=", 1500, [2, 3, 5]),
        ("durUs", ">=", None, [1, 2, 3, 4, 5]),
        ("durUs", "<", 1500, [1, 4]),
        ("durUs", "<=", 1500, [1, 2, 4]),
        ("durUs", "<", None, []),
        ("name", ">", "Paint", [1, 2, 5]),
    ],
)
def test_filters(table, column, op, value, want):
    assert ids(table.where(column, op, value)) == want


def test_collation_orders_letters_before_case(table):
    by_letter = TableQuery(table.df, table.native_order, collation="UNICODE").order_by("name")
    assert ids(by_letter) == [4, 5, 3, 1, 2]
    assert ids(table.order_by("name")) == [4, 3, 1, 2, 5]


def test_order_offset_limit_select(table):
    assert ids(table.order_by("durUs", "desc")) == [5, 3, 2, 1, 4]
    assert ids(table.order_by("durUs").order_by("ok")) == [2, 3, 5, 1, 4]
    assert ids(table.offset(3)) == [4, 5]
    assert ids(table.order_by("durUs").offset(1).limit(2)) == [1, 2]
    assert ids(table.limit(0)) == []
    kept = table.where("durUs", ">", 600).order_by("durUs").select(["name", "nothing"])
    assert [tuple(r) for r in kept.rows().collect()][0] == ("RunTask", None)
    assert table.where("name", "=", "Paint").first()["id"] == 3
    assert table.where("name", "=", "none").first() is None
    assert table.limit(1).offset(2).where("ok", "=", True).count() == 2


def test_plans_merge_and_stay_unchanged(table):
    base = table.where("ok", "=", True).limit(1)
    more = base.query({"where": [{"column": "id", "op": ">", "value": 1}], "limit": 9})
    assert ids(more) == [4] and ids(base) == [1]
    assert more.plan().where == (Filter("ok", "=", True), Filter("id", ">", 1))
    assert TablePlan.from_dict({}) == TablePlan()
    between = {"column": "id", "op": "between", "lower": 2, "upper": 3}
    assert ids(table.query({"where": [between]})) == [2, 3]


@pytest.mark.parametrize(
    "text,value", [("a:=:true", True), ("a:=:null", None), ("a:>:1.5", 1.5), ("a:=:x:y", "x:y"), ("a:=:7", 7)]
)
def test_text_filters(text, value):
    assert parse_filter(text).value == value


def test_errors(table):
    with pytest.raises(PlanError, match="Valid operators: =, !=, in"):
        table.where("id", "~", 1)
    with pytest.raises(PlanError, match="Available columns: id, name"):
        table.where("nothing", "=", 1).rows()
    with pytest.raises(PlanError, match="Available columns"):
        table.where("nothing", "=", 1).count()
    for bad in (-1, float("inf"), "x", True):
        with pytest.raises(PlanError):
            table.limit(bad)
        with pytest.raises(PlanError):
            table.offset(bad)
    with pytest.raises(PlanError):
        table.select([])
    with pytest.raises(PlanError):
        table.where("id", "between", [1])
    with pytest.raises(PlanError):
        parse_filter("id")
