"""Loading the canonical tables from CSV and Parquet."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest

from basketry.plans import customers, journey, orders
from basketry.sources.files import read_csv, read_parquet, rejects, unparsed

ORDERS_CSV = '''\
Order_Total_Price,Order_ID,Customer_Name,Order_Created_At,Order_Cancelled_At,Extra,Product_ID
,1,"Ann, the ""first""",2024-01-06T00:05:00+01:00,,kept,7.0
20.00,1,Ann,2024-01-06 00:05:00,,NaN,8
5.5,2,Bob,not a time,2024-02-01,,x
n/a,,,"",,,
'''


@pytest.fixture
def orders_csv(tmp_path):
    path = tmp_path / "orders.csv"
    path.write_text(ORDERS_CSV)
    return str(path)


def test_csv_is_read_by_name_and_coerced(spark, orders_csv):
    df = read_csv(spark, "orders", orders_csv)
    got = [r.asDict() for r in df.orderBy("row_order").collect()]
    assert [r["Order_ID"] for r in got] == ["1", "1", "2", None]
    assert [r["Order_Total_Price"] for r in got] == [None, Decimal("20.00"), Decimal("5.50"), None]
    assert got[0]["Customer_Name"] == 'Ann, the "first"'
    assert [r["Order_Created_At"] for r in got] == [
        dt.datetime(2024, 1, 5, 23, 5), dt.datetime(2024, 1, 6, 0, 5), None, None,
    ]
    assert [r["Order_Cancelled_At"] for r in got] == [None, None, "2024-02-01", None]
    assert [r["Product_ID"] for r in got] == ["7", "8", "x", None]
    assert [r["Extra"] for r in got] == ["kept", None, None, None]


def test_text_ids_and_other_time_forms_are_kept(spark, tmp_path, one, rows):
    path = tmp_path / "orders.csv"
    path.write_text(
        "Order_ID,Customer_Name,Order_Total_Price,Order_Created_At\n"
        "#1001,Ann,5,2022/05/01 10:00\n#1002,Bob,7,05/02/2022 11:00\n"
    )
    df = read_csv(spark, "orders", str(path))
    assert one(orders.total(df)) == 2
    assert rows(customers.top_spend(df)) == [("Ann", Decimal("5.00")), ("Bob", Decimal("7.00"))]
    assert {r.Hour_Of_Day for r in orders.by_hour(df).collect() if r.Number_Of_Orders} == {11, 12}
    assert {r.column: r.texts for r in unparsed(spark, "orders", str(path)).collect()} == dict.fromkeys(
        ("Order_ID", "Customer_Name", "Order_Total_Price", "Order_Created_At"), 0
    )
    strict = unparsed(spark, "orders", str(path), time_formats=())
    assert {r.column: r.texts for r in strict.collect()}["Order_Created_At"] == 2


def test_files_are_ordered_by_path_or_by_a_column(spark, tmp_path):
    folder = tmp_path / "two files"
    folder.mkdir()
    for name, first in (("b.csv", 9), ("a.csv", 5)):
        (folder / name).write_text(f"Order_ID,Customer_Name\n{first},x\n{first - 1},y\n")
    by_file = read_csv(spark, "orders", str(folder))
    assert [r.Order_ID for r in by_file.orderBy("row_order").collect()] == ["5", "4", "9", "8"]
    by_column = read_csv(spark, "orders", str(folder), order="Order_ID")
    assert [r.Order_ID for r in by_column.orderBy("row_order").collect()] == ["4", "5", "8", "9"]


def test_queries_run_on_csv(spark, orders_csv, rows):
    df = read_csv(spark, "orders", orders_csv)
    # first line of order 1 has no price; the line without an order id has no name
    assert rows(customers.top_spend(df)) == [
        ('Ann, the "first"', Decimal("0.00")), ("Bob", Decimal("5.50")),
    ]
    assert rows(orders.per_day(df, as_of=dt.date(2024, 1, 6))) == [
        (dt.date(2024, 1, 5), 1), (dt.date(2024, 1, 6), 0),
    ]


def test_first_means_first_in_the_file(spark, tmp_path, rows):
    """Also where a file is split into many partitions."""
    lines = ["Order_ID,Customer_Name,Order_Total_Price"]
    lines += [f"{i % 50},name{i % 50},{i}" for i in range(5000)]
    path = tmp_path / "orders.csv"
    path.write_text("\n".join(lines) + "\n")
    options = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in options}
    for key, value in options.items():
        spark.conf.set(key, value)
    try:
        df = read_csv(spark, "orders", str(path))
        assert df.rdd.getNumPartitions() > 5
        top = customers.top_spend(df, n=50).collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert {r.Customer_Name: int(r.Order_Total_Price) for r in top} == {
        f"name{i}": i for i in range(50)
    }


def test_parquet_round_trip(spark, tmp_path, orders_csv, rows):
    df = read_csv(spark, "orders", orders_csv)
    path = str(tmp_path / "orders.parquet")
    df.drop("Extra", "row_order").coalesce(1).write.parquet(path)
    again = read_parquet(spark, "orders", path)
    assert set(again.columns) == set(df.columns) - {"Extra"}
    assert rows(customers.top_spend(again)) == rows(customers.top_spend(df))
    ordered = read_parquet(spark, "orders", path, order="Order_ID")
    assert ordered.select("row_order").distinct().count() == 3


def test_parquet_types_are_brought_in_line(spark, tmp_path):
    path = str(tmp_path / "events.parquet")
    spark.sql("""
        select 'x' as Customer_IP, 2.0D as session, timestamp'2024-01-06 23:30:00' as Event_Time,
               '12.5' as Time_On_Page, 'NA' as Search_Term, 1 as Extra""").write.parquet(path)
    [row] = read_parquet(spark, "journey", path).drop("row_order").collect()
    assert tuple(row) == ("x", 2, dt.datetime(2024, 1, 6, 23, 30), Decimal("12.500000"), "NA", 1)


def test_files_with_other_headers_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Order_ID,Customer_ID\n1,2\n")
    (tmp_path / "b.csv").write_text("Customer_ID,Order_ID\n2,1\n")
    with pytest.raises(Exception, match="header"):
        read_csv(spark, "orders", str(tmp_path)).collect()


def test_sessions_from_text(spark, tmp_path, one):
    path = tmp_path / "journey.csv"
    path.write_text(
        "Customer_IP,session,Time_On_Page,Event\n"
        "1.1.1.1,1,5,Home\n1.1.1.1,2.0,x,Home\n2.2.2.2,?,40,Home\n"
    )
    df = read_csv(spark, "journey", str(path))
    assert one(journey.repeat_viewers(df)) == 1
    assert one(journey.bounce_rate_customer(df)) == 50.0


def test_other_session_zones_are_refused(spark, orders_csv):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        with pytest.raises(ValueError, match="UTC"):
            read_csv(spark, "orders", orders_csv)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_loaded_values_and_rejects_hold_every_text(spark, tmp_path):
    folder = tmp_path / "orders"
    folder.mkdir()
    (folder / "a.csv").write_text(
        'Order_Total_Price,Order_ID,Order_Created_At,Customer_Name\n'
        '1 EUR,1,2024-01-01,"two\nlines"\n2.50,2,soon,Ann\n'
    )
    (folder / "b.csv").write_text(
        "Order_Total_Price,Order_ID,Order_Created_At,Customer_Name\nNaN,3,never,\n,4,2024-02-30,x\n"
    )
    table = read_csv(spark, "orders", str(folder), multi_line=True)
    ids = {r.row_order: r.Order_ID for r in table.collect()}
    lost = rejects(spark, "orders", str(folder), multi_line=True).collect()
    assert sorted((ids[r.row_order], r.column, r.text) for r in lost) == [
        ("1", "Order_Total_Price", "1 EUR"), ("2", "Order_Created_At", "soon"),
        ("3", "Order_Created_At", "never"), ("4", "Order_Created_At", "2024-02-30"),
    ]
    counted = {r.column: r.texts for r in unparsed(spark, "orders", str(folder), multi_line=True).collect()}
    assert counted == {"Order_Total_Price": 1, "Order_ID": 0, "Order_Created_At": 3, "Customer_Name": 0}
    kept = {r.Order_ID: (r.Order_Total_Price, r.Order_Created_At, r.Customer_Name) for r in table.collect()}
    assert kept["1"][1:] == (dt.datetime(2024, 1, 1), "two\nlines") and kept["2"][0] == Decimal("2.50")
