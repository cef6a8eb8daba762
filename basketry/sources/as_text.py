"""The sample tables as CSV with the flaws of real exports, read by the loader.

Ids with a mark or decimals, numbers and times that do not parse, several forms of
times, markers of missing values and quoted text: each a function of the key, so the
loader's coercions can be compared with SQL on every row. Either as lines within one job
(``orders``, ``journey``, ``products``), or as files in the shared folder: several parts in
order of the key, columns in another order than the table's, and line breaks within
quoted names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from basketry.operators.grain import ORDER, dedup_rows
from basketry.sources.files import read_csv, rejects, typed
from basketry.sources.sample import read_table
from basketry.sources.shared import new_path


def _loaded(rows: DataFrame, table: str, texts: dict[str, Column]) -> DataFrame:
    """Texts written as CSV lines and read back as columns of a canonical table."""
    line = F.to_csv(F.struct(*[text.cast("string").alias(name) for name, text in texts.items()]))
    schema = ", ".join(f"{name} string" for name in texts)
    raw = rows.select(F.from_csv(line, F.lit(schema)).alias("row")).select("row.*")
    return raw.select(*typed(raw, table, missing_markers=True))


def _id(key: Column) -> Column:
    return F.when(key % 4 == 0, F.concat(F.lit("#"), key)).when(
        key % 4 == 1, F.concat(key, F.lit(".0"))
    ).otherwise(key.cast("string"))


def _time(ts: Column, key: Column) -> Column:
    forms = {1: "yyyy/M/d H:mm:ss", 2: "M/d/yyyy H:mm:ss", 3: "yyyy-MM-dd'T'HH:mm:ss'+00:00'"}
    text = F.when(key % 6 == 0, F.lit("not a time"))
    for rest, form in forms.items():
        text = text.when(key % 6 == rest, F.date_format(ts, form))
    return text.otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))


def _order_texts(break_lines: bool = False) -> dict[str, Column]:
    key = F.col("o_orderkey")
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    joint = F.when(key % 2 == 0, F.lit('",\n')) if break_lines else F.when(F.lit(False), F.lit(""))
    name = F.concat(F.lit('The "'), "o_custkey", joint.otherwise(F.lit('", ')), F.lit("first"))
    return {
        "Order_ID": _id(key),
        "Customer_Name": F.when(key % 9 == 0, F.lit("")).otherwise(name),
        "Order_Total_Price": F.when(key % 5 == 0, F.lit("n/a")).when(
            key % 5 == 1, F.concat(price, F.lit(" EUR"))
        ).otherwise(price),
        "Order_Created_At": _time(F.col("o_orderdate"), key),
        "Product_Quantity": F.when(key % 7 == 0, F.lit("1.5")).otherwise(F.concat(key % 7, F.lit(".0"))),
    }


def _journey_texts() -> dict[str, Column]:
    key = F.col("event_id")
    return {
        "Customer_IP": F.col("user_id"),
        "session": F.when(key % 8 == 0, F.lit("?")).otherwise((key % 8).cast("string")),
        "Event_Time": _time(F.col("ts"), key),
        "Event": F.when(key % 11 == 0, F.lit("NA")).otherwise(F.col("event_type")),
        "Time_On_Page": F.when(key % 5 == 0, F.lit("")).otherwise(F.col("value").cast("decimal(18,2)").cast("string")),
        "Product_ID": _id(key),
    }


def _product_texts() -> dict[str, Column]:
    key = F.col("p_partkey")
    created = F.date_add(F.lit("1995-01-01").cast("date"), (key % 1000).cast("int")).cast("timestamp_ntz")
    return {
        "Product_ID": _id(key),
        "Product_Title": F.col("p_name"),
        "Product_Type": F.when(key % 3 == 0, F.lit("NULL")).otherwise(F.col("p_type")),
        "Product_Created_At": _time(created, key),
        "Variant_Price": F.when(key % 5 == 0, F.lit("free")).otherwise(
            F.col("p_retailprice").cast("decimal(18,2)").cast("string")
        ),
    }


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(read_table(spark, sf_dir, "orders"), "orders", _order_texts())


def journey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(read_table(spark, sf_dir, "events"), "journey", _journey_texts())


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(read_table(spark, sf_dir, "part"), "products", _product_texts())


def write_files(rows: DataFrame, key: str, texts: dict[str, Column]) -> str:
    """Write texts as CSV files that follow each other in order of the key; the folder's path."""
    spark = rows.sparkSession
    path = new_path(spark, "csv")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shown = [text.cast("string").alias(name) for name, text in reversed(texts.items())]
    in_order = rows.repartitionByRange(parts, key).sortWithinPartitions(key)
    in_order.select(*shown).write.option("header", True).option("escape", '"').csv(path)
    return path


def _order_files(spark: SparkSession, sf_dir: str) -> str:
    texts = _order_texts(break_lines=True) | {"Customer_ID": _id(F.col("o_custkey"))}
    return write_files(read_table(spark, sf_dir, "orders"), "o_orderkey", texts)


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders through files with line breaks in quoted names."""
    return read_csv(spark, "orders", _order_files(spark, sf_dir), multi_line=True).drop(ORDER)


def journey_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through files that can be split."""
    path = write_files(read_table(spark, sf_dir, "events"), "event_id", _journey_texts())
    return read_csv(spark, "journey", path).drop(ORDER)


def product_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_files(read_table(spark, sf_dir, "part"), "p_partkey", _product_texts())
    return read_csv(spark, "products", path).drop(ORDER)


def first_and_last_in_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer the first and the last order by their place in the files."""
    rows = read_csv(spark, "orders", _order_files(spark, sf_dir), multi_line=True)
    columns = ["Order_ID", "Order_Total_Price"]
    first = dedup_rows(rows, ["Customer_ID"], columns)
    last = dedup_rows(rows, ["Customer_ID"], columns, keep="last")
    return first.toDF("Customer_ID", "First_Order", "First_Price").join(
        last.toDF("Customer_ID", "Last_Order", "Last_Price"), "Customer_ID"
    )


def rejects_in_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the loader could not read, with the order it belongs to."""
    path = _order_files(spark, sf_dir)
    rows = read_csv(spark, "orders", path, multi_line=True).select(ORDER, "Order_ID")
    return rejects(spark, "orders", path, multi_line=True).join(rows, ORDER).select("Order_ID", "column", "text")
