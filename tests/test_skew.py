"""Hot keys: a third of all rows in one order, product, customer or visitor."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from basketry.catalog import QUERIES
from compare import assert_same, connect

# The sample again, with a third of the rows of each large table moved to one
# key. Tables are written as several files, so that there are map tasks to split.
SKEWED = {
    "orders": {"o_custkey": "if(o_orderkey % 3 = 0, 1, o_custkey)"},
    "lineitem": {
        "l_orderkey": "if((l_suppkey + l_linenumber) % 3 = 0, 5, l_orderkey)",
        "l_partkey": "if((l_suppkey + l_linenumber) % 3 = 1, 7, l_partkey)",
    },
    "events": {"user_id": "if(event_id % 3 = 0, 3, user_id)"},
    "customer": {}, "nation": {}, "region": {}, "part": {}, "supplier": {},
}


@pytest.fixture(scope="module")
def skewed_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    for table, moved in SKEWED.items():
        df = spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet")
        moved = {c: F.expr(e).cast(df.schema[c].dataType) for c, e in moved.items()}
        df.withColumns(moved).repartition(6).write.parquet(f"{folder}/{table}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def db(skewed_dir):
    with connect(skewed_dir) as connection:
        yield connection


# Plans of large tables: no automatic broadcast, and partitions of this small
# sample count as skewed once they are a multiple of the others.
LARGE = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200B",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200B",
    "spark.sql.files.maxPartitionBytes": "20KB",
    "spark.sql.files.openCostInBytes": "0",
}


@pytest.fixture(scope="module")
def large(spark):
    before = {key: spark.conf.get(key, None) for key in LARGE}
    for key, value in LARGE.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.mark.parametrize("name", QUERIES)
def test_hot_keys_do_not_change_results(large, db, skewed_dir, name):
    assert_same(contract.queries()[name](large, skewed_dir), db, contract.oracle_sql()[name])


# Splitting goes by compressed bytes, so this takes queries that shuffle more than
# a constant key (ord_cancelled, say, only shuffles order keys).
@pytest.mark.parametrize("name", [
    "ord_filtered",  # hot order, product and customer
    "prod_avg_per_customer",  # hot order
    "prod_most_sold",  # hot product
    "cust_top_spend",  # hot customer
])
def test_hot_join_keys_are_split(large, skewed_dir, name):
    df = QUERIES[name].on_sample(large, skewed_dir)
    df.collect()
    assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
