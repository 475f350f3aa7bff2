"""What failed on tables 60 times sf0.1, held by small ones."""

import re

from shalebed.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_requests_and_paths_are_not_broadcast(spark):
    plan = QUERIES["permission_access"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[id#\d+\], \[id#\d+\]", plan) and not re.search(r"BroadcastHashJoin \[id#\d+\], \[id#\d+\]", plan)


def test_human_numbers_beyond_64_bits(spark, tmp_path):
    spark.createDataFrame([(8999999, 1199999, 7), (3, 2, 1), (0, 5, 1)], "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["l_orderkey"]: (r["bytes"], r["counted"], r["time"]) for r in QUERIES["human_numbers"](spark, str(tmp_path)).collect()}
    value = 8999999 * 1199999 * 1009 * 6980
    assert value > 2**64 and got == {8999999: (f"{value / 2**60:.1f}E", f"{value / 10**18:.1f}E", f"{value // 10**9}s"), 3: ("5.76M", "6.04M", "6ms"), 0: ("0", "0", "-")}
