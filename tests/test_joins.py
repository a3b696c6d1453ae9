import pytest
from pyspark.sql import functions as F

from docindex.joins import join_by_key

KINDS = ["long", "string", "binary", "date", "timestamp", "decimal(20,3)", "struct<a:string>"]


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys(spark, kind, how):
    """Of hot keys, others and nulls each row meets its own; the list of hot keys needs no Python workers of another kind than those of the tasks."""
    key = {
        "long": "k", "string": "concat('key ', k)", "binary": "cast(concat('key ', k) as binary)", "date": "date_add(date'1899-12-30', k)",
        "timestamp": "timestamp'2001-03-25 01:59:59.123456' + make_interval(0, 0, 0, k)", "decimal(20,3)": "cast(k + 0.125 as decimal(20,3))", "struct<a:string>": "named_struct('a', cast(k as string))",
    }[kind]
    rows = spark.range(9000).selectExpr("id", "if(id % 3 = 0, 1, if(id % 3 = 1, null, cast(id % 40 as int))) as k").selectExpr("id", f"if(k is null, null, {key}) as key")
    by_key = spark.range(30).selectExpr("cast(id as int) as k").selectExpr(f"{key} as key", "k", "if(k = 1, 3075L, 75L) as n")
    out = join_by_key(rows, by_key, "key", "n", how)
    plan = out._jdf.queryExecution().toString()
    assert "_hot" in plan and "ExistingRDD" not in plan
    want = rows.join(by_key, "key", how)
    both = [df.select("id", "k", "n", F.hash("key").alias("key")) for df in (out, want)]
    assert sorted(map(str, both[0].collect())) == sorted(map(str, both[1].collect()))
