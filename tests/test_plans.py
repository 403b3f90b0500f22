"""What the plans must and must not contain."""

import pytest

import __spark_entry__ as entry


def plan(spark, small, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    df = entry.queries()[name](spark, small)
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["A1_features_24h", "J1_range_join", "J3_asof_backward", "W1_forward_returns", "W8_trailing_beta", "M4_M7_newey_west_grid", "M32_type_drift", "T1_J12_match_symbol", "A10_census", "p1_rolling_totals", "p6_found"])
def test_no_nested_loops_and_no_python(name, spark, small):
    text = plan(spark, small, name).split("== Physical Plan ==")[1]
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInArrow", "MapInPandas"):
        assert node not in text, node


def test_filters_and_columns_reach_the_scan(spark, small):
    text = plan(spark, small, "S8_F2_pushed_scan").split("== Physical Plan ==")[1]
    pushed = text.split("PushedFilters: [")[1].split("]")[0]
    assert "EqualTo(source,gdelt)" in pushed and "EqualTo(source_domain,deepcrawl.example)" in pushed
    assert "body" not in text.split("ReadSchema:")[1]


def test_one_shuffle_serves_all_lookbacks(spark, small):
    text = plan(spark, small, "A1_features_24h").split("== Physical Plan ==")[1]
    assert text.count("Window [") >= 1 and text.count("Scan parquet") <= 4
