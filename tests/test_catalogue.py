"""Every catalogue query against its SQL, and plans that must stay as they are."""

import pytest
from conftest import DATA
from loomlog.plans.queries import ORACLES, QUERIES
from loomlog.sources.derive import event_log


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, same):
    same(QUERIES[name], ORACLES[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)



def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_last_record_fold_limits_groups_before_the_exchange(spark):
    assert "WindowGroupLimit" in _plan(QUERIES["state"](spark, DATA))


def test_merged_page_takes_ordered_rows(spark):
    from loomlog.operators.replay import merged_page

    assert "TakeOrderedAndProject" in _plan(merged_page(event_log(spark, DATA), [(0, 0)] * 4, 10))


def test_position_predicates_reach_the_scan(spark, tmp_path):
    from loomlog.operators.replay import read_from

    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    event_log(spark, DATA).drop("event_id").write.parquet(str(tmp_path / "log"))
    plan = _plan(read_from(spark.read.parquet(str(tmp_path / "log")), 1, (0, 500), 5))
    assert "GreaterThan(next_offset,500)" in plan.replace(" ", "") and "EqualTo(shard_id,1)" in plan
