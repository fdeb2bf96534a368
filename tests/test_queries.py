import duckdb
import pytest

from compare import assert_same
from snapstride.plans import catalog

SMALL, USUAL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_has_the_rows_of_its_sql(spark, name):
    assert_same(spark, catalog.queries()[name], catalog.oracle_sql()[name], USUAL)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_queries_give_rows(spark, name):
    assert catalog.queries()[name](spark, SMALL).count() > 0


def test_entry_gives_rows(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).toPandas()
    assert len(rows)
    sums = rows.groupby(["season", "snapshot_date"]).share.sum()
    assert (abs(sums - 1) < 1e-4).all()


def test_filter_on_a_partition_key_goes_below_the_window(spark):
    plan = catalog.queries()["group_zscore"](spark, SMALL).filter("season = 1996")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.rfind("1996") > text.find("Window")


def test_no_query_buffers_all_rows_for_a_quantile(spark):
    for name in ("coverage_surface", "kernel_quantile", "held_out_coverage", "cvar_radj", "coverage_cells", "signed_quantiles", "miss_cells"):
        plan = catalog.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert " percentile(" not in plan and "collect_list" not in plan, name


def test_sealed_prices_are_one_sort_and_no_range_join(spark):
    for name in ("exec_price_seal", "locf_price_grid"):
        plan = catalog.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.split("\n") if "Join" in line]
        assert not any(">=" in line or "<=" in line for line in joins), joins


def test_scans_read_only_the_columns_they_need(spark):
    plan = catalog.queries()["game_log_tally"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "o_comment" not in plan and "ReadSchema" in plan


@pytest.fixture(scope="module")
def zeros(tmp_path_factory):
    """The smallest events, every ninth with value 0 and so with price 0."""
    path = tmp_path_factory.mktemp("zeros")
    duckdb.sql(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 9 = 4 THEN 0 ELSE value END AS value) FROM '{SMALL}/events.parquet') TO '{path}/events.parquet' (FORMAT parquet)")
    return str(path)


@pytest.mark.parametrize("name", ["glm_normal_equations", "taker_fee"])
def test_prices_of_zero_count_as_in_the_sql(spark, zeros, name):
    assert_same(spark, catalog.queries()[name], catalog.oracle_sql()[name], zeros)
