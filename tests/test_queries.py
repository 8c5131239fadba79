"""Registered queries against their SQL on the smallest tables."""
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["reconciled_sources", "calendar_thresholds", "robust_calendar", "neighbour_network", "network_residuals", "event_catalogue_area_weighted",
         "scenario_sweep_days", "event_set_comparison", "advection", "blocking_index", "sign_agreement", "false_discovery_by_family", "risk_set", "type_contrasts"]


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    fix = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else (round(float(v), 4) if isinstance(v, float) else str(v))
    return sorted((tuple(fix(r[i]) for i in order) for r in rows), key=str)


def test_registry_is_complete():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 150


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables absent")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = entry.queries()[name](spark, SF)
    rel = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(df.columns)
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(cols, rel.fetchall())


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables absent")
@pytest.mark.parametrize("name", ["false_discovery_by_family", "cell_regression_p", "area_weights", "standardised_risk_set", "event_set_comparison", "station_participation",
                                  "threshold_order_check", "network_residuals", "onset_count_null", "leave_one_season_out"])
def test_plan_has_no_product(spark, name):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().explainString(mode)
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables absent")
@pytest.mark.parametrize("name", ["at_risk_exposure", "rate_ratio_interval", "quiet_day_contrast", "station_participation"])
def test_station_flags_are_made_once(spark, name, monkeypatch):
    from hiemal.verification import q_events
    made, flagged = [], q_events.flagged
    monkeypatch.setattr(q_events, "flagged", lambda *a: made.append(1) or flagged(*a))
    entry.queries()[name](spark, SF)
    assert len(made) == 1


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables absent")
@pytest.mark.parametrize("name", ["spatial_consistency", "spatial_decisions"])
def test_spatial_checks_read_the_outliers_once(spark, name):
    """Candidates and neighbours read one staged table; the calendar isn't part of the plan any more."""
    assert "MapInArrow" not in entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
