"""Every query with SQL gives the rows of its SQL in DuckDB."""

import pytest

from heliogrid.plans import catalogue
from tests.compare import same
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows(spark, name):
    ok, why = same(catalogue.QUERIES[name](spark, SF), catalogue.SQL[name], SF)
    assert ok, why


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["device_id", "metric", "unit", "bucket", "value"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_seed_covers_every_row(spark):
    sf = "/root/testdata/sf0.01"
    counted = catalogue.QUERIES["rollup_seed_whole"](spark, sf).groupBy().sum("sample_count").first()[0]
    assert counted == catalogue.measures(spark, sf).where("value is not null and event_time is not null").count()
    ok, why = same(catalogue.QUERIES["rollup_seed_whole"](spark, sf), catalogue.SQL["rollup_seed_whole"], sf)
    assert ok, why


def test_totals_cover_both_kinds(spark):
    rows = catalogue.energy.listing(*catalogue._windows(spark, SF), catalogue._START, catalogue._END, working_only=True).toPandas()
    got = catalogue.QUERIES["energy_totals_working_both"](spark, SF).toPandas()
    assert set(zip(got.device_id, got.device_type)) == set(zip(rows.device_id, rows.device_type)) and set(got.device_type) == {"plug", "three_phase"}
    for c in ["energy_wh", *catalogue.PHASE_COLUMNS]:
        assert got[c].sum() == pytest.approx(rows[c].sum(), abs=1e-6)
    for name in ("energy_totals_working_both", "energy_total_both"):
        ok, why = same(catalogue.QUERIES[name](spark, "/root/testdata/sf0.01"), catalogue.SQL[name], "/root/testdata/sf0.01")
        assert ok, why
    whole = catalogue.QUERIES["energy_total_both"](spark, "/root/testdata/sf0.01").first().asDict()
    assert all(whole[c] > 0 for c in ["energy_wh", *catalogue.PHASE_COLUMNS])


def test_totals_of_an_empty_range(spark):
    from datetime import datetime

    columns = ["energy_wh", *catalogue.PHASE_COLUMNS]
    rows = catalogue.energy.listing(*catalogue._windows(spark, SF), datetime(2031, 1, 1), datetime(2031, 1, 2))
    assert catalogue.energy.totals(rows, columns, per_device=False).first().asDict() == dict.fromkeys(columns, 0.0)
    assert catalogue.energy.totals(rows, columns).count() == 0
