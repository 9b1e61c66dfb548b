"""Measurement records: every rule broken on purpose, boundaries, sets, readers."""

import datetime as dt
import itertools
import json

import pytest

from tests.conftest import as_set
from tripledger.operators import records
from tripledger.operators.groups import max_per_group, pivot_members

ENGINES = ["north", "south", "east", "west"]


def record(engine, scenario="new_data", **changes):
    """A valid record of the layout, field by field from its type."""
    made = {}
    for field in records.RECORD_SCHEMA:
        kind = field.dataType.typeName()
        made[field.name] = {"string": f"{field.name}-x", "long": 7, "double": 2.5, "boolean": True}.get(kind)
    made |= {
        "implementation": engine,
        "scenario": scenario,
        "output_rows": {"trips": 40, "zones": 3},
        "models_executed": ["trips", "zones"],
        "exit_code": 0,
        "status": "verified",
        "timestamp": dt.datetime(2031, 5, 6, 7, 8, 9).isoformat(),
    }
    return made | changes


def full_set(*scenarios):
    return [record(e, s) for s, e in itertools.product(scenarios or ("new_data",), ENGINES)]


def load(spark, folder, data, **options):
    path = folder / "measured.json"
    path.write_text(options.pop("text", None) or json.dumps(data))
    return records.load_measurements(spark, str(path), ENGINES, **options)


def test_loads_in_display_order(spark, tmp_path):
    loaded = load(spark, tmp_path, full_set("business_logic_change", "no_change", "new_data")[::-1])
    shown = ["no_change", "new_data", "business_logic_change"]
    assert [(r.scenario, r.implementation) for r in loaded.collect()] == list(itertools.product(shown, ENGINES))
    assert records.summary(loaded).columns == list(records.SUMMARY_COLUMNS)


# One value per rule that breaks it, and the reason that rule gives.
BREAKS = {
    "not_verified": [{"status": "built"}, {"status": None}, {"equivalent": None}, {"exit_code": 137}],
    "unknown_scenario": [{"scenario": "weekly"}, {"scenario": None}],
    "unknown_member": [{"implementation": "North"}, {"implementation": ""}],
    "invalid_seconds": [{"execution_seconds": x} for x in (-1e-9, None, float("inf"), float("-inf"), float("nan"))],
    "invalid_size": [{"database_size_mb": x} for x in (-5e-324, None, float("nan"))],
    "missing_counts": [{"output_rows": {}}, {"output_rows": None}],
}


@pytest.mark.parametrize("reason", BREAKS)
def test_each_rule(spark, reason):
    rows = [record("north", **change) for change in BREAKS[reason]]
    df = spark.createDataFrame([tuple(r[n] for n in records.RECORD_SCHEMA.names) for r in rows], records.RECORD_SCHEMA)
    found = records.classify_records(df, ENGINES, records.SCENARIOS)
    assert [r.reject_reason for r in found.select("reject_reason").collect()] == [reason] * len(rows)


def test_boundaries_pass(spark, tmp_path):
    data = full_set()
    data[0] |= {"execution_seconds": 0.0, "database_size_mb": 0.0}
    data[1] |= {"execution_seconds": 1.7e308, "models_executed": None, "strategy": None}
    assert load(spark, tmp_path, data).count() == len(data)


def test_the_first_broken_rule_counts(spark):
    row = record("nobody", execution_seconds=-1.0, status="failed")
    df = spark.createDataFrame([tuple(row[n] for n in records.RECORD_SCHEMA.names)], records.RECORD_SCHEMA)
    assert records.classify_records(df, ENGINES).first().reject_reason == "not_verified"


# Several faults of whole sets, generated from the fields that must agree.
SETS = {
    "empty": lambda rows: [],
    "one engine missing": lambda rows: rows[1:],
    "an engine twice": lambda rows: [*rows, rows[2]],
    **{f"{f} apart in a scenario": lambda rows, f=f: [rows[0] | {f: {"trips": 41} if f == "output_rows" else 8}, *rows[1:]] for f in records.SCENARIO_FIELDS},
    **{f"{f} apart in the run": lambda rows, f=f: [*rows[:-1], rows[-1] | {f: "y" if isinstance(rows[0][f], str) else 9}] for f in records.RUN_FIELDS},
    **{f"{f} lacking": lambda rows, f=f: [r | {f: None} for r in rows] for f in records.RUN_FIELDS},
    "two faults": lambda rows: [rows[0] | {"exit_code": 2}, *rows[2:]],
}


@pytest.mark.parametrize("fault", SETS)
def test_faulty_sets(spark, tmp_path, fault):
    with pytest.raises(records.InvalidRecords):
        load(spark, tmp_path, SETS[fault](full_set()))


def test_one_record_per_line(spark, tmp_path):
    lines = "\n".join(json.dumps(r, ensure_ascii=False) for r in full_set("new_data", "no_change"))
    assert load(spark, tmp_path, None, text=lines, array=False).count() == 8


def test_pivot_shows_what_its_columns_cannot(spark):
    rows = [("a", "north", 1.23456), ("a", "north", 0.5), ("a", "south", None), ("a", "up", 9.0), ("b", None, 1.0)]
    df = spark.createDataFrame(rows, "s string, m string, v double")
    wide = pivot_members(df, "s", "m", ["north", "south"], "v")
    assert wide.columns == ["s", "north", "south", "other_rows", "repeated_rows"]
    assert as_set(wide) == [("a", 1.235, None, 1, 1), ("b", None, None, 1, 0)]
    assert as_set(max_per_group(df, "s", "v")) == [("a", 9.0), ("b", 1.0)]


def test_executed_steps(spark):
    step = "named_struct('unique_id', '{}', 'status', '{}')".format
    listed = ", ".join([step("model.x.b", "success"), step("model.x.a", "skipped"), step("seed.x.c", "success")])
    runs = spark.sql(f"SELECT 9 AS run, array({listed}) AS results UNION ALL SELECT 10, array()")
    assert as_set(records.executed_steps(runs, "results")) == [(9, "b")]


def test_run_status(spark):
    codes = {"ok": 0, "mixed": 0, "silent": 0, "crashed": 3}
    heard = {"ok": [True] * 3, "mixed": [True, False], "crashed": [True]}
    runs = spark.createDataFrame(list(codes.items()), "run string, exit_code int")
    verdicts = spark.createDataFrame([(k, v) for k, vs in heard.items() for v in vs], "run string, passed boolean")
    assert dict(as_set(records.run_status(runs, verdicts, "run").select("run", "status"))) == {
        "ok": "verified",
        "mixed": "invalid",
        "silent": "built",
        "crashed": "failed",
    }
