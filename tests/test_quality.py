import datetime as dt
import json

import pytest

from panelforge.operators import quality
from panelforge.schema import REQUIRED_COLUMNS
from panelforge.sources import sinks

SCHEMA = (
    "period date, respondent string, respondent_name string, type string, type_name string,"
    " value double, value_units string, timezone string"
)


def obs(n=0, e="AA", t="D", v=5.0, units="MWh", zone="Eastern"):
    return (dt.date(2024, 1, 1) + dt.timedelta(n), e, f"{e} name", t, t.lower(), v, units, zone)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def found(result):
    return {(r["check"], r["severity"]): r["details"] for r in result.findings.collect()}


def full(entity, days, **kw):
    return [obs(n, entity, **kw) for n in range(days)]


def test_clean_data_passes(spark):
    result = quality.validate(frame(spark, full("AA", 10) + full("AA", 10, t="DF")))
    got = found(result)
    assert result.passed
    assert set(got) == {
        ("units", "INFO"), ("duplicates", "INFO"), ("timezone", "INFO"), ("missing_values", "INFO"),
        ("negative_values", "INFO"), ("zero_demand", "INFO"), ("aggregates", "INFO"), ("coverage", "INFO"),
        ("leakage_watch", "INFO"),
    }
    assert [r[0] for r in result.modeling_respondents.collect()] == ["AA"]
    verdict = result.verdict.first()
    assert (verdict["n_errors"], verdict["n_warnings"], verdict["row_count"]) == (0, 0, 20)


def test_missing_column_stops_before_any_job(spark):
    result = quality.validate(frame(spark, [obs()]).drop("timezone"))
    assert not result.passed and set(found(result)) == {("schema", "ERROR")}
    assert quality.schema_errors(frame(spark, [obs()])) == []
    assert REQUIRED_COLUMNS[0] == "period"


def test_wrong_types(spark):
    df = frame(spark, [obs()]).selectExpr(
        "cast(period as string) period", "respondent", "respondent_name", "type", "type_name",
        "cast(value as string) value", "value_units", "timezone",
    )
    result = quality.validate(df)
    assert not result.passed
    assert result.findings.filter("check = 'schema'").count() == 2
    assert result.findings.filter("check = 'units'").count() == 1


def test_empty_input(spark):
    result = quality.validate(frame(spark, []))
    assert set(found(result)) == {("input", "ERROR")} and not result.passed


def test_mixed_units_stop_the_other_checks(spark):
    result = quality.validate(frame(spark, [obs(), obs(1, units="GWh"), obs(1, units="GWh")]))
    assert set(found(result)) == {("units", "ERROR")}
    assert result.coverage.count() == 0 and result.modeling_respondents.count() == 0
    assert {r["item"] for r in result.entity_details.collect()} == {"MWh", "GWh"}


def test_duplicates_and_time_zones(spark):
    rows = full("AA", 4) + [obs(1), obs(1), obs(2, zone="Pacific")]
    got = found(quality.validate(frame(spark, rows)))
    assert got[("duplicates", "ERROR")]["count"] == "3"
    assert got[("timezone", "ERROR")]["distinct"] == "2"
    details = quality.validate(frame(spark, rows)).entity_details.filter("check = 'duplicates'").first()
    assert (details["item"], details["value"]) == ("AA", "2024-01-03")
    assert quality.duplicate_keys(frame(spark, rows)).first().asDict() == {"duplicate_rows": 3, "duplicate_keys": 2}


def test_statistical_findings_never_fail_the_run(spark):
    rows = full("AA", 10) + [
        obs(0, "AA", "TI", -5.0), obs(0, "AA", "NG", -5.0), obs(0, "AA", "DF", -5.0), obs(1, "AA", "DF", None),
        obs(2, "AA", "DF", float("nan")), obs(10, "AA", v=0.0), obs(11, "AA", v=-1.0),
    ]
    result = quality.validate(frame(spark, rows))
    got = found(result)
    assert result.passed
    assert got[("negative_values", "WARNING")]["count"] == "2"
    assert got[("missing_values", "WARNING")] == {"count": "2", "pct": "11.7647"}
    assert got[("zero_demand", "WARNING")]["count"] == "1"
    details = {(r["check"], r["item"], r["measure"]): r["value"] for r in result.entity_details.collect()}
    assert details[("negative_values", "DF", "by_type")] == "1"
    assert details[("negative_values", "AA", "by_respondent")] == "2"
    assert details[("missing_values", "DF", "by_type")] == "2"


def test_coverage_uses_the_span_of_all_rows(spark):
    rows = full("AA", 10) + [obs(n, "BB") for n in (0, 1, 4)] + [obs(19, "AA", "NG")] + full("US48", 20)
    coverage = {r["respondent"]: r for r in quality.build_coverage(frame(spark, rows)).collect()}
    assert coverage["AA"]["coverage_pct"] == 50.0 and coverage["AA"]["interior_gaps"] == 0
    assert (coverage["BB"]["days"], coverage["BB"]["interior_gaps"], coverage["BB"]["coverage_pct"]) == (3, 2, 15.0)
    assert coverage["US48"]["role"] == "aggregate" and coverage["AA"]["role"] == "balancing_authority"
    result = quality.validate(frame(spark, rows), min_coverage_pct=50)
    assert [r[0] for r in result.modeling_respondents.collect()] == ["AA"]
    assert {r["respondent"]: r["selection"] for r in result.coverage.collect()} == {
        "AA": "keep", "BB": "low_coverage", "US48": "aggregate",
    }
    kept = quality.validate(frame(spark, rows), min_coverage_pct=10, exclude_aggregates=False)
    assert sorted(r[0] for r in kept.modeling_respondents.collect()) == ["AA", "BB", "US48"]
    assert found(kept)[("interior_gaps", "WARNING")]["respondents"] == "1"


def test_no_target_rows(spark):
    result = quality.validate(frame(spark, full("AA", 3, t="NG")))
    assert ("coverage", "ERROR") in found(result) and not result.passed


def test_aggregates_as_a_table_and_lazy_run(spark):
    roles = spark.createDataFrame([("AA",)], "respondent string")
    result = quality.validate(frame(spark, full("AA", 5) + full("BB", 5)), aggregates=roles, materialise=False)
    assert [r[0] for r in result.modeling_respondents.collect()] == ["BB"]


def test_saved_report_and_approved_list(spark, tmp_path):
    result = quality.validate(frame(spark, full("AA", 10) + full("BB", 2)))
    sinks.save_validation(result, str(tmp_path / "report"))
    assert [r[0] for r in sinks.read_approved(spark, str(tmp_path / "report")).collect()] == ["AA"]
    coverage = spark.read.option("header", True).csv(str(tmp_path / "report" / "coverage_matrix"))
    assert coverage.count() == 2 and "coverage_pct" in coverage.columns
    single = tmp_path / "report.json"
    single.write_text(json.dumps({"passed": True, "modeling_respondents": ["AA", "CC"]}, indent=1))
    assert sorted(r[0] for r in sinks.read_report_list(spark, str(single)).collect()) == ["AA", "CC"]


@pytest.mark.parametrize("part", ["negatives", "zeros"])
def test_top_entities_are_ten(spark, part):
    value = -1.0 if part == "negatives" else 0.0
    rows = [obs(n, f"E{i:02d}", v=value) for i in range(12) for n in range(i + 1)]
    df = frame(spark, rows)
    counts = quality.negative_values(df) if part == "negatives" else quality.zero_demand(df)
    top = quality.top_entities(counts).collect()
    assert [r["respondent"] for r in top] == [f"E{i:02d}" for i in range(11, 1, -1)]


def test_hot_entity_is_combined_before_the_shuffle(spark):
    """A third of all rows in one entity: counts stay right, and every raw-row shuffle follows a partial aggregate."""
    from panelforge.operators import panel

    rows = [obs(n % 50, "HOT", t) for n in range(400) for t in ("D", "NG")]
    rows += [obs(n % 50, f"E{n % 40}") for n in range(1600)]
    df = frame(spark, rows)
    result = quality.validate(df, min_coverage_pct=1)
    assert found(result)[("duplicates", "ERROR")]["count"] == str(len(rows) - len({(r[0], r[1], r[3]) for r in rows}))
    for out in (panel.to_wide(df), quality.key_counts(df), quality.build_coverage(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        before_first_shuffle = plan.rsplit("Exchange hashpartitioning", 1)[1]
        assert "partial_" in before_first_shuffle and "SortAggregate" not in before_first_shuffle
