"""Artifacts: round trips with nested columns, versions read from the schema, stale and absent ones."""

import pytest

from rangebreak.sources import artifacts


@pytest.mark.parametrize("name", artifacts.ARTIFACTS)
def test_round_trip(spark, tmp_path, name):
    schema = "setup string, counts map<string,bigint>, findings array<struct<feature:string,rates:array<double>>>, score double"
    rows = [("orb", {"a": 1, "b": 2}, [("gap", [0.5, None]), (None, [])], 1.5), (None, None, None, None), ("orb", {}, [], -0.0)]
    made = spark.createDataFrame(rows, schema)
    artifacts.save_artifact(made, str(tmp_path), name, 3)
    back = artifacts.load_artifact(spark, str(tmp_path), name, 3)
    assert back.dtypes == made.dtypes and artifacts.artifact_version(back) == 3
    assert sorted(map(repr, back.collect())) == sorted(map(repr, made.collect()))
    artifacts.save_artifact(made.limit(0), str(tmp_path), name, 4)
    again = artifacts.load_artifact(spark, str(tmp_path), name, 4)
    assert again.count() == 0 and artifacts.artifact_version(again) == 4


def test_stale_absent_and_unknown(spark, tmp_path):
    artifacts.save_artifact(spark.range(2), str(tmp_path), "study", 1)
    assert artifacts.load_artifact(spark, str(tmp_path), "study").count() == 2
    with pytest.raises(artifacts.StaleArtifact, match="study was made from features 1"):
        artifacts.load_artifact(spark, str(tmp_path), "study", 2)
    spark.range(2).write.parquet(f"{tmp_path}/predictions")
    with pytest.raises(artifacts.StaleArtifact, match="features None"):
        artifacts.load_artifact(spark, str(tmp_path), "predictions", 1)
    with pytest.raises(FileNotFoundError, match="no features"):
        artifacts.load_artifact(spark, str(tmp_path), "features", 1)
    with pytest.raises(ValueError, match="unknown artifact"):
        artifacts.save_artifact(spark.range(1), str(tmp_path), "notes", 1)


@pytest.mark.parametrize(
    "verdicts, kept", [(["signal"], 2), (["noise"], 1), ([None], 1), ([], 1), (["signal", "signal"], 2), (["signal", "noise"], 1)]
)
def test_a_gate_never_doubles_or_opens_by_half(spark, verdicts, kept):
    made = spark.createDataFrame([("orb", 2), ("failed_orb", 2), ("orb", 1)], "setup string, features_version int")
    study = spark.createDataFrame([(v,) for v in verdicts], "verdict string")
    assert artifacts.stale_artifact_filter(made, 2, study).count() == kept
