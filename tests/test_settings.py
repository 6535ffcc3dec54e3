import pytest
from pyspark.sql import functions as F

from millwright.sources import settings, sinks


def test_settings_from_a_file_and_the_environment(tmp_path):
    file = tmp_path / "env"
    file.write_text("# comment\nINPUT__CSV_FILENAME='orders.csv'\nexport PROCESSING__LIMIT=50\nPROCESSING__SITE_CODES=[\"A1\", \"B2\"]\nPROCESSING__REMOVE_SUBSUMPTION=no\n\nFOLDERS__ROOT=/data/\n")
    s = settings.load(str(file), {"processing__remove_subsumption": "TRUE", "INPUT__COST_COL": ""})
    assert s.input.csv_filename == "orders.csv" and s.input.cost_col is None and s.input.type_col == "type"
    assert s.processing == settings.Processing(True, True, ("A1", "B2"), 50)
    assert [s.folders.path(x) for x in ("root", "cache", "output")] == ["/data/", "/data/cache", "/data/output"]
    assert settings.Folders(root="/r", cache="hdfs://x/c", input="/abs").path("cache") == "hdfs://x/c"
    assert settings.load(None, {}) == settings.Settings()
    with pytest.raises(ValueError, match="neither true nor false"):
        settings.load(None, {"PROCESSING__REMOVE_RARE_OUTLIERS": "maybe"})


def test_outputs_are_removed_below_their_folder_only(spark, tmp_path):
    root = f"file://{tmp_path}"
    spark.range(3).write.parquet(f"{root}/out/run1")
    assert sinks.remove(spark, f"{root}/out/run1", f"{root}/out") and not sinks.remove(spark, f"{root}/out/run1", f"{root}/out")
    for wrong in (f"{root}/other", f"{root}/out", f"{root}/out/../other"):
        with pytest.raises(ValueError, match="does not lie below"):
            sinks.remove(spark, wrong, f"{root}/out")


def test_reports_are_whole_or_fail(spark):
    assert sinks.report(spark.range(1).withColumn("a", F.lit("x"))) == '{\n  "a": "x",\n  "id": 0\n}'
    with pytest.raises(ValueError, match="no summary"):
        sinks.report(spark.range(sinks.MOST_REPORTED + 1))
