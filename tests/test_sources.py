import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stratalens.sources import reports, results, schema, tables
from stratalens.streaming.ingest import ingest_new_reports

HEADER = "Year,NodeId,Gender,Age,HasHIV,IP_Key:Risk,Population,Newly Infected,HasIntervention(PrEP),Newly Tested Negative"


def report_file(root, scenario, run, lines, header=HEADER):
    folder = root / scenario / "ReportHIVByAgeAndGender"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"ReportHIVByAgeAndGender_TPI{run:04d}_REP0001.csv").write_text("\n".join([header, *lines]) + "\n")


@pytest.fixture()
def suite(tmp_path):
    root = tmp_path / "suite"
    for scenario in ("PrEP-0", "PrEP-30+x"):
        for run in (7, 251):
            report_file(root, scenario, run, [f"2010.5,1,0,16,0,LOW,{run}.0,2,NaN,5", "2010.5,2,1,16,1,HIGH,4,1,0,5"])
    return root


def test_scan_tags_rows_by_file_and_directory(spark, suite):
    df = reports.scan_reports(spark, str(suite / "*" / "*"), scenario_depth=3)
    assert df.columns == [
        "year", "node_id", "gender_code", "age_lower", "hiv", "risk", "population", "newly_infected",
        "has_prep", "newly_tested_negative", "scenario", "run_num", "replicate",
    ]
    found = {(r.scenario, r.run_num): r.p for r in df.groupBy("scenario", "run_num").agg(F.max("population").alias("p")).collect()}
    assert found == {(s, r): float(r) for s in ("PrEP-0", "PrEP-30+x") for r in (7, 251)}
    # NaN was turned into NULL, so averages leave it out.
    assert df.agg(F.avg("has_prep")).first()[0] == 0.0
    assert dict(df.dtypes)["node_id"] == "int" and dict(df.dtypes)["population"] == "double"


def test_scan_checks_headers_and_presence(spark, suite, tmp_path):
    report_file(suite, "PrEP-60", 1, ["1,2"], header="Year,Other")
    layout = reports.report_schema(spark, str(suite / "PrEP-0" / "*"))
    with pytest.raises(Exception, match="CSV header"):
        reports.scan_reports(spark, str(suite / "*" / "*"), layout).collect()
    with pytest.raises(reports.MissingSourceError):
        reports.scan_reports(spark, str(tmp_path / "none"))
    empty = reports.scan_reports(spark, str(tmp_path / "none"), required=False)
    assert empty.count() == 0 and "run_num" in empty.columns


def test_headers():
    spellings = ("HasIntervention(PrEP)", "HasIntervention.PrEP.", "HasInterventionPrEP")
    assert {schema.canonical_name(s) for s in spellings} == {"has_prep"}
    assert schema.canonical_name("NodeID") == schema.canonical_name("Node_ID") == "node_id"


def test_run_number_without_digits(spark):
    df = spark.createDataFrame([("R_TPI0042_x.csv",), ("R_TPI_x.csv",), ("R.csv",)], "f string")
    assert [r[0] for r in df.select(reports.run_number(F.col("f"))).collect()] == [42, None, None]


def test_scaling_follows_column_order(spark):
    df = spark.createDataFrame([(1, 10.0, 20.0, 30.0, 5)], "a int, population double, x double, y double, run_num int")
    whole = reports.scale_counts(df, "population", None, 0.5, 0.25).first()
    assert tuple(whole) == (1, 5.0, 10.0, 15.0, 5)
    part = reports.scale_counts(df, "population", "x", 0.5).first()
    assert tuple(part) == (1, 20.0, 40.0, 30.0, 5)


def test_results_come_back(spark, tmp_path):
    df = spark.createDataFrame([("s", "a", 1.0), ("s", "b", 2.0), ("t", "a", 3.0)], "scenario string, output string, value double")
    path = results.save_results(df, str(tmp_path / "out"))
    assert results.load_results(spark, path, "a").agg(F.sum("value")).first()[0] == 4.0
    assert results.load_results(spark, path, "a", "t").count() == 1
    with pytest.raises(PySparkException):
        results.save_results(df, path)


def test_shared_folder_follows_the_session(spark):
    first, second = (results.shared_folder(spark, "x") for _ in range(2))
    assert first != second
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert first.startswith(root.rstrip("/"))


def test_small_tables(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Scenario,Campaign\nPrEP-0,campaign_a.json\n")
    (tmp_path / "bad.csv").write_text("Scenario\nPrEP-0\n")
    (tmp_path / "p.csv").write_text("parameterization_id,SeedYr HIGH,sim_id,likelihood\n1,1982.5,,1\n")
    (tmp_path / "e.csv").write_text("Node_ID,Individual_ID,Event_Name,Age\n1,5,PrEP_Received,100.5\n")
    (tmp_path / "o.csv").write_text("Year,County,Gender,AgeBin,OnART,weight\n2008.5,Siaya,Male,[15:50),12,1\n")
    (tmp_path / "c.json").write_text('{"Prevalence": {}}')
    assert tables.read_scenarios(spark, str(tmp_path / "s.csv")).first().Campaign == "campaign_a.json"
    assert tuple(tables.read_scenarios(spark, None).first()) == (None, None)
    with pytest.raises(tables.MissingCampaignError):
        tables.read_scenarios(spark, str(tmp_path / "bad.csv"))
    row = tables.read_parameter_sets(spark, str(tmp_path / "p.csv")).first()
    assert (row["parameterization_id"], row["SeedYr HIGH"], row["sim_id"]) == (1, 1982.5, None)
    assert tables.read_events(spark, str(tmp_path / "e.csv")).first().age == 100.5
    assert tables.read_observed(spark, str(tmp_path / "o.csv")).first().OnART == 12.0
    assert "Prevalence" in tables.read_channel_config(spark, str(tmp_path / "c.json")).first().config


def test_only_new_files_are_ingested(spark, suite, tmp_path):
    layout = reports.report_schema(spark, str(suite / "PrEP-0" / "*"))
    target, done = str(tmp_path / "t"), str(tmp_path / "c")

    def ingest():
        ingest_new_reports(spark, str(suite), target, done, layout, 3, max_files=1).awaitTermination()
        return spark.read.parquet(target)

    assert ingest().count() == 8
    assert ingest().count() == 8
    report_file(suite, "PrEP-90", 3, ["2011,1,0,16,0,LOW,9,1,1,1"])
    stored = ingest()
    assert stored.count() == 9
    assert {r.run_num for r in stored.where("scenario = 'PrEP-90'").collect()} == {3}


def test_replicates_are_runs_of_their_own(spark, tmp_path):
    folder = tmp_path / "S" / "Report"
    folder.mkdir(parents=True)
    for name, pop in (("R_TPI0001_REP0001", 100), ("R_TPI0001_REP0002", 300), ("Other", 7), ("Another", 8)):
        (folder / f"{name}.csv").write_text(f"Year,NodeId,Population\n2000,1,{pop}\n")
    rows = reports.scan_reports(spark, str(folder))
    found = {(r.run_num, r.replicate): r.p for r in rows.groupBy(*schema.run_keys_of(rows)).agg(F.sum("population").alias("p")).collect()}
    assert found == {(1, "1"): 100.0, (1, "2"): 300.0, (None, "Other.csv"): 7.0, (None, "Another.csv"): 8.0}


def test_nan_in_parameter_sets_is_missing(spark, tmp_path):
    (tmp_path / "p.csv").write_text("parameterization_id,a\n1,NaN\n2,0.5\n")
    assert {r.parameterization_id: r.a for r in tables.read_parameter_sets(spark, str(tmp_path / "p.csv")).collect()} == {1: None, 2: 0.5}


# Files with headers of their own


def _files(folder, texts):
    for name, text in texts.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    texts = {
        "s one/Report_TPI0001_REP0001.csv": "Year,NodeId,Population,Newly Infected\n2000,1,5,1\n2001,2,6,2\n",
        "s one/Report_TPI0002_REP0001.csv": "Newly.Infected,Population,Year,NodeId\n3,7,2000,1\n",
        "t{x}[1]/Report_TPI0003_REP0001.csv": "\ufeff\"Year\",NodeId,Population,PrEP_Received\r\n2000,1,8,9\r\n",
        "t{x}[1]/Report_TPI0004_REP0001.csv": "",
        "t{x}[1]/Report_TPI0005_REP0001.csv": "Year,NodeId,Population,Newly Infected\n",
        "t{x}[1]/notes.txt": "Other\n1\n",
    }
    _files(tmp_path, texts)
    found = reports.scan_mixed_headers(spark, str(tmp_path), with_file=True)
    rows = {(r.scenario, r.run_num, r.year): (r.population, r.newly_infected, r.prep_received) for r in found.collect()}
    assert rows == {
        ("s one", 1, 2000.0): (5.0, 1.0, None), ("s one", 1, 2001.0): (6.0, 2.0, None), ("s one", 2, 2000.0): (7.0, 3.0, None),
        ("t{x}[1]", 3, 2000.0): (8.0, None, 9.0),
    }
    assert found.where("file IS NULL").count() == 0


def test_as_many_scans_as_headers(spark, tmp_path):
    heads = ["Year,Population", "Population,Year", "Year,Population,On_ART"]
    _files(tmp_path, {f"s/Report_TPI{k:04d}_REP0001.csv": f"{heads[k % 3]}\n2000,2000{',1' * (k % 3 == 2)}\n" for k in range(300)})
    found = reports.scan_mixed_headers(spark, str(tmp_path))
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 3
    assert found.count() == 300 and found.agg({"population": "sum"}).first()[0] == 300 * 2000


def test_mixed_headers_that_cannot_be_read(spark, tmp_path):
    with pytest.raises(reports.MissingSourceError):
        reports.scan_mixed_headers(spark, str(tmp_path / "none"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(reports.MissingSourceError):
        reports.scan_mixed_headers(spark, str(tmp_path / "empty"))
    for folder in ("none", "empty"):
        assert reports.scan_mixed_headers(spark, str(tmp_path / folder), required=False).columns == ["scenario", "run_num", "replicate"]
    _files(tmp_path, {"twice/Report_TPI0001.csv": "Year,On_ART,On.ART\n1,2,3\n"})
    with pytest.raises(ValueError, match="on_art"):
        reports.scan_mixed_headers(spark, str(tmp_path / "twice"))


def test_header_of_scenario_directories_below(spark, tmp_path):
    _files(tmp_path, {"s/Report_TPI0001_REP0001.csv": "Year,Population\n2000,3\n"})
    assert reports.scan_reports(spark, str(tmp_path)).first().population == 3.0


# Results that are replaced


def _result(spark, *rows):
    return spark.createDataFrame(list(rows), "scenario string, output string, year double, value double")


def _shown(spark, path, *which):
    return sorted((r.scenario, r.output, r.value) for r in results.current_results(spark, path, *which).collect())


def test_a_rerun_replaces_its_scenarios_and_outputs(spark, tmp_path):
    path = str(tmp_path / "r")
    results.replace_results(_result(spark, ("a", "x", 1.0, 1.0), ("a", "x", 2.0, 2.0), ("a", "y", 1.0, 3.0), ("7", "x", 1.0, 4.0), (None, "x", 1.0, 5.0)), path)
    results.replace_results(_result(spark, ("a", "x", 1.0, 9.0), ("b", "x", 1.0, 6.0)), path)
    assert _shown(spark, path, None, "a") == [("a", "x", 9.0), ("a", "y", 3.0)]
    assert _shown(spark, path, "x", "7") == [("7", "x", 4.0)]
    assert results.current_results(spark, path).where("scenario IS NULL").first().value == 5.0
    assert results.current_results(spark, path).count() == 5
    # A version with one column more; a null stands for it in the others.
    results.replace_results(_result(spark, ("b", "x", 1.0, 7.0)).withColumn("note", F.lit("n")), path)
    assert {(r.scenario, r.note) for r in results.current_results(spark, path).where("output = 'x'").collect()} == {("a", None), ("7", None), (None, None), ("b", "n")}


def test_a_killed_writer_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "r")
    with pytest.raises(FileNotFoundError):
        results.current_results(spark, path)
    first, second = _result(spark, ("a", "x", 1.0, 1.0)), _result(spark, ("a", "x", 1.0, 2.0), ("b", "x", 1.0, 2.0))
    results.replace_results(first, path)
    version = results.write_version(second, path)  # killed before its record
    (tmp_path / "r" / "commits" / "commit=1" / "_temporary").mkdir(parents=True)  # or while it was written
    assert _shown(spark, path) == [("a", "x", 1.0)]
    failing = second.withColumn("value", F.when(F.col("scenario") == "b", F.raise_error(F.lit("lost")).cast("double")).otherwise(1.0))
    with pytest.raises(PySparkException):
        results.replace_results(failing, path)
    assert _shown(spark, path) == [("a", "x", 1.0)]
    # The next writer passes over the number that was left behind.
    assert results.commit_version(second, path, version) == 2
    assert _shown(spark, path) == [("a", "x", 2.0), ("b", "x", 2.0)]


def test_a_column_that_changed_its_type_fails(spark, tmp_path):
    path = str(tmp_path / "r")
    results.replace_results(_result(spark, ("a", "x", 1.0, 1.0)), path)
    results.replace_results(_result(spark, ("b", "x", 1.0, 1.0)).withColumn("value", F.lit("text")), path)
    with pytest.raises(ValueError, match="value"):
        results.current_results(spark, path)
