"""CSV ingest and export, schema reference, bucketed tables, ad hoc SQL guard."""

import pytest

from creditloom.operators import adhoc, portfolio
from creditloom.plans import analyses, sql_catalogue
from creditloom.sources import csv, schemas, tables as tables_module, versions

APPLICATIONS = """TARGET,SK_ID_CURR,AMT_CREDIT,CODE_GENDER,CNT_CHILDREN,NOTE
1,100,1000,M,0,plain
0,101,1500.5,XNA,2,"quoted, with comma"
,102,,F,,
"""
BUREAU = "SK_ID_CURR,SK_ID_BUREAU,CREDIT_ACTIVE\n100,1,Active\n100,2,Closed\n"
PREVIOUS = "SK_ID_PREV,SK_ID_CURR,NAME_CONTRACT_STATUS\n7,101,Refused\n"


def write(folder, application=APPLICATIONS):
    folder.mkdir(parents=True)
    (folder / "application_train.csv").write_text(application)
    (folder / "bureau.csv").write_text(BUREAU)
    (folder / "previous_application.csv").write_text(PREVIOUS)


def test_source_resolution(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        csv.resolve_source(spark, root)
    write(tmp_path / "raw")
    assert csv.resolve_source(spark, root) == f"{root}/raw"
    write(tmp_path / "sample")
    assert csv.resolve_source(spark, root) == f"{root}/sample"
    assert csv.resolve_source(spark, root, use_sample=False) == f"{root}/raw"


def test_ingest(spark, tmp_path):
    write(tmp_path / "raw")
    loaded = csv.ingest_csv(spark, str(tmp_path / "raw"), str(tmp_path / "out"))
    apps = loaded["applications"]
    types = dict(apps.dtypes)
    assert types["SK_ID_CURR"] == "bigint" and types["AMT_CREDIT"] == "double" and types["TARGET"] == "int"
    assert types["CNT_CHILDREN"] == "int" and types["NOTE"] == "string"
    rows = {r["SK_ID_CURR"]: r for r in apps.collect()}
    assert rows[101]["AMT_CREDIT"] == 1500.5 and rows[101]["NOTE"] == "quoted, with comma"
    assert rows[102]["TARGET"] is None and rows[102]["AMT_CREDIT"] is None
    counts = {r[0]: r[1] for r in schemas.verify_counts(loaded).collect()}
    assert counts == {"applications": 3, "bureau": 2, "previous_application": 1}
    # A second ingest leaves the tables alone, unless told to overwrite.
    write(tmp_path / "other", "SK_ID_CURR,TARGET\n1,0\n")
    again = csv.ingest_csv(spark, str(tmp_path / "other"), str(tmp_path / "out"))
    assert again["applications"].count() == 3
    new = csv.ingest_csv(spark, str(tmp_path / "other"), str(tmp_path / "out"), overwrite=True)
    assert new["applications"].count() == 1


def test_value_of_the_wrong_type_fails(spark, tmp_path):
    write(tmp_path / "raw", "SK_ID_CURR,TARGET\nabc,0\n")
    with pytest.raises(Exception, match="abc|MALFORMED|FAILED"):
        csv.ingest_csv(spark, str(tmp_path / "raw"), str(tmp_path / "out"))


def test_latin1_descriptions(spark, tmp_path):
    path = tmp_path / "description.csv"
    path.write_bytes("Table,Description\nbureau,Crédit à l'étranger\n".encode("latin-1"))
    schema = spark.createDataFrame([], "Table string, Description string").schema
    df = csv.read_csv(spark, str(path), schema, encoding=schemas.DESCRIPTION_ENCODING)
    assert df.first()["Description"] == "Crédit à l'étranger"


def test_export_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", 1.5), (2, None, None)], "i int, s string, x double")
    csv.export_csv(df, str(tmp_path / "out"))
    assert sorted(csv.read_csv(spark, str(tmp_path / "out"), df.schema).collect(), key=lambda r: r["i"]) == df.collect()


QUOTED = ['plain', 'a "b"', '"a ""b"", c"', "comma, here", " spaces ", "back\\slash", "semi;colon", ""]


def test_dialect_of_other_tools(spark, tmp_path):
    """Files of pandas are read as pandas reads them, and pandas reads ours."""
    import pandas as pd

    frame = pd.DataFrame({"i": range(len(QUOTED)), "s": QUOTED})
    schema = spark.createDataFrame([], "i int, s string").schema
    frame.to_csv(tmp_path / "theirs.csv", index=False)
    got = {r["i"]: r["s"] or "" for r in csv.read_csv(spark, str(tmp_path / "theirs.csv"), schema).collect()}
    assert got == dict(enumerate(QUOTED))
    csv.export_csv(spark.createDataFrame(frame, schema).coalesce(1), str(tmp_path / "ours"))
    [part] = (tmp_path / "ours").glob("part-*.csv")
    read = pd.read_csv(part, keep_default_na=False)
    assert dict(zip(read["i"], read["s"], strict=True)) == dict(enumerate(QUOTED))


def test_line_breaks_inside_quotes(spark, tmp_path):
    import pandas as pd

    texts = ["one\ntwo", 'three "four"\r\nfive', "six"]
    pd.DataFrame({"i": range(3), "s": texts}).to_csv(tmp_path / "lines.csv", index=False)
    schema = spark.createDataFrame([], "i int, s string").schema
    rows = csv.read_csv(spark, str(tmp_path / "lines.csv"), schema, multi_line=True).collect()
    assert [r["s"].replace("\r\n", "\n") for r in rows] == [t.replace("\r\n", "\n") for t in texts]
    csv.export_csv(spark.createDataFrame(list(enumerate(texts)), schema).coalesce(1), str(tmp_path / "out"))
    [part] = (tmp_path / "out").glob("part-*.csv")
    assert [t.replace("\r\n", "\n") for t in pd.read_csv(part)["s"]] == [t.replace("\r\n", "\n") for t in texts]


def test_half_written_tables_are_loaded_again(spark, tmp_path):
    write(tmp_path / "raw")
    (tmp_path / "out" / "applications" / "_temporary").mkdir(parents=True)
    loaded = csv.ingest_csv(spark, str(tmp_path / "raw"), str(tmp_path / "out"))
    assert loaded["applications"].count() == 3
    assert versions.current(spark, f"{tmp_path}/out/applications") is not None
    assert versions.current(spark, f"{tmp_path}/out/none") is None


def test_a_writer_that_fails_publishes_nothing(spark, tmp_path):
    """An overwrite that breaks off half-way leaves the table, its count and its readers as they were."""
    write(tmp_path / "raw")
    out = str(tmp_path / "out")
    before = csv.ingest_csv(spark, str(tmp_path / "raw"), out)["applications"]
    version = versions.current(spark, f"{out}/applications")
    rows = "".join(f"{i},0\n" for i in range(5000))
    write(tmp_path / "bad", f"SK_ID_CURR,TARGET\n{rows}x,0\n")
    with pytest.raises(Exception, match="x|MALFORMED|FAILED"):
        csv.ingest_csv(spark, str(tmp_path / "bad"), out, overwrite=True)
    assert versions.current(spark, f"{out}/applications") == version
    assert before.count() == 3 and tables_module.load_tables(spark, out)["applications"].count() == 3
    counts = {r[0]: r[1] for r in tables_module.load_manifest(spark, out).collect()}
    assert counts == {"applications": 3, "bureau": 2, "previous_application": 1}
    # Readers of an older version go on while a newer one is published.
    write(tmp_path / "good", "SK_ID_CURR,TARGET\n1,0\n")
    assert csv.ingest_csv(spark, str(tmp_path / "good"), out, overwrite=True)["applications"].count() == 1
    assert before.count() == 3
    assert versions.forget_old(spark, f"{out}/applications") == 1
    assert tables_module.load_tables(spark, out)["applications"].count() == 1


def test_writers_at_the_same_time(spark, tmp_path):
    """A version published while another is being written is not lost sight of, and all readers agree on the last."""
    folder = str(tmp_path / "thing")

    def slow(path):
        versions.publish(spark, folder, lambda inner: {"n": 1})
        return {"n": 2}

    last = versions.publish(spark, folder, slow)
    assert versions.current(spark, folder) == last and versions.manifest(spark, last) == {"n": 2}
    (tmp_path / "thing" / "_published" / "stray").write_text("")
    (tmp_path / "thing" / "v-half").mkdir()
    assert versions.current(spark, folder) == last
    with pytest.raises(ZeroDivisionError):
        versions.publish(spark, folder, lambda path: {"n": 1 // 0})
    assert versions.current(spark, folder) == last and versions.forget_old(spark, folder) == 1


def test_some_tables_only(spark, tmp_path):
    write(tmp_path / "raw")
    only = {"bureau": csv.CSV_FILES["bureau"]}
    loaded = csv.ingest_csv(spark, str(tmp_path / "raw"), str(tmp_path / "out"), only)
    assert list(loaded) == ["bureau"] and loaded["bureau"].count() == 2


def test_sample_dataset_can_be_ingested(spark, tables, tmp_path):
    analyses.sample_dataset(tables.named(), str(tmp_path / "sample"), {0: 200, 1: 20})
    loaded = csv.ingest_csv(spark, csv.resolve_source(spark, str(tmp_path)), str(tmp_path / "out"))
    apps = loaded["applications"]
    assert {r[0]: r[1] for r in apps.groupBy("TARGET").count().collect()} == {0: 200, 1: 20}
    for name in ("bureau", "previous_application"):
        assert loaded[name].join(apps, "SK_ID_CURR", "left_anti").count() == 0
        kept = tables.named()[name].join(apps.select("SK_ID_CURR"), "SK_ID_CURR", "left_semi")
        assert loaded[name].count() == kept.count() > 0


def test_schema_reference(spark, tables):
    rows = schemas.schema_reference(spark, tables.named()).collect()
    target = next(r for r in rows if r["table_name"] == "applications" and r["column_name"] == "TARGET")
    assert target["comment"] == "1 = defaulted, 0 = repaid" and target["row_count"] == 1500


def test_bucketed_tables_join_without_shuffle(spark, tables, tmp_path):
    tables_module.save_bucketed(tables.named(), str(tmp_path), buckets=4, prefix="bucketed_")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        apps, bureau = spark.table("bucketed_applications"), spark.table("bucketed_bureau")
        df = portfolio.bureau_count_per_borrower(apps, bureau)
        assert df.agg({"bureau_count": "sum"}).first()[0] == 6000 - bureau.join(apps, "SK_ID_CURR", "left_anti").count()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, plan
        # One file for each bucket, however many tasks write.
        many = {"applications": tables.applications.repartition(12)}
        tables_module.save_bucketed(many, str(tmp_path / "many"), buckets=8, prefix="many_")
        assert len(list((tmp_path / "many" / "many_applications").glob("part-*"))) == 8
    finally:
        spark.sql("DROP TABLE IF EXISTS many_applications")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        for name in schemas.SCHEMAS:
            spark.sql(f"DROP TABLE IF EXISTS bucketed_{name}")


@pytest.mark.parametrize("verb", [*adhoc.BLOCKED, *adhoc.BLOCKED_HERE])
def test_blocked_words(verb):
    for text in (f"{verb} TABLE x", f"SELECT 1 /* x */ {verb.lower()} y", f"WITH a AS (SELECT 1)\n{verb.title()} INTO b"):
        assert adhoc.check_query(text) == f"Blocked: {verb} statements not allowed"


@pytest.mark.parametrize(
    "text",
    [
        "SELECT 'DROP TABLE x'",
        "SELECT updated_at, created FROM t",
        "-- DELETE everything\nSELECT 1",
        "/* UPDATE */ (SELECT 1) ;  ",
        "SELECT 'it''s; fine', \"a;b\"",
        "VALUES (1), (2)",
        "WITH a AS (SELECT 1) SELECT * FROM a JOIN b USING (k)",
        "SELECT `drop` FROM t",
        r"SELECT 'escaped \' quote; DROP'",
    ],
)
def test_allowed(text):
    assert adhoc.check_query(text) is None


@pytest.mark.parametrize(
    "text",
    [
        "",
        "  -- nothing",
        "SELECT 1; SELECT 2",
        "SHOW TABLES",
        "PRAGMA x",
        "SET a=b",
        "ADD JAR 'x'",
        "EXPLAIN SELECT 1",
        "SELECT TRANSFORM(a) USING 'cat' FROM t",
        "REPLACE TABLE x",
        "DROP/**/TABLE x",
        "SELECT 1 --'\n; DROP TABLE x --'",
    ],
)
def test_refused(text):
    assert adhoc.check_query(text) is not None


RAW = "WITH a AS (SELECT r'" + chr(92) + "' AS x) INSERT INTO t SELECT ' ' FROM a"


@pytest.mark.parametrize(
    "text",
    [
        "WITH a AS (SELECT 1 AS x) --\rINSERT INTO t SELECT * FROM a",
        RAW,
        "WITH a AS (SELECT 1 AS x) INSERT INTO t SELECT * FROM a",
        "WITH a AS (SELECT 1 AS x) INSERT OVERWRITE TABLE t SELECT * FROM a",
        "FROM applications INSERT INTO t SELECT *",
        "BEGIN SELECT 1; END",
        "SELECT /* a /* b */ c */ 1; DROP TABLE t",
        "SELECT * FROM parquet.`/some/path`",
        "WITH a AS (SELECT * FROM csv.`/some/path`) SELECT * FROM a",
        "SELECT 1 WHERE EXISTS (SELECT * FROM text.`/some/path`)",
        "SELECT (SELECT max(value) FROM text.`/some/path`)",
    ],
)
def test_the_parsed_plan_decides(spark, monkeypatch, text):
    df, error = adhoc.run_query(spark, text)
    assert df is None and error
    # Even if the word list let it through.
    monkeypatch.setattr(adhoc, "check_query", lambda sql: None)
    df, error = adhoc.run_query(spark, text)
    assert df is None and error


def test_plans_that_read_may_run(spark):
    spark.range(3).createOrReplaceTempView("numbers")
    for text in (
        "SELECT (SELECT max(id) FROM numbers) AS m, id FROM numbers WHERE id IN (SELECT id FROM numbers)",
        "WITH a AS (SELECT /* x /* y */ z */ id FROM numbers) SELECT * FROM a UNION ALL SELECT * FROM a",
        "SELECT r'" + chr(92) + "' AS x, id FROM numbers --\r",
    ):
        df, error = adhoc.run_query(spark, text)
        assert error is None and df.count() >= 3


def test_run_query(spark, tables):
    tables_module.register(tables.named())
    df, error = adhoc.run_query(spark, "SELECT count(*) AS n FROM applications;")
    assert error is None and df.first()["n"] == 1500
    for bad in ("SELECT nope FROM applications", "SELECT * FROM absent", "SELECT FROM WHERE"):
        df, error = adhoc.run_query(spark, bad)
        assert df is None and error
    for title, text in {**sql_catalogue.EXAMPLE_QUERIES, **sql_catalogue.QUERY_TIPS}.items():
        df, error = adhoc.run_query(spark, text)
        assert error is None, (title, error)
        assert df.limit(1).count() == 1


def test_analyses(tables):
    overview = analyses.portfolio_overview(tables.applications)
    assert overview["threshold"].first()["flag"].endswith("8% threshold")
    assert overview["income"].agg({"count": "sum"}).first()[0] > 0
    parts = analyses.default_drivers(tables.applications)
    assert parts["correlation"].count() == 15 and parts["matrix"].count() == 81


CALLS = [
    "SELECT `java_method`('java.lang.System','getProperty','java.version')",
    "SELECT `reflect`('java.util.UUID', 'randomUUID')",
    "SELECT k FROM VALUES (1) AS t(k) WHERE `try_reflect`('java.lang.System','getenv','HOME') IS NOT NULL",
    "WITH a AS (SELECT `REFLECT`('java.lang.System','lineSeparator') AS x) SELECT (SELECT max(x) FROM a)",
    "SELECT transform(array(1), x -> `java_method`('java.lang.Math','abs',x)) AS y",
    "SELECT upper(coalesce(NULL, `java_method`('java.lang.System','getProperty','user.dir')))",
    "SELECT 1 AS a ORDER BY `java_method`('java.lang.System','getProperty','java.version')",
]
COMPUTED = [
    "SELECT IDENTIFIER('reflect')('java.lang.System','getProperty','java.version')",
    "SELECT IDENTIFIER('java_' || 'method')('java.lang.System','getProperty','java.version')",
    "SELECT count(*) FROM IDENTIFIER('applications')",
    "SELECT * FROM (SELECT 1 AS a) WHERE a IN (SELECT count(*) FROM IDENTIFIER('x' || 'y'))",
]


@pytest.mark.parametrize("text", CALLS)
def test_functions_that_call_java_are_refused_by_what_they_are(spark, tables, text):
    assert adhoc.run_query(spark, text) == (None, "Blocked: functions that call Java not allowed")


@pytest.mark.parametrize("text", COMPUTED)
def test_computed_names_are_refused(spark, text):
    assert adhoc.run_query(spark, text) == (None, "Blocked: computed names not allowed")


def test_files_are_refused_however_they_are_named(spark, tables, tmp_path):
    path = f"{tmp_path}/file"
    spark.range(3).write.parquet(path)
    for text in (
        f"SELECT count(*) FROM IDENTIFIER('parquet.`{path}`')",
        f"SELECT count(*) FROM parquet.`{path}`",
        f"SELECT 1 WHERE EXISTS (SELECT * FROM `parquet`.`{path}`)",
        f"WITH a AS (SELECT * FROM parquet.`{path}`) SELECT count(*) FROM a",
    ):
        df, error = adhoc.run_query(spark, text)
        assert df is None and error.startswith("Blocked: "), text
    # Even where a database is called like a file format, the relation itself gives it away.
    spark.sql("CREATE DATABASE IF NOT EXISTS parquet")
    try:
        df, error = adhoc.run_query(spark, f"SELECT count(*) FROM parquet.`{path}`")
        assert df is None and "Blocked: only registered tables" in error
    finally:
        spark.sql("DROP DATABASE parquet")


def test_what_reads_is_allowed(spark, tables, tmp_path):
    """Views, catalog tables, CTEs, subqueries, generated rows and functions with harmless internals."""
    spark.range(4).write.parquet(f"{tmp_path}/plain")
    spark.read.parquet(f"{tmp_path}/plain").createOrReplaceTempView("plain_files")
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW nested AS SELECT id * 2 AS id FROM plain_files")
    spark.sql(f"CREATE TABLE kept_rows USING parquet LOCATION '{tmp_path}/kept' AS SELECT 7L AS id")
    allowed = {
        "SELECT count(*) FROM plain_files": 4,
        "SELECT sum(id) FROM nested": 12,
        "SELECT id FROM kept_rows": 7,
        "SELECT id FROM default.kept_rows": 7,
        "WITH a AS (SELECT 1 AS x UNION ALL SELECT 2) SELECT (SELECT max(x) FROM a) + (SELECT min(x) FROM a)": 3,
        "SELECT count(*) FROM range(5) JOIN VALUES (1), (2) AS t(k) ON id = k": 2,
        "SELECT length(aes_encrypt('a', '0000111122223333')) + url_decode('1') - 1": 29,
        "SELECT count(*) FROM explode(array(1, 2, 3))": 3,
        "SELECT max(y) FROM nested LATERAL VIEW explode(array(id, 9)) AS y": 9,
        "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 5) SELECT max(n) FROM r": 5,
        "SELECT 'java_method reflect IDENTIFIER(x)' IS NOT NULL": True,
        "SELECT x.reflects FROM (SELECT 1 AS reflects) x": 1,
    }
    try:
        for text, want in allowed.items():
            df, error = adhoc.run_query(spark, text)
            assert error is None, (text, error)
            assert df.first()[0] == want, text
    finally:
        spark.sql("DROP TABLE kept_rows")
        for name in ("plain_files", "nested"):
            spark.catalog.dropTempView(name)


def test_analysis_writes_nothing(spark, tmp_path):
    """Statements are analysed only: neither the refused nor the allowed ones execute before they are read."""
    for text in (f"CREATE TABLE made USING parquet LOCATION '{tmp_path}/made' AS SELECT 1", "DROP TABLE applications"):
        assert adhoc.check_plan(spark, text) == "Blocked: only statements that read are allowed"
    assert not (tmp_path / "made").exists()
