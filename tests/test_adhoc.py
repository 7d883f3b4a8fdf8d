import pytest

from harborline.plans.adhoc import safe_select

VIEWS = {"small": lambda session: session.range(2500).withColumnRenamed("id", "n")}


def test_rows_are_capped_and_counted(spark):
    answer = safe_select(spark, "SELECT n FROM small WHERE n >= 5;", VIEWS)
    assert answer.error is None and answer.total == 2495 and answer.rows.count() == 1000
    assert safe_select(spark, "with t as (select max(n) m from small) select m from t", VIEWS).rows.first().m == 2499


@pytest.mark.parametrize("sql", [
    "DROP TABLE small",
    "SELECT 1; DROP VIEW small",
    "SELECT reflect('java.lang.System', 'exit', '1')",
    "SELECT `java_method`('java.lang.System', 'getProperty', 'user.dir')",
    "SELECT TRANSFORM(n) USING 'cat' AS (x) FROM small",
    "WITH t AS (SELECT 1 AS n) INSERT INTO small SELECT n FROM t",
    "SELECT * FROM parquet.`/root/testdata/sf0.001/orders.parquet`",
    "SELECT * FROM (SELECT 1) AS answer; SELECT 2",
    "SELECT nothing FROM small",
    "",
])
def test_everything_else_is_refused(spark, sql):
    answer = safe_select(spark, sql, VIEWS)
    assert answer.error and answer.rows is None


def test_stored_tables_are_hidden(spark, tmp_path):
    spark.sql(f"CREATE TABLE hidden_rows (a int) USING parquet LOCATION '{tmp_path}/hidden'")
    try:
        assert "not allowed" in safe_select(spark, "SELECT * FROM default.hidden_rows", VIEWS).error
        sneaky = "SELECT * FROM (WITH hidden_rows AS (SELECT 1) SELECT * FROM hidden_rows) x, hidden_rows"
        assert "not allowed" in safe_select(spark, sneaky, VIEWS).error
    finally:
        spark.sql("DROP TABLE hidden_rows")


def test_other_databases_and_global_views_are_hidden(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS elsewhere")
    spark.range(3).createOrReplaceGlobalTempView("shared_rows")
    try:
        for name in ("elsewhere.rows", "global_temp.shared_rows"):
            assert "not allowed" in safe_select(spark, f"SELECT count(*) FROM {name}", VIEWS).error
            nested = f"SELECT n FROM small WHERE n IN (SELECT id FROM {name})"
            assert "not allowed" in safe_select(spark, nested, VIEWS).error
    finally:
        spark.catalog.dropGlobalTempView("shared_rows")
        spark.sql("DROP DATABASE elsewhere")


def test_words_in_literals_are_free(spark):
    answer = safe_select(spark, "SELECT 'shipped using rail, reflect' AS w FROM small LIMIT 1", VIEWS)
    assert answer.error is None and answer.rows.first().w.startswith("shipped")


@pytest.fixture
def other_database(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS pdb")
    spark.range(5).write.mode("overwrite").saveAsTable("pdb.secret")
    spark.sql("CREATE OR REPLACE VIEW pdb.seen AS SELECT * FROM pdb.secret")
    yield
    spark.sql("DROP DATABASE pdb CASCADE")


@pytest.mark.parametrize("sql", [
    "SELECT * FROM IDENTIFIER('pdb.secret')",
    "SELECT n FROM small WHERE n IN (SELECT id FROM IDENTIFIER('pdb.secret'))",
    "SELECT IDENTIFIER('ref'||'lect')('java.lang.System','getProperty','user.home')",
    "SELECT IDENTIFIER('n') FROM small",
    "SELECT * FROM IDENTIFIER('sm' || 'all')",
    "WITH t AS (SELECT * FROM IDENTIFIER('pdb.seen')) SELECT * FROM t",
    "SELECT (SELECT max(id) FROM pdb.secret)",
    "SELECT * FROM small, LATERAL (SELECT * FROM pdb.seen)",
    "SELECT * FROM pdb.seen",
    "SELECT * FROM range(10)",
    "SELECT * FROM read_files('/root')",
    "SELECT input_file_name() FROM small",
    "SELECT system.builtin.reflect('java.lang.System', 'getProperty', 'user.home')",
    "SELECT builtin.java_method('java.lang.System', 'getProperty', 'user.home')",
    "SELECT try_reflect('java.lang.System', 'getProperty', 'user.home')",
    "SELECT current_user(), current_catalog()",
    "SELECT n FROM small LATERAL VIEW reflect('java.lang.System', 'getProperty', 'user.home') t AS x",
    "SELECT no_such_function(n) FROM small",
])
def test_computed_names_other_tables_and_functions_are_refused(spark, other_database, sql):
    answer = safe_select(spark, sql, VIEWS)
    assert answer.error and answer.rows is None


def test_the_plan_is_judged_without_the_text(spark, other_database):
    """The second gate alone: what the first would have stopped is found in the analysed plan."""
    from harborline.plans.adhoc import _refused_plan

    spark.range(4).createOrReplaceTempView("small")
    try:
        def judged(sql):
            return _refused_plan(spark.sql(sql)._jdf.queryExecution().analyzed(), {"small"})

        assert judged("SELECT id FROM small WHERE id > (SELECT avg(id) FROM small)") is None
        for sql in (
            "SELECT * FROM pdb.secret", "SELECT * FROM pdb.seen", "SELECT * FROM IDENTIFIER('pdb.secret')", "SELECT * FROM range(3)",
            "SELECT id FROM small WHERE id IN (SELECT id FROM pdb.secret)", "SELECT (SELECT max(id) FROM pdb.seen)",
            "SELECT reflect('java.lang.System', 'getProperty', 'user.home')",
            "WITH t AS (SELECT * FROM pdb.secret) SELECT * FROM t",
        ):
            assert judged(sql), sql
    finally:
        spark.catalog.dropTempView("small")


@pytest.mark.parametrize("sql", [
    "SELECT n % 7 AS k, count(*) c, sum(n) s, stddev(n) d, percentile_approx(n, 0.5) m FROM small GROUP BY ROLLUP(n % 7) HAVING count(*) > 3 ORDER BY k",
    "WITH a AS (SELECT n FROM small), b AS (SELECT max(n) AS top FROM a) SELECT * FROM a JOIN b ON a.n = b.top",
    "SELECT * FROM (SELECT n, row_number() OVER (PARTITION BY n % 3 ORDER BY n DESC) r, lag(n) OVER (ORDER BY n) l FROM small) WHERE r < 3",
    "SELECT n, x FROM small LATERAL VIEW explode(sequence(1, 3)) t AS x WHERE EXISTS (SELECT 1 FROM small s WHERE s.n = small.n + 1)",
    "SELECT * FROM VALUES (1, 'reflect'), (2, 'pdb.secret') AS t(a, b)",
    "SELECT CASE WHEN n BETWEEN 1 AND 5 THEN upper('x') ELSE NULL END, cast(n AS string), date_add(DATE '2024-01-01', cast(n AS int)), "
    "extract(year FROM DATE '2024-01-01'), n IN (1, 2), transform(array(n), v -> v + 1), coalesce(nullif(n, 3), 0) FROM small",
    "SELECT n FROM small UNION ALL SELECT n FROM small EXCEPT SELECT n FROM small WHERE n > 3",
    "SELECT n AS identifier, n AS `pdb.secret` FROM small -- reflect",
    "SELECT typeof(n), try_divide(n, 0), regexp_extract('a1', '([0-9])', 1), split('a b', ' ')[0], to_json(struct(n)) FROM small",
])
def test_ordinary_queries_run(spark, sql):
    answer = safe_select(spark, sql, VIEWS)
    assert answer.error is None and answer.rows.count() == min(answer.total, 1000)
