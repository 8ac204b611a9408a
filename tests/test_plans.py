"""What the physical plans must and must not contain, skewed inputs, and the registered queries."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from evenhand.operators import cube, fairness, impact, mitigation, whatif
from evenhand.operators.models import LinearScore
from evenhand.plans.audit import run_audit
from evenhand.session import work_dir
from evenhand.sources.applications import PROTECTED, applications, store_applications

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLE = driver.oracle_sql()
QUERIES = driver.queries()


@pytest.fixture(autouse=True)
def uncached(spark):
    """Plans are those of the stored tables, not of what another test has cached."""
    spark.catalog.clearCache()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df, column="o_orderkey"):
    return len(re.findall(r"FileScan parquet \[[^\]]*" + column, plan(df)))


def test_every_metric_comes_from_one_narrow_scan(spark, base):
    df = fairness.all_metrics(applications(spark, base), PROTECTED)
    text = plan(df)
    assert scans(df) == 1
    read = " ".join(re.findall(r"ReadSchema: struct<[^>]*>", text))
    assert "o_custkey" in read and not {"o_orderpriority", "c_acctbal", "c_name"} & set(re.findall(r"\w+", read))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "Python" not in text
    assert text.count("Exchange hashpartitioning") == 3


def test_intersections_cross_no_tables(spark, base):
    text = plan(impact.intersection_impact(applications(spark, base), ["race", "gender"]))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert text.count("InMemoryTableScan") == 2


def test_what_if_scans_once(spark, base):
    rules = {"credit_score": {"type": "threshold", "value": 650, "direction": "increase"}}
    model = LinearScore(-4.0, {"credit_score": 0.008})
    assert scans(whatif.policy_impact_by_group(applications(spark, base), rules, model)) == 1


def test_counterfactuals_exchange_rows_once_and_narrow(spark, base):
    from evenhand.operators import counterfactual

    model = LinearScore(-4.0, {"credit_score": 0.008})
    df = counterfactual.counterfactuals(applications(spark, base), model, {"credit_score": (0, 1, 2)})
    text = plan(df)
    assert text.count("Exchange hashpartitioning(application_id") == 1
    assert text.index("Generate inline") < text.index("Exchange hashpartitioning(application_id")


def test_filters_reach_the_scan(spark, base):
    text = plan(fairness.all_metrics(applications(spark, base).where("loan_type = '1-URGENT'"), ["race"]))
    assert "EqualTo(o_orderpriority,1-URGENT)" in text


def test_stored_applications_are_pruned_by_month(spark, sample, tmp_path):
    stored = spark.read.parquet(store_applications(sample, f"{tmp_path}/t"))
    assert stored.count() == sample.count()
    month = stored.select(F.min("application_month")).first()[0]
    text = plan(cube.rate_cube(stored.where(F.col("application_month") == month), ["race"]))
    assert re.search(r"PartitionFilters: \[[^\]]*application_month", text)


def skewed(spark, n=60_000):
    """A third of all rows in one group and segment."""
    hot = F.col("id") % 3 == 0
    return spark.range(n).select(
        "id",
        F.when(hot, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 500)).alias("race"),
        F.when(hot, "here").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("seg"),
        (F.lit(600) + F.col("id") % 100).cast("int").alias("credit_score"),
        ((F.col("id") % 10) / 10.0).alias("predicted_probability"),
        F.when(F.col("id") % 4 == 0, 1).otherwise(0).alias("approved"),
    )


def test_hot_groups_keep_every_row(spark):
    df = skewed(spark)
    counts = cube.rate_cube(df, ["race"], by=["seg"])
    assert counts.agg(F.sum("n")).first()[0] == 60_000
    assert counts.where("grp = 'hot'").agg(F.sum("n")).first()[0] == 20_000
    weighted = mitigation.reweigh(df.withColumn("approved", (F.col("id") % 2).cast("int") * F.col("approved")), "race")
    assert weighted.count() == 60_000


class Settings:
    """Stand-in for a session with or without a checkpoint folder."""

    def __init__(self, folder):
        self.folder, self.own = folder, None
        self.conf = self.sparkContext = self

    def get(self, key, default):
        return self.folder or default

    def getCheckpointDir(self):
        return self.own

    def setCheckpointDir(self, path):
        self.own = path


def test_work_dir_uses_the_cluster_setting():
    cluster = Settings("hdfs://shared/")
    assert work_dir(cluster, "x").startswith("hdfs://shared/x-")
    assert cluster.own is None
    local = Settings(None)
    first, second = work_dir(local, "x"), work_dir(local, "x")
    assert first != second and first.startswith(local.own) and second.startswith(local.own)


def test_audit_job_writes_consistent_tables(spark, sample, tmp_path):
    paths = run_audit(sample, str(tmp_path), ["race", "gender"], {"history": "approved", "score": "predicted"}, by=["region"])
    tables = {n: spark.read.parquet(p) for n, p in paths.items() if n != "flat"}
    assert tables["metrics"].count() == 2 * 5 * 2 * 5
    assert tables["risk"].count() == 2 * 5 * 2
    assert spark.read.option("header", True).csv(paths["flat"]).count() == 100
    missed = tables["risk"].where("not compliant").join(
        tables["alerts"].where("type = 'COMPLIANCE_VIOLATION'"), ["model", "region", "attribute"], "left_anti"
    )
    assert missed.isEmpty()


@pytest.fixture(scope="module")
def duck(base):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{base}/{t}.parquet'")
    return connection


def in_order(rows):
    """Rows sorted by their exact values first, their doubles last."""
    return sorted(rows, key=lambda r: (repr([v for v in r if not isinstance(v, float)]), [v for v in r if isinstance(v, float)]))


def same(got, want):
    if isinstance(got, float) and isinstance(want, float):
        return abs(got - want) <= 2e-6
    return got == want


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark, base):
    assert driver.entry(spark).count() == 75


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, base, duck, name):
    df = QUERIES[name](spark, base)
    rows = df.collect()
    if name not in ORACLE:
        assert df.columns
        return
    result = duck.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    columns = sorted(names)
    got = in_order([r[c] for c in columns] for r in rows)
    want = in_order([r[names.index(c)] for c in columns] for r in result.fetchall())
    assert len(got) == len(want)
    different = [(g, w) for g, w in zip(got, want) if not all(map(same, g, w))]
    assert not different[:3]
