import re
from collections import Counter
from functools import reduce
from uuid import uuid4

import pytest
from pyspark.sql.classic.dataframe import DataFrame

import __spark_entry__ as entry
from compare import duck, spark_rows
from tessera.plans import catalogue
from tessera.plans import fixtures as X


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, data, name):
    names, rows = spark_rows(catalogue.QUERIES[name](spark, data))
    wanted, expected = duck(catalogue.ORACLES[name], data)
    assert names == wanted and len(rows) == len(expected)
    assert rows == expected and rows


def test_entry(spark):
    assert entry.entry(spark).count() == 5


def test_every_query_has_sql_or_is_a_kernel():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == {"pixel_regions"}


@pytest.mark.parametrize("name", ["family_nodes", "family_containers"])
def test_query_without_broadcasts(spark, data, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as over tables that are too large for them
    try:
        assert spark_rows(catalogue.QUERIES[name](spark, data)) == duck(catalogue.ORACLES[name], data)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def exchanges(spark, query, data):
    """What the plan shuffles by and why, if only the list of stages is small enough for a broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        return re.findall(r" Exchange (\w+)\(.*?\), (\w+)", query(spark, data)._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize(("name", "counts"), [("container_audit", 0), ("geometry_audit", 0), ("snap_effects", 1), ("audit_status_counts", 1)])
def test_audits_shuffle_lines_only(spark, data, name, counts, monkeypatch):
    monkeypatch.setattr(DataFrame, "checkpoint", lambda *_: pytest.fail("pairs are written"))
    found = exchanges(spark, catalogue.QUERIES[name], data)
    assert {x for x in found if x[1] != "ENSURE_REQUIREMENTS"} == {("hashpartitioning", "REPARTITION_BY_NUM")}
    assert sum(x[1] == "ENSURE_REQUIREMENTS" for x in found) == counts  # of the counts at the end


def test_lines_of_a_task_are_bounded(spark, data, monkeypatch):
    lines = spark.read.parquet(f"{data}/lineitem.parquet").count()
    parts = lambda: {df.rdd.getNumPartitions() for df in X.by_slide(spark, data)}
    assert parts() == {4}  # the shuffle's, while they do
    monkeypatch.setattr(X, "LINES", 500)
    assert parts() == {-(-lines // 500)}


@pytest.mark.parametrize("name", ["geometry_audit", "audit_status_counts", "snap_effects"])
def test_audits_run_compiled(spark, data, name):
    """The JVM interprets methods of more than 8000 bytes."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = spark._jvm.PythonSQLUtils.explainString(catalogue.QUERIES[name](spark, data)._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8000


def written(spark, run):
    """What `run` writes to shuffles, in bytes."""
    context = spark.sparkContext
    group = f"{run.__name__} {uuid4()}"
    context.setJobGroup(group, "")
    run()
    context._jsc.sc().listenerBus().waitUntilEmpty()
    tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    context.setLocalProperty("spark.jobGroup.id", None)
    return sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages)


@pytest.mark.parametrize("name", ["snap_effects", "audit_status_counts"])
def test_audits_shuffle_packed_lines(spark, data, name):
    lines = spark.read.parquet(f"{data}/lineitem.parquet").count()

    def counted():
        catalogue.QUERIES[name](spark, data).collect()

    def as_they_are():
        spark.read.parquet(f"{data}/lineitem.parquet").repartition(4, "l_orderkey").write.format("noop").mode("overwrite").save()

    assert 10 * lines < written(spark, counted) < 0.75 * written(spark, as_they_are)


def test_lines_come_back_from_packing(spark, data):
    lines = spark.read.parquet(f"{data}/lineitem.parquet")
    one = {k: f"{k}" for k in lines.columns} | {"l_extendedprice": "CAST(901.5 AS DOUBLE)", "l_quantity": "CAST(17 AS DOUBLE)"}
    odd = [
        {}, {"l_partkey": "NULL"}, {"l_partkey": "-1"}, {"l_partkey": "2147483647"}, {"l_partkey": "2147483648"}, {"l_suppkey": "16777215"}, {"l_suppkey": "16777216"}, {"l_linenumber": "255"}, {"l_linenumber": "256"}, {"l_linenumber": "-3"},
        {"l_quantity": "0.5"}, {"l_quantity": "255"}, {"l_quantity": "256"}, {"l_quantity": "NULL"}, {"l_extendedprice": "'NaN'"}, {"l_extendedprice": "'Infinity'"}, {"l_extendedprice": "1e300"}, {"l_extendedprice": "42949672.95"},
        {"l_extendedprice": "42949672.96"}, {"l_extendedprice": "0.001"}, {"l_extendedprice": "-5"}, {"l_discount": "0.07"}, {"l_discount": "0.070000001"}, {"l_tax": "2.55"}, {"l_tax": "2.56"}, {"l_tax": "NULL"}, {"l_returnflag": "''"},
        {"l_returnflag": "'RR'"}, {"l_returnflag": "'é'"}, {"l_returnflag": "'ж'"}, {"l_linestatus": "NULL"}, {"l_shipdate": "'1969-12-31 00:00:00'"}, {"l_shipdate": "'1996-03-13 00:00:01'"}, {"l_shipdate": "'9999-12-31 00:00:00'"}, {"l_shipdate": "NULL"},
    ]
    rows = lines.limit(1)
    rows = [rows.selectExpr(*(f"CAST({v} AS {t}) AS {k}" for (k, v), t in zip((one | x).items(), dict(lines.dtypes).values(), strict=True))) for x in odd]
    rows = reduce(lambda a, b: a.union(b), [*rows, lines])
    found = X.unpacked(X.packed(rows), dict(lines.dtypes)).select(*rows.columns)
    assert found.dtypes == rows.dtypes and Counter(map(str, found.collect())) == Counter(map(str, rows.collect()))
    assert X.packed(lines).where("plain is not null").isEmpty()
    kept = X.packed(rows).where("plain is not null").count()
    assert 20 <= kept < len(odd)


def test_audits_shuffle_the_bits_that_lines_need(spark, data):
    def counted():
        catalogue.QUERIES["audit_status_counts"](spark, data).collect()

    def as_they_are():
        spark.read.parquet(f"{data}/lineitem.parquet").repartition(4, "l_orderkey").write.format("noop").mode("overwrite").save()

    assert written(spark, counted) < 0.5 * written(spark, as_they_are)


def test_lines_come_back_from_their_bounds(spark, data):
    lines = spark.read.parquet(f"{data}/lineitem.parquet")
    kinds, some = dict(lines.dtypes), lines.where("l_linenumber = 3 AND l_partkey > 9 AND l_returnflag <> 'R'")
    count, bounds = X.bounds_of(some)
    low = {"l_partkey": "min(l_partkey)", "l_quantity": "CAST(min(l_quantity) AS BIGINT)", "l_extendedprice": "CAST(round(min(l_extendedprice) * 100) AS BIGINT)", "l_shipdate": "unix_date(CAST(min(l_shipdate) AS DATE))"}
    assert count == some.count() > 0 and {k: bounds[k][0] for k in low} == some.selectExpr(*(f"{v} AS {k}" for k, v in low.items())).first().asDict()
    assert X.packed(some, bounds).where("plain IS NOT NULL").isEmpty() and not X.packed(lines, bounds).where("plain IS NOT NULL").isEmpty()
    wide = {name: (0, 2**most - 1) for name, most, _ in X.PACKED}
    nothing = X.bounds_of(lines.limit(0))
    assert nothing == (0, dict.fromkeys(wide, (0, 0)))
    one = lines.limit(1)
    for rows, b in ((some, bounds), (lines, bounds), (lines, wide), (lines, nothing[1]), (one, X.bounds_of(one)[1]), *((lines, X.bounds_of(lines)[1] | {k: wide[k]}) for k in wide)):
        found = X.unpacked(X.packed(rows, b), kinds, b).select(*rows.columns)
        assert found.dtypes == rows.dtypes and found.exceptAll(rows).isEmpty() and rows.exceptAll(found).isEmpty()
