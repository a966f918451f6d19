"""The shared folder and the life of materialised tables."""

import glob

import pytest

from sedimark import session


class Elsewhere:
    """A session on a cluster that names no shared folder."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        master = "spark://host:7077"


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    Elsewhere.sparkContext.master = master
    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        session.shared_dir(Elsewhere)


def test_one_machine_does_without(spark):
    Elsewhere.sparkContext.master = "local[4]"
    assert session.shared_dir(Elsewhere) == session.LOCAL_SHARED_DIR


def files(df):
    return glob.glob(df._materialized_at.removeprefix("file://") + "/*.parquet")


def test_tables_go_when_a_stage_ends(spark):
    before = session.materialize(spark.range(3))
    with session.stage(before) as kept:
        part = session.materialize(spark.range(4))
        out = session.materialize(part.selectExpr("id + 1 AS id"))
        kept.append(out)
        assert files(before) and files(part)
    assert not files(before) and not files(part) and out.count() == 4
    session.release(spark.range(2))
    session.release(out)
    session.release(out)
    assert not files(out)


def test_cleaning_goes_on_after_an_error(spark):
    good = session.materialize(spark.range(1))
    written = dict(session._written)
    session._written.clear()
    session._written.update({"broken": None, good._materialized_at: spark})
    session._clean()
    assert not files(good) and not session._written
    session._written.update({k: v for k, v in written.items() if k != good._materialized_at})


def test_buckets_save_the_shuffle(spark):
    rows = spark.range(1000).selectExpr("id % 50 AS k", "id AS v")
    a, b = session.bucketed(rows, "a", ["k"]), session.bucketed(rows.distinct(), "b", ["k"])
    joined = a.join(b.hint("merge"), "k").groupBy("k").count()
    assert joined.count() == 50
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
    name = session._names[a._materialized_at]
    session.release(a)
    assert not spark.catalog.tableExists(name) and not files(a)


def test_built_once_for_each_state_of_a_table(spark, tmp_path):
    made = []

    def build():
        made.append(session.materialize(spark.range(len(made) + 1)))
        return made[-1]

    spark.range(5).write.parquet(f"{tmp_path}/t.parquet")
    with session.stage():
        first = session.once(spark, str(tmp_path), "t", "x", build)
    assert session.once(spark, str(tmp_path), "t", "x", build) is first and first.count() == 1  # it outlives the stage
    spark.range(9).write.mode("overwrite").parquet(f"{tmp_path}/t.parquet")
    assert session.once(spark, str(tmp_path), "t", "x", build).count() == 2
    assert session.once(spark, str(tmp_path), "t", "y", build).count() == 3
