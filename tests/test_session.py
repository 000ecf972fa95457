"""Shared folder rules: where intermediate tables go, and that they go away."""

import os

import pytest

from activity_engine import session
from activity_engine.operators import features as FE
from activity_engine.sources.fixtures import activity
from tests.conftest import SMALL


@pytest.mark.parametrize("master", ["local", "local[8]", "local[*]", "local[4, 2]"])
def test_local_masters_may_use_a_scratch_folder(master):
    session.require_local(master)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://https://host", "local-cluster[3,2,1024]"])
def test_other_masters_need_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.require_local(master)


def folders(spark):
    base = session.checkpoint_dir(spark).removeprefix("file:")
    return sum(len(d) for _, d, _ in os.walk(base))


def test_a_second_training_set_leaves_no_more_folders(spark):
    FE.training_set(activity(spark, SMALL)).count()
    session.drop_intermediates(spark)
    before = folders(spark)
    FE.training_set(activity(spark, SMALL)).count()
    assert folders(spark) > before and session.drop_intermediates(spark) == 1
    assert folders(spark) == before


def test_scratch_tables_are_deleted_but_for_the_result(spark):
    with session.Scratch(spark, "scratch_test") as s:
        a = s.table(spark.range(5).toDF("x"), "a")
        out = s.keep(a.selectExpr("x + 1 AS y"), "out")
        root = s.root.removeprefix("file:")
    assert sorted(os.listdir(root)) == ["out"] and out.count() == 5


def test_scratch_destroys_its_broadcasts(spark):
    import os

    from activity_engine.session import Scratch

    with Scratch(spark, "owned") as scratch:
        held = scratch.own(spark.sparkContext.broadcast(list(range(1000))))
        assert os.path.exists(held._path)
    assert not os.path.exists(held._path)
