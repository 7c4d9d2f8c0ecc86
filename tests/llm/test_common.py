"""Where intermediate tables go, and lookups of hot keys."""

import pytest

from schemasight.llm import common


class Session:
    """A session whose settings hold ``path`` or nothing."""

    def __init__(self, path, master="local[1]"):
        self.path, self.master = path, master
        self.conf = self.sparkContext = self
        self.applicationId = "app"

    def get(self, key, default):
        return self.path or default


def test_shared_dir_is_the_session_s_and_else_one_of_its_own():
    assert common.shared_dir(Session("hdfs://x/y")) == "hdfs://x/y"
    own = common.shared_dir(Session(None))
    assert own.startswith("file:///") and own == common.shared_dir(Session(None))


@pytest.mark.parametrize("master", ["spark://x:7077", "local-cluster[2,1,1024]", "yarn"])
def test_a_cluster_without_a_shared_folder_is_an_error(master):
    assert common.shared_dir(Session("hdfs://x/y", master)) == "hdfs://x/y"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session(None, master))


def test_lookup_deals_hot_keys(spark):
    left = spark.range(40_000).selectExpr("id", "case when id % 3 = 0 then 7 when id % 1000 = 1 then null else id end as k")
    right = spark.range(0, 40_000, 7).selectExpr("id as k", "id * 2 as twice", "'x' as _salt")
    got = common.salted_lookup(left, right, "k").select("id", "k", "twice")
    want = left.join(right, "k", "left").select("id", "k", "twice")
    assert got.count() == 40_000 and got.exceptAll(want).isEmpty() and got.where("k = 7 and twice = 14").count() == 13_335


def test_settled_tables_keep_rows_and_can_be_discarded(spark):
    df = common.settle(spark.range(10).selectExpr("id", "cast(null as string) as s"))
    assert df.count() == 10 and df.columns == ["id", "s"]
    common.discard(df)
    assert common.settle(spark.range(0)).count() == 0
