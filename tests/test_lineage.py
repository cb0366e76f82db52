import time
import uuid
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quillvec.plans import lineage

from test_entry import DATA, entry_module


def tables(spark, label):
    folder = Path("/" + lineage.shared_folder(spark).removeprefix("file:").lstrip("/"))
    return [p for p in folder.glob(f"{label}-*") if any(q.is_file() for q in p.rglob("*"))] if folder.exists() else []


def swept(spark, *labels):
    """Sweep until the tables are gone; what listeners still hold takes a moment."""
    for _ in range(30):
        lineage.sweep(collect=True)
        if not any(tables(spark, x) for x in labels):
            return True
        time.sleep(0.2)
    return False


def test_tables_go_when_no_plan_reaches_them(spark):
    run = uuid.uuid4().hex[:8]
    kept = lineage.cut(spark.range(10), f"kept{run}")
    derived = lineage.cut(spark.range(20), f"derived{run}").where("id > 3").groupBy().agg(F.sum("id").alias("s"))
    gone = lineage.cut(spark.range(30), f"gone{run}")
    counted = gone.count()
    del gone
    assert swept(spark, f"gone{run}") and tables(spark, f"kept{run}") and tables(spark, f"derived{run}")
    counted, summed = kept.count(), derived.first().s
    assert (counted, summed) == (10, sum(range(4, 20)))
    del kept, derived
    assert swept(spark, f"kept{run}", f"derived{run}")


def test_nothing_is_left_of_a_query(spark):
    module = entry_module()
    rows = module.queries()["s5_round_trip"](spark, "/root/testdata/sf0.001").count() if DATA.exists() else 0
    assert rows or not DATA.exists()
    assert swept(spark, "embeddings", "lloyd")


def test_cut_writes_once(spark):
    df = lineage.cut(spark.range(100).select(F.rand().alias("x")), "once")
    assert df.collect() == df.collect()


def session(master, folder=None):
    held = {} if folder is None else {"spark.checkpoint.dir": folder}
    return SimpleNamespace(conf=SimpleNamespace(get=held.get, set=held.__setitem__), sparkContext=SimpleNamespace(master=master))


def test_only_a_local_master_gets_a_folder_of_this_machine():
    for master in ("spark://host:7077", "yarn", "k8s://host", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            lineage.shared_folder(session(master))
        assert lineage.shared_folder(session(master, "file:///shared/")) == "file:///shared"
    assert lineage.shared_folder(session("local[2]")).startswith("file:///")


def test_shuffles_behind_a_table_go(spark):
    seen = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = spark.conf.get(lineage.FREE_SHUFFLES)
    held = seen.shuffleStatuses().size()
    df = lineage.cut(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "shuffled")
    assert seen.shuffleStatuses().size() <= held and spark.conf.get(lineage.FREE_SHUFFLES) == before
    assert df.count() == 7
