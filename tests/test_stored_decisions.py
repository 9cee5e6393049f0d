"""Stored decisions where the shared folder is emptied between two queries."""
from pyspark.sql import functions as F

from fraudlens.plans import q_rules as Q
from fraudlens.session import _SCRATCH


def test_decisions_are_scored_again_when_their_table_is_gone(spark, tmpdir_path, monkeypatch):
    calls = []

    def decided(spark, sf, rs):
        calls.append(sf)
        return spark.range(5).withColumn("decision", F.lit("BLOCK"))
    monkeypatch.setattr(Q, "events_decided", decided)
    sf = f"{tmpdir_path}/tables"
    assert Q.stored_decisions(spark, sf).count() == 5
    assert Q.stored_decisions(spark, sf).count() == 5 and len(calls) == 1
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(_SCRATCH[-1])
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    assert Q.stored_decisions(spark, sf).count() == 5 and len(calls) == 2
