"""The vector index: exact at full probe, recall at tuned probes, batches that are safe to repeat."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import ann, vector
from siltstone.sources import scratch


def frame(spark, m, first=0):
    return spark.createDataFrame([(first + k, first + k, x.tolist()) for k, x in enumerate(m)], "id long, seq long, embedding array<float>").repartition(3)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(12, 16))
    return (middles[rng.integers(0, 12, 900)] + 0.3 * rng.normal(size=(900, 16))).astype(np.float32)


def hits(df):
    return sorted((r["qid"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect())


def test_full_probe_is_exact_and_tuned_probes_reach_recall(spark, clustered, tmp_path):
    rows = frame(spark, clustered)
    index = ann.build(rows.filter("id < 600"), f"{tmp_path}/i", recall=0.95)
    assert index.add(rows, "second") == 300
    asked = rows.filter("id % 20 = 0").select(F.col("id").alias("qid"), "embedding")
    cells = len(index.centres())
    assert cells == 24 and hits(index.search(asked, 10, cells)) == hits(vector.search(rows, asked, 10))
    assert index.probes < cells
    r = index.recall(asked).agg(F.sum("found").alias("f"), F.sum("wanted").alias("w")).first()
    assert r["w"] == 450 and r["f"] >= 0.9 * r["w"]


def test_batches_replace_themselves_and_lost_ones_are_not_seen(spark, clustered, tmp_path):
    rows = frame(spark, clustered[:60])
    index = ann.build(rows.filter("id < 20"), f"{tmp_path}/i", cells=4, recall=None)
    for _ in range(2):
        assert index.add(rows.filter("id < 40"), "2") == 20 and index.ids().count() == 40
    lost = index._vectors().filter("batch = 'b_2'").withColumn("batch", F.lit("b_lost"))
    lost.write.mode("append").partitionBy("batch", "cell").parquet(f"{index.path}/vectors")
    assert index.ids().count() == 40 and index.ids().distinct().count() == 40
    assert index.add(rows.filter("id < 5"), "none") == 0 and index.ids().count() == 40


def test_a_search_reads_the_probed_cells_only(spark, clustered, tmp_path, capsys):
    index = ann.build(frame(spark, clustered), f"{tmp_path}/i", cells=10, recall=None)
    index.search(frame(spark, clustered[:1]).select(F.col("id").alias("qid"), "embedding"), 5, 2).explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [" in plan and "cell#" in plan.split("PartitionFilters: [", 1)[1].split("\n")[0] and "NestedLoop" not in plan and "Cartesian" not in plan


def test_odd_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, None), (3, 3, [0.0, 0.0]), (4, 4, [0.0, 2.0])], "id long, seq long, embedding array<float>")
    index = ann.build(rows, f"{tmp_path}/i", cells=9, recall=None)
    got = index.search(rows.filter("id in (1, 3)").dropDuplicates(["id"]).select(F.col("id").alias("qid"), "embedding"), 5, 9)
    assert [(q, i) for q, _, i, _ in hits(got)] == [(1, 1), (1, 3), (1, 4), (3, 1), (3, 3), (3, 4)]
    with pytest.raises(ValueError, match="needs vectors"):
        ann.build(rows.filter("id = 2"), f"{tmp_path}/none")


def test_many_queries_are_dealt_out(spark, clustered, monkeypatch):
    rows = frame(spark, clustered[:200])
    asked = rows.filter("id % 3 = 0").select(F.col("id").alias("qid"), "embedding")
    want = hits(vector.search(rows, asked, 7))
    monkeypatch.setattr(vector, "BROADCAST_BYTES", 0)
    assert hits(vector.search(rows, asked, 7)) == want


def test_scratch_folders(spark):
    assert scratch.folder(spark, "a") != scratch.folder(spark, "a")


def test_assigning_holds_few_scores_at_once():
    """Whatever the batch and the number of cells; ties still go to the smaller number."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    rng = np.random.default_rng(4)
    m, centres = rng.integers(-2, 3, (6000, 4)).astype(np.float64), rng.integers(-2, 3, (1500, 4)).astype(np.float64)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(m))), pa.array(list(m.astype(np.float32)))], ["id", "embedding"])
    rows = SimpleNamespace(columns=batch.schema.names, schema=[], filter=lambda _: SimpleNamespace(mapInArrow=lambda run, _: run))
    want = np.argsort(-(m @ centres.T), axis=1, kind="stable")
    for n in (1, 5):
        run = ann.assign(rows, centres, n)
        tracemalloc.start()
        got = [c for b in run(iter([batch])) for c in b.column(2).to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert got == (want[:, 0].tolist() if n == 1 else want[:, :n].tolist())
        assert peak < 60e6
