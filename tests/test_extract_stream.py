"""Streaming extraction: a run that breaks off is completed, and each chunk asked once."""

import json

import pytest
from pyspark.sql import functions as F

from siltstone.operators import extraction
from siltstone.sources import readers
from siltstone.streaming.extract import extract_stream

FORM = f"chunk_id string, doc_id string, text string, doc_metadata struct<{readers.META.replace(' ', ':').replace(',:', ', ')}>, source_path string"


def write(folder, name, ids):
    (folder / name).write_text("\n".join(json.dumps({"chunk_id": f"c{k}", "doc_id": "d", "text": f"t{k}", "source_path": "p"}) for k in ids))


def test_kill_and_resume(spark, tmp_path, monkeypatch):
    source = tmp_path / "in"
    source.mkdir()
    calls = spark.sparkContext.accumulator(0)

    def model(prompt):
        calls.add(1)
        return "broken" if prompt.endswith("t3") else json.dumps({"entities": {}, "relationships": [], "doc_summary": prompt[-4:]})

    def run():
        stream = spark.readStream.schema(FORM).json(str(source))
        query = extract_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"), model, parts=4)
        query.awaitTermination()

    write(source, "a.json", [*range(20), 5, 6])  # repeated chunks
    real, asked = extraction.asked, []

    def dies(chunks, *rest):
        asked.append(1)
        if len(asked) == 3:
            raise RuntimeError("killed")
        return real(chunks, *rest)

    monkeypatch.setattr(extraction, "asked", dies)
    with pytest.raises(Exception, match="killed"):
        run()
    before = calls.value
    assert 0 < before < 20
    monkeypatch.setattr(extraction, "asked", real)
    run()
    records = spark.read.parquet(str(tmp_path / "out/records"))
    assert calls.value == 20 and records.count() == records.select("chunk_id").distinct().count() == 20
    write(source, "b.json", [*range(15, 25)])
    run()
    run()
    records = spark.read.parquet(str(tmp_path / "out/records"))
    assert calls.value == 25 and records.count() == 25 and records.filter("error is not null").count() == 1


def test_prompts_are_made_one_at_a_time(spark, monkeypatch):
    """A task holds no strings of a batch's prompts; what they begin with is not in its rows."""
    import tracemalloc

    import pyarrow as pa

    held, frame = {}, type(spark.range(1))
    monkeypatch.setattr(frame, "mapInPandas", lambda self, run, _: held.update(run=run, rows=self, pandas=True))
    monkeypatch.setattr(frame, "mapInArrow", lambda self, run, _: held.update(run=run, rows=self, pandas=False))
    meta = F.from_json(F.lit(None).cast("string"), readers.META).alias("doc_metadata")
    chunks = spark.range(300).select(F.col("id").cast("string").alias("chunk_id"), F.repeat(F.lit("x"), 10_000).alias("text"), meta)
    seen = []
    extraction.asked(chunks, lambda p: seen.append((len(p), p.startswith(extraction.schema_prompt()))) or "a")
    rows = held["rows"].collect()
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows]) for k in (0, 1)], held["rows"].columns)
    tracemalloc.start()
    out = list(held["run"](iter([batch.to_pandas() if held["pandas"] else batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(seen) == 300 and len(set(seen)) == 1 and seen[0][1] and len(out[0]["answer"]) == 300
    assert seen[0][0] > len(rows[0][1]) + 100 and peak < 1_500_000
