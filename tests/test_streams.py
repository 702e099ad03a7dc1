"""State over many runs: totals, flat reads, and a run that was cut off."""

import collections
import random

from peakloom.streaming import state
from test_units import rows


def test_history_over_many_runs(spark, tmp_path):
    rnd, uses = random.Random(2), collections.Counter()
    arrived, out, saved = (str(tmp_path / n) for n in ("arrived", "out", "saved"))
    read = []
    for run in range(20):
        new = [(rnd.choice("ABCDEFG"),) for _ in range(rnd.randrange(1, 9))]
        uses.update(p for p, in new)
        spark.createDataFrame(new, "peptide string").coalesce(1).write.mode("append").parquet(arrived)
        stream = state.stream_peptide_history(spark.readStream.schema("peptide string").parquet(arrived))
        got = state.run_update(stream, spark, out, saved, ["peptide"], "uses")
        assert rows(got.select("peptide", "uses")) == sorted(uses.items())
        read.append(state.newer_folders(spark, out)[0])
    assert all(len(f) == 1 and "/snapshot=" in f[0] for f in read) and len(list((tmp_path / "out").glob("*=*"))) == 1
    # a run without new rows changes nothing
    assert rows(state.run_update(stream, spark, out, saved, ["peptide"], "uses").select("peptide", "uses")) == sorted(uses.items())


def test_a_snapshot_that_is_not_complete(spark, tmp_path):
    out = str(tmp_path / "out")
    schema = spark.createDataFrame([("a", 1)], "peptide string, uses long")
    for number, n in ((0, 1), (1, 2)):
        spark.createDataFrame([("a", n), (f"b{number}", 1)], schema.schema).write.parquet(f"{out}/batch={number}")
    (tmp_path / "out" / "snapshot=1").mkdir()  # cut off before it was complete
    want = [("a", 2), ("b0", 1), ("b1", 1)]
    assert rows(state.latest_rows(spark, out, schema.schema, ["peptide"], "uses")) == want
    state.compact(spark, out, schema.schema, ["peptide"], "uses")
    assert rows(state.latest_rows(spark, out, schema.schema, ["peptide"], "uses")) == want
    assert [p.name for p in (tmp_path / "out").glob("*=*")] == ["snapshot=1"]
    # nothing has arrived yet
    assert state.latest_rows(spark, str(tmp_path / "none"), schema.schema, ["peptide"], "uses").count() == 0
