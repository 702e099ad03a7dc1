"""Proximity matches where documents follow each other in one block."""

from peakloom.llm import decontamination


def test_proximity_in_one_block(spark):
    item = [(5, "one two three four")]
    docs = [(0, "five six"), (1, "four x three two y one"), (2, "one two x x x x three four"), (3, "one two three"), (4, "one two three four"), (6, "z one two three four")]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame(item, "item_id long, text string")
    out = {r.doc_id: r for r in decontamination.contamination(df, items, slop=2).collect()}
    assert {i: r.n_hit for i, r in out.items()} == {0: 0, 1: 6, 2: 0, 3: 0, 4: 4, 6: 5}
    assert {i: r["items"] for i, r in out.items()} == {0: [], 1: ["5"], 2: [], 3: [], 4: ["5"], 6: ["5"]}
    assert all(0 <= a < b <= r.n_words for r in out.values() for a, b in zip(r["first"], r["last"]))
    assert sorted(r.doc_id for r in decontamination.keep_clean(df, items, slop=2).collect()) == [0, 2, 3]
