"""The edit-distance join against all pairs."""

import random

import pytest

from peakloom.operators import peptide as pep
from test_units import edit, rows


@pytest.mark.parametrize("within, spare, index", [(1, 0, "target"), (1, 1, "query"), (2, 1, "query"), (2.5, 0, "target"), (3, 1, "query")])
def test_no_pair_is_lost(spark, within, spare, index):
    rnd = random.Random(int(within * 10))
    texts = ["".join(rnd.choice("ANDIKLQFmG") for _ in range(rnd.randrange(1, 12))) for _ in range(60)]
    for t in list(texts[:40]):
        for _ in range(rnd.randrange(0, 4)):
            at = rnd.randrange(len(t) + 1)
            t = rnd.choice([t[:at] + t[at + 1 :], t[:at] + rnd.choice("ANDG") + t[at:], t[:at] + rnd.choice("ANDG") + t[at + 1 :]])
        texts.append(t)
    rnd.shuffle(texts)
    queries, database = texts[:50] + texts[:5], texts[50:]
    q = spark.createDataFrame([(t, 1) for t in queries + [None, ""]], "query string, key int")
    d = spark.createDataFrame([(t, 1) for t in database + [None, ""]], "target string, key int")
    want = sorted((a, b, edit(a, b)) for a in set(queries) - {""} for b in set(database) - {""} if edit(a, b) <= within)
    assert len(want) > 5 and rows(pep.edit_distance_pairs(q, d, within, spare, index)) == want
    assert pep.edit_distance_pairs(q.limit(0), d, within).count() == 0


def test_a_segment_that_all_texts_share(spark):
    """All texts hold one part at one place: with a spare part they do not all meet."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("ACDEGHPSTVWY") for _ in range(6))
    queries, targets = (["GGGGGG" + word() + word() for _ in range(400)] for _ in range(2))
    targets += [q[:12] + "A" + q[13:] for q in queries[:20]]
    q, d = spark.createDataFrame([(t,) for t in queries], "query string"), spark.createDataFrame([(t,) for t in targets], "target string")
    want = sorted((a, b, edit(a, b)) for a in set(queries) for b in set(targets) if edit(a, b) <= 2)
    assert rows(pep.edit_distance_pairs(q, d, 2)) == want

    def met(spare):
        parts = 3 + spare
        keyed = lambda df, c, index: df.select(c, pep.F.explode(pep._segment_keys(pep.F.col(c), parts, spare + 1, 2, index)).alias("key"))
        return keyed(q, "query", False).join(keyed(d, "target", True), "key").count()

    assert met(0) > len(set(queries)) * 400 and met(1) < met(0) / 20
