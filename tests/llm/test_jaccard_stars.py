"""Nodes of a key meet in one hub, without a join of the key's rows."""

import random

from squall.llm import jaccard_join as J


def test_stars_have_a_row_a_node_and_no_join(spark):
    r = random.Random(3)
    rows = [(k, n, r.choice([J.POSTED, J.POSTED, J.PROBES, J.SUBSETS])) for k in range(60) for n in r.sample(range(40), r.randrange(1, 12))] + [(99, n, J.SUBSETS) for n in range(500)]
    stars = J._stars(spark.createDataFrame(rows, "key long, node long, kind int"))
    want = []
    for key in {k for k, _, _ in rows}:
        own = [(n, kind) for k, n, kind in rows if k == key]
        hubs = [n for n, kind in own if kind >= J.PROBES]
        want += [(n, min(hubs)) for n, _ in own if hubs and n != min(hubs)]
    assert sorted(map(tuple, stars.collect())) == sorted(want)
    assert "Join" not in stars._jdf.queryExecution().optimizedPlan().toString()
