from collections import Counter

import pytest

from sweepfield.llm import near


@pytest.mark.parametrize("most", [1, 3, 1 << 16])
def test_counts_of_shared_shingles(spark, monkeypatch, most):
    monkeypatch.setattr(near, "MOST_HEAVY", most)
    rows = [(node, 9, h) for node in range(12) for h in (-5, 100 + node, 7 if node < 6 else 8, -(1 << 63) if node % 4 else 40)]
    many = Counter(h for _, _, h in rows)
    got = near._counted(spark.createDataFrame(rows, "node long, n long, h long")).select("node", "n", "h", "many").collect()
    assert sorted(map(tuple, got)) == sorted((*r, many[r[2]]) for r in rows if many[r[2]] > 1)
    assert near._counted(spark.createDataFrame([(1, 1, 5)], "node long, n long, h long")).count() == 0
