"""Candidate pairs of the Jaccard join: a region that cannot be the first one shared does not give a pair again."""
from pyspark.sql import functions as F

from panelspark.llm import jaccard_join as J


def test_late_regions_do_not_repeat_pairs(spark):
    rows = [(1, rid, 100, 0, rid) for rid in (1, 2)] + [(2, rid, 100, 15, rid) for rid in (1, 3)] + [(3, rid, 100, 11, rid) for rid in (4, 5)]
    cells = spark.createDataFrame(rows, "region long, rid long, n long, pos int, comp long").withColumns(
        {"far": F.lit(float("nan")), "classes": F.lit(bytes(J.CLASSES // 2)), "block": F.lit(0), "left_block": F.lit(0), "right_block": F.lit(0)})
    # 100 * 89 >= 80 * (200 - 89) still links from place 11 on, 85 shingles from place 15 on do not
    assert {tuple(r) for r in J.window_pairs(cells, 80).collect()} == {(1, 2), (4, 5)}
