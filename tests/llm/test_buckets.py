"""Large buckets against all their pairs."""

import numpy as np
from pyspark.sql import functions as F

from barloom.llm import buckets


def test_a_large_bucket_is_compared_in_cells_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(buckets, "BLOCK", 20)
    monkeypatch.setattr(buckets, "PARTNERS", 7)
    rng = np.random.default_rng(3)
    sketch = rng.integers(0, 16, (300, 2))
    comp = rng.integers(0, 150, 300)
    rows = [(1 if i < 290 else 2, i, int(comp[i]), 5, sketch[i].tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "key long, node long, comp long, size long, sketch array<long>")
    cells = buckets._cells(df).repartition(3, "key").sortWithinPartitions("key")
    assert cells.groupBy("key").count().agg(F.max("count")).first()[0] <= 4 * 20
    found = [tuple(r) for r in cells.mapInArrow(buckets._cross(lambda a, b: 0 * (a + b) + 1), "a long, b long").collect()]
    far = np.bitwise_count(sketch[:, None] ^ sketch).sum(2)
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if far[i, j] <= 1 and comp[i] != comp[j] and (i < 290) == (j < 290)}
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 1000
