"""Near vectors against all pairs."""
import math

import numpy as np
from pyspark.sql import types as T

from logweir.llm import embedding_dups

VECTOR = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("label", T.IntegerType()), T.StructField("class", T.StringType())])


def brute(rows):
    good = [(k, np.array(e, float)) for k, (_, e, l, _) in enumerate(rows)
            if e is not None and l is not None and None not in e and np.isfinite(np.array(e, float)).all() and np.any(e)]
    links = {k: set() for k in range(len(rows))}
    for x, a in good:
        for y, b in good:
            if x != y and rows[x][2] == rows[y][2] and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                links[x].add(y)
    out = []
    for k in links:
        seen, todo = {k}, [k]
        while todo:
            for y in links[todo.pop()] - seen:
                seen.add(y), todo.append(y)
        least = min(rows[y][0] for y in seen)
        out.append((rows[k][0], len(links[k]), least, rows[k][0] == least))
    return sorted(out)


def test_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = []
    for group in range(20):
        centre = rng.normal(size=32)
        for _ in range(6):
            own = centre + rng.normal(size=32) * rng.choice([0.02, 0.08, 0.13, 0.3])
            rows.append((len(rows), [float(np.float32(x)) for x in own], int(group % 3), "c"))
    rows += [(200, rows[0][1], rows[0][2], "c"), (201, rows[0][1], 2, "c"), (202, None, 1, "c"), (203, [], 1, "c"), (204, [0.0] * 32, 1, "c"),
             (205, [math.nan] * 32, 1, "c"), (206, [1.0, None], 1, "c"), (207, rows[0][1], None, "c"), (208, [math.inf] + [0.0] * 31, 1, "c")]
    found = sorted(map(tuple, embedding_dups.near_vectors(spark.createDataFrame(rows, VECTOR)).collect()))
    assert found == brute(rows)
    assert embedding_dups.near_vectors(spark.createDataFrame([], VECTOR)).count() == 0


def test_calibration_grows_slowly():
    sizes = [embedding_dups.calibrate(n) for n in (10, 10 ** 4, 10 ** 8)]
    assert sizes == sorted(sizes) and sizes[-1][1] < 300
