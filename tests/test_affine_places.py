"""The general affine transform asks for its places once, however many volumes there are."""

import numpy as np
from pyspark.sql import functions as F

from lamella.functions import matrix as mx
from lamella.operators import resample as rs


def test_places_are_joined_without_volumes(spark):
    """Equal volumes give equal results, and the weights are joined by place alone."""
    one = spark.range(60).select(F.lit(0).cast("long").alias("t"), F.lit(1).cast("long").alias("c"), F.expr("id div 20").alias("z"), F.expr("id div 5 % 4").alias("y"), (F.col("id") % 5).alias("x"), (F.col("id") * 31 % 97 + 1).alias("v"))
    several = one.crossJoin(spark.range(3).toDF("k")).withColumn("t", F.col("k")).drop("k")
    m = mx.product([mx.rotate("z", 12.0), mx.rotate("x", 20.0), mx.scale(1.0, 1.0, 1.3)])
    out = rs.affine(several, m, (5, 4, 3))
    rows = {k: sorted((r.z, r.y, r.x, r.v) for r in out.filter(F.col("t") == k).collect()) for k in range(3)}
    _, size = rs.bounding(m, (5, 4, 3))
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == int(np.prod(size)) and max(r[3] for r in rows[0]) > 0
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner, " in line]
    assert joins and all("t#" not in line and "c#" not in line for line in joins)
