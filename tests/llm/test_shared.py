import pytest
from pyspark.sql import functions as F

from chainlake.llm import shared


@pytest.mark.parametrize("most", [1, 50, 400, 5000])
def test_least_by_hash_equals_a_plain_sort(spark, most):
    rows = spark.range(0, 4000, 3).toDF("i").repartition(5)
    want = {r.i for r in rows.orderBy(F.xxhash64("i"), "i").limit(most).collect()}
    assert {r.i for r in shared.least_by_hash(rows, "i", most).collect()} == want
    assert shared.least_by_hash(rows.limit(0), "i", most).count() == 0
