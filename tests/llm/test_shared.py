import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkmill.llm import shared


def test_tables_are_swept(spark):
    df = shared.materialize(spark.range(5), "x")
    assert df.count() == 5
    assert shared.sweep(spark) >= 1 and shared.sweep(spark) == 0
    with pytest.raises(Exception, match="(?i)not.*exist|no such file"):
        df.count()


def test_words(spark):
    df = spark.createDataFrame([(None,), (" a\tB\x0bc d\n",), ("",)], "t string")
    assert [r[0] for r in df.select(shared.words(F.col("t"))).collect()] == [[], ["a", "B", "c d"], []]
    assert df.select(shared.ascii_lower(F.lit("AZÉ"))).first()[0] == "azÉ"


def test_regrouped():
    batches = [pa.record_batch({"x": pa.array(range(k))}) for k in (3, 0, 4, 1)]
    got = [b.num_rows for b in shared.regrouped(iter(batches), 5)]
    assert got == [7, 1]
    assert list(shared.regrouped(iter([]), 5)) == []
