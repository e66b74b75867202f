import pytest

from pyspark.sql import types as T

CFG = T.StructType([T.StructField("name", T.LongType()), T.StructField("doc", T.StringType()),
                    # names that the operators use inside, as clashing extra columns
                    T.StructField("key", T.StringType()), T.StructField("text", T.StringType())])


@pytest.fixture(scope="session")
def cfgs(spark):
    """Configuration documents by name: ``cfgs([(name, doc), ...])``, with extra columns."""
    return lambda rows: spark.createDataFrame([(n, d, "x", None) for n, d in rows], CFG)
