import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, extra=False):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        if extra:  # columns whose names clash with those that operators make
            from pyspark.sql import functions as F

            for c in ("n", "label", "key", "line", "part", "score", "token", "_gone", "_id", "_new", "_old", "_row", "_ROW", "n_removed", "bucket", "good", "word"):
                if c.lower() not in map(str.lower, df.columns):
                    df = df.withColumn(c, F.lit(1))
        return df

    return make


@pytest.fixture(scope="session")
def tokenizers():
    return pytest.importorskip("public_tokenizers")
