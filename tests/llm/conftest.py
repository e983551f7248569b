import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, extra=True):
        """rows of (doc_id, text, lang, source); with columns whose names clash with those used inside."""
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        full = [(i, t, l, s, None if t is None else len(t)) for i, t, l, s in rows]
        df = spark.createDataFrame(full, schema)
        if extra:
            from pyspark.sql import functions as F

            for name in ("id", "size", "mark", "component", "fp", "start", "spans", "blob", "path", "found", "copies", "_id"):
                df = df.withColumn(name, F.lit("clash"))
        return df

    return make
