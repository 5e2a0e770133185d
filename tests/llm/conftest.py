import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
for p in (HERE, os.path.dirname(os.path.dirname(HERE))):
    if p not in sys.path:
        sys.path.insert(0, p)

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture
def make_docs(spark):
    def make(rows, extra=False):
        """rows: (doc_id, text[, lang[, source]])."""
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOC_SCHEMA)
        if extra:
            from pyspark.sql import functions as F
            for c in ("spans", "size", "kept", "score", "H", "hit", "start", "n_words", "class_id", "word", "key"):
                df = df.withColumn(c, F.lit("clash"))
        return df
    return make


@pytest.fixture
def write_tables(tmp_path):
    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)
    return write


def ordered(df, *cols):
    """Values of the columns by doc_id, null first."""
    rows = df.select("doc_id", *cols).collect()
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, str(r)))
    return [list(r)[1:] for r in rows]
