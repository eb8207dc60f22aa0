import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMOKE = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from sheaf.session import local_session, shared_dir
    s = local_session(cpus="*", shuffle_partitions=8, app="sheaf-tests")
    shared_dir(s)
    yield s
    s.stop()


def column_values(spark, values, fn, *extra_cols):
    """Apply a Column function to a one-column DataFrame of strings; return the results in order."""
    from pyspark.sql import functions as F
    rows = [(i, v) + tuple(e[i] for e in extra_cols) for i, v in enumerate(values)]
    names = ["i", "v"] + [f"x{j}" for j in range(len(extra_cols))]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n == 'i' else 'string'}" for n in names))
    out = df.select("i", fn(*[F.col(n) for n in names[1:]]).alias("r")).orderBy("i").collect()
    return [r.r for r in out]
