import os

import pytest


@pytest.fixture(scope="session")
def lspark(spark):
    """A session to whose workers the package has been sent."""
    from mooreflow.session import ship

    return ship(spark)


@pytest.fixture
def table(lspark, tmp_path):
    """Writes (doc_id, text) rows, with extra columns that clash with internal names, to a file and reads it."""
    count = 0

    def make(rows, parts=3, extra=True):
        nonlocal count
        count += 1
        df = lspark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
        if extra:
            for name in ("row", "h", "n", "key", "kept", "comp", "line", "dropped", "whole", "level", "name", "part", "chunk", "row id"):
                df = df.selectExpr("*", f"'x' as `{name}`")
        path = str(tmp_path / f"t{count}")
        df.repartition(parts, "doc_id").write.parquet(path)
        return lspark.read.parquet(path)

    return make


@pytest.fixture(scope="session")
def data():
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    return d
