import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMOKE_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    import tempfile

    from sqlstrata.session import get_spark
    # a fresh warehouse per run: managed-table folders must not outlive the
    # in-memory catalog of an earlier run
    s = get_spark("local[*]", 8, conf={"spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="sqlstrata-wh-")})
    yield s


@pytest.fixture
def corpus_of(spark):
    def make(texts):
        rows = [(i + 1, t) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "query_id bigint, sql string")
    return make
