import os
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master(os.environ.get("TEST_MASTER", "local[4]")).config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def compare(spark, data):
    """Run a query and its SQL, and compare columns and rows (as multisets)."""
    import duckdb

    def canon(v):
        if isinstance(v, float):
            return round(v, 9)
        return tuple(map(canon, v)) if isinstance(v, (list, tuple)) else v

    def run(query, sql):
        db = duckdb.connect()
        db.execute("SET TimeZone = 'UTC'")
        for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet{'/*.parquet' if os.path.isdir(f'{data}/{t}.parquet') else ''}'")
        want = db.execute(sql)
        names = [c[0] for c in want.description]
        want = want.fetchall()
        df = query(spark, data)
        assert sorted(df.columns) == sorted(names)
        got = [tuple(canon(r[c]) for c in sorted(names)) for r in df.collect()]
        order = sorted(range(len(names)), key=lambda i: names[i])
        want = [tuple(canon(r[i]) for i in order) for r in want]
        key = lambda r: tuple((x is None, str(x)) for x in r)
        got, want = sorted(got, key=key), sorted(want, key=key)
        assert want, "the SQL found nothing to compare"
        assert got == want
        return got

    return run
