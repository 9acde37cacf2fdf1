import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["TZ"] = "UTC"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


NODE_DDL = (
    "id string, kind string, name string, file_path string, start_line int, end_line int, language string, content string, content_hash string, "
    "signature string, description string, owner string, parameter_count int, return_type string, is_exported boolean, cyclomatic_complexity int, "
    "repo_uri string, indexed_at timestamp_ntz, removed_at timestamp_ntz"
)
EDGE_DDL = "id string, src string, dst string, type string, confidence double, step int, reason string, repo_uri string, indexed_at timestamp_ntz, loaded_at timestamp_ntz"


@pytest.fixture(scope="session")
def make(spark):
    """Builds a table from partial rows: ``make('nodes', [{...}])``; missing columns are null."""

    def build(what, rows, extra=""):
        ddl = {"nodes": NODE_DDL, "edges": EDGE_DDL}.get(what, what) + (f", {extra}" if extra else "")
        from pyspark.sql.types import StructType

        schema = StructType.fromDDL(ddl)
        return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)

    return build
