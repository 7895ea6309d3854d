import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))

from quarry.runtime import session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    made = session("quarry-tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.sql.adaptive.coalescePartitions.enabled": "true"})
    made.sparkContext.setLogLevel("ERROR")
    ship(made)
    yield made
    made.stop()


NODE_SCHEMA = (
    "id long, kind string, name string, repo string, file_path string, start_line int, end_line int, signature string, skeleton string, full_body string, docstring string, "
    "language string, enclosing_scope string, symbol_kind string, token_count_skeleton int, token_count_full int"
)


@pytest.fixture
def make_nodes(spark):
    """Nodes from dictionaries; missing columns are null."""
    names = [x.split()[0] for x in NODE_SCHEMA.split(", ")]

    def make(rows):
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], NODE_SCHEMA)

    return make
