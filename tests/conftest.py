import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from arborweave.session import local_session

    where = tmp_path_factory.mktemp("shared")
    return local_session("4", driver_memory="4g", **{"spark.checkpoint.dir": f"file://{where}", "spark.sql.shuffle.partitions": "4"})


def rows(df):
    """The rows of a DataFrame as sorted tuples; nulls sort first."""
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((x is not None, str(x)) for x in t))
