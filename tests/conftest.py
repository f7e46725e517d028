import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from surveyq.plans import analytics, corpus, documents, more, records  # noqa: E402, F401  they register their queries

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from surveyq.session import local_session

    os.environ.setdefault("SURVEYQ_DRIVER_MEMORY", "4g")
    where = tmp_path_factory.mktemp("spark")
    session = local_session(4, "tests", **{"spark.sql.warehouse.dir": str(where / "warehouse"), "spark.checkpoint.dir": f"file://{where}/checkpoint"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return f"{DATA}/sf0.001"
