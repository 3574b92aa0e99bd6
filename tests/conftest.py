import pytest

from scholia import plans
from scholia.session import local_session

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    plans.load()
    session = local_session(app="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def con():
    from tests.checking import connect

    return connect(FOLDER)


@pytest.fixture
def docs(spark):
    def make(*texts):
        rows = list(enumerate(texts, 1))
        return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)

    return make
