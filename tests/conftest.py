import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pyspark import cloudpickle

    import qaloom
    from qaloom.session import get_spark

    cloudpickle.register_pickle_by_value(qaloom)
    session = get_spark("tests", cores=4, partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
