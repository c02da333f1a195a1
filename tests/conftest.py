import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from strandline.session import spark_session

    s = spark_session(cpus=4, app="tests", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


DATA = "/root/testdata"


@pytest.fixture(scope="session")
def tiny():
    return f"{DATA}/sf0.001"
