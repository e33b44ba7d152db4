import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from skeinframe.session import session

    spark = session(4, spark__checkpoint__dir="file://" + tempfile.mkdtemp(), spark__driver__memory="4g")
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
