import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from tillsight.session import get_spark
    ckpt = tempfile.mkdtemp(prefix="tillsight-test-ckpt-")
    s = get_spark("local[4]", shuffle_partitions=8, extra={"spark.checkpoint.dir": ckpt,
                                                            "spark.driver.memory": "6g"})
    yield s
    s.stop()
