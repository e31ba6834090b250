import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark():
    from quillspark.session import get_spark

    s = get_spark("4", 4, "4g")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
