import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from carelane.session import session

    conf = {
        "spark__sql__shuffle__partitions": "4", "spark__ui__enabled": "false", "spark__driver__memory": "4g", "spark__ui__showConsoleProgress": "false",
        "spark__checkpoint__dir": f"file://{tmp_path_factory.mktemp('shared')}",
    }
    spark = session("local[4]", "tests", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
