import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from docfathom.session import session

    folder = str(tmp_path_factory.mktemp("spark"))
    return session("tests", cores=4, **{"spark.driver.memory": "4g", "spark.sql.warehouse.dir": f"{folder}/warehouse", "spark.checkpoint.dir": f"file://{folder}/shared", "spark.sql.shuffle.partitions": "4"})
