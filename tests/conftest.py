import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF_DIR = "/root/testdata/sf0.001"


def make_session():
    from tillmart.session import build_session

    spark = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="4", spark__default__parallelism="2", spark__driver__memory="8g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def spark():
    return make_session()


@pytest.fixture(scope="session")
def star(spark):
    from tillmart.sources.sample_tables import star

    return star(spark, SF_DIR)
