import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessitura.session import get_spark, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", 4, **{"spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "4", "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    ship_package(s)
    yield s


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


CLASHING = "_task _shard _n _key _w0 _block _maybe _first part n rank seg_id t k e lo hi block shard n_tokens id v unit group label confirmed cause key at size bin position source leftid score".split()


def clash(df):
    """The table with further columns that have names the operators might use inside."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in CLASHING if c not in df.columns})
