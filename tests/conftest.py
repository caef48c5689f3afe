import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from flowloom.operators.session import prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="flowloom-test-"))
        .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield prepare(s)
    s.stop()


@pytest.fixture
def new_dir():
    return tempfile.mkdtemp(prefix="flowloom-test-")


def packet(seq, ts, src, sport, dst, dport, flags=0, payload=0, proto=6, window=8192, head=None, offset=5):
    head = head if head is not None else (20 if proto == 6 else 8)
    return (seq, ts, src, dst, sport, dport, proto, 20 + head + payload, 20, head, payload, flags,
            window if proto == 6 else 0, offset if proto == 6 else 0)


@pytest.fixture
def make_packets(spark):
    from flowloom.operators.packets import PACKETS
    return lambda rows: spark.createDataFrame([packet(*r[0], **r[1]) if isinstance(r[0], tuple) else packet(*r) for r in rows], PACKETS)
