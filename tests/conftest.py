import os
import sys
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from claimscope.session import get_spark
    s = get_spark("local[*]", 8, app="claimscope-tests")
    yield s


def D(x):
    return None if x is None else Decimal(x)


# The hand-checkable micro fixture: 12 payment rows.
MICRO_ROWS = [
    ("B1", "S1", "T1019", "2018-01", 10, 20, D("100.00"), "NY"),
    ("B1", "S2", "T1019", "2018-02", 5, 9, D("250.50"), "NY"),
    ("B1", "S1", "99213", "2018-02", 3, 3, D("75.25"), "NY"),
    ("B2", "S2", "T1019", "2018-01", 8, 8, D("350.50"), "CA"),
    ("B2", "S3", "99213", "2018-03", 2, 2, D("0.05"), "CA"),
    ("B3", "S3", "t1019", "2018-03", 1, 1, D("9.99"), "SCX"),
    ("B3", "S3", "D0120", "2018-03", 4, 4, D("0.00"), "SCX"),
    ("B3", "S1", "D0120", "2018-01", 4, 6, D("-20.00"), "SCX"),
    (None, "S9", "20", "2018-01", 1, 1, D("2000000000000.00"), None),
    ("B4", "S4", None, "2018-02", 6, 7, D("1000.00"), None),
    ("B4", "S4", "W1793", "2018-02", 6, 7, None, None),
    ("B4", "S4", "90834", None, 2, 2, D("100000000.00"), None),
]


@pytest.fixture(scope="session")
def micro(spark):
    from claimscope.schema import SPENDING
    return spark.createDataFrame(MICRO_ROWS, SPENDING)


@pytest.fixture(scope="session")
def micro_lookup(spark):
    rows = [("B1", "Alpha Clinic", "NY"), ("B2", "Beta Care", "CA"), ("B3", "Gamma Health", "SCX"),
            ("B4", "Delta Group", "TX"), ("S1", "Sam One", "NY"), ("S2", "Sue Two", "NY")]
    return spark.createDataFrame(rows, "npi string, name string, state string")


@pytest.fixture(scope="session")
def micro_descs(spark):
    return spark.createDataFrame([("T1019", "Personal care"), ("D0120", "Oral evaluation")],
                                 "hcpcs string, name string")
