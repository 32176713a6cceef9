import datetime as dt
import math
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelforge.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


PANEL_SCHEMA = (
    "period date, respondent string, demand double, demand_forecast double,"
    " net_generation double, interchange double"
)


def day(n: int) -> dt.date:
    return dt.date(2023, 11, 1) + dt.timedelta(n)


def wave(n: int, base: float) -> float:
    return round(base + 0.2 * base * math.sin(n / 3.0) + (n * 37 % 11) * base / 50, 1)


def panel_rows(entities: dict[str, float], days: int, skip=()):
    """One row per entity and day; ``skip`` holds (entity, day number) pairs to leave out."""
    return [
        (day(n), e, wave(n, base), wave(n, base) * 1.03, wave(n + 1, base) * 0.9, wave(n, 10.0) - 11.0)
        for e, base in entities.items()
        for n in range(days)
        if (e, n) not in skip
    ]


@pytest.fixture(scope="session")
def tier_map():
    return {"Large": ["AA", "AB"], "Medium": ["BA"], "Small": ["CA"]}


@pytest.fixture(scope="session")
def small_panel(spark):
    rows = panel_rows({"AA": 9000.0, "AB": 7000.0, "BA": 900.0, "CA": 90.0, "ZZ": 5.0}, 90, {("BA", 20), ("BA", 21), ("CA", 40)})
    return spark.createDataFrame(rows, PANEL_SCHEMA)
