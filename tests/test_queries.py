"""Named queries against their SQL twins in DuckDB; a few of them only with FEW_QUERIES=1."""

import datetime as dt
import decimal
import os
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest

from ladderlake.plans import catalog

DATA = Path("/root/testdata/sf0.001")
SOME = [
    "p3_found", "p4_versions", "p5_found", "p7_differences", "ranking_star_join", "alliance_power_timeline", "gap_islands", "readiness_sets", "vote_majority", "sink_get_or_create",
    "score_overall", "alliance_health", "event_power_changed", "recruitment_all", "topic_build", "assess_engine", "difference_detect", "validate_metrics", "power_sanity_rules", "dedupe_identity_power",
]
NAMES = SOME if os.environ.get("FEW_QUERIES") else sorted(catalog.oracle_sql())


def plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, dt.datetime) and v.tzinfo:
        return v.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


@pytest.fixture(scope="module")
def outcomes(spark, duck):
    """Rows by Spark and by DuckDB of every query, several at a time; an error stands in place of the rows."""
    builders, twins = catalog.queries(), catalog.oracle_sql()

    def run(name):
        try:
            df = builders[name](spark, str(DATA))
            columns = sorted(df.columns)
            got = Counter(tuple(plain(v) for v in r) for r in df.select(*columns).collect())
            cursor = duck.cursor().execute(twins[name])
            order = [c[0] for c in cursor.description]
            if sorted(order) != columns:
                return columns, sorted(order)
            return got, Counter(tuple(plain(r[order.index(c)]) for c in columns) for r in cursor.fetchall())
        except Exception as error:
            return error, None

    with ThreadPoolExecutor(6) as pool:
        return dict(zip(NAMES, pool.map(run, NAMES), strict=True))


@pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(outcomes, name):
    got, want = outcomes[name]
    assert not isinstance(got, Exception), got
    assert got == want


def test_every_query_has_a_builder_and_sql_only_for_known_names():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
