"""Every query against its oracle at the smallest scale."""

import os

import duckdb
import pytest

from tests.conftest import SF
from webgauge.plans import registry


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


#: Queries with a parser, an automaton, user code or blocks of hashes, which columns can't express.
PYTHON = {"u19_p26_visible_text", "u13_ascii_hosts", "r3_robots_automaton", "e1_p26_user_checks", "r8_sitemap_xml", "r8_sitemap_xml_problems"} | {"d5_j12_near_pairs", "a1_content_audit", "d2_d5_p22_content_issues", "a1_content_report", "p21_u19_thin_pages", "d3_u19_page_copies"}


def declarative(name, df):
    """No Cartesian products, and Python only where it's needed."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan, name
    assert name in PYTHON or "Python" not in plan and "InArrow" not in plan, name


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    declarative(name, df)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    if name in registry.ORACLES:
        cur = con.execute(registry.ORACLES[name])
        names = [x[0] for x in cur.description]
        assert sorted(names) == cols
        assert got == sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in cur.fetchall())
