"""Every registered query of the library against its SQL on the smallest tables."""

import collections
import importlib.util
import os

import duckdb
import pytest

from tapal.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


def plain(v):
    return str(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return connection


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, oracle, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = collections.Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got
    if name in registry.ORACLES:
        found = oracle.execute(registry.ORACLES[name])
        names = [x[0] for x in found.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == collections.Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_imports_nothing_of_llm():
    """Nothing outside the subpackage needs it."""
    root = os.path.dirname(importlib.util.find_spec("tapal").origin)
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "tapal.llm" not in open(os.path.join(folder, f)).read().replace("outside tapal.llm", "")


def test_all_branches_occur(spark):
    """The derived inputs reach every class of the decision tables."""
    rows = registry.QUERIES["merged_decisions"](spark, SF).groupBy("decision").count().collect()
    assert {r.decision for r in rows} >= {"agree", "conflict_api_supports_diskominfo", "conflict_api_supports_odj", "conflict_api_third_value", "conflict_api_vs_odj"}
    assert {r.gate_status for r in registry.QUERIES["gate_status_counts"](spark, SF).collect()} == {"SIAP_DIPROSES", "PERLU_KONFIRMASI", "TIDAK_VALID"}
