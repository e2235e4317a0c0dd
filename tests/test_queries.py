"""Every registered query against its SQL on the smallest tables, and its plan."""

from concurrent.futures import ThreadPoolExecutor

import pytest

import __spark_entry__ as entry
from check_oracles import TABLES, check, open_oracle
from conftest import SMALL

# the training-data queries have tests of their own
QUERIES = {n: q for n, q in entry.queries().items() if n not in entry.LLM_QUERIES}
SQL = {n: q for n, q in entry.oracle_sql().items() if n in QUERIES}
BANNED = ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInPandas")


@pytest.fixture(scope="module")
def outcomes(spark):
    """Run all queries, several at a time: most of the time is planning, not data."""
    con = open_oracle(SMALL)

    def run(name):
        plans = []

        def planned(session, folder):
            df = QUERIES[name](session, folder)
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return df

        try:
            _, problem = check(spark, con.cursor(), name, planned, SQL.get(name), SMALL)
        except Exception as e:  # noqa: BLE001
            return name, f"{type(e).__name__}: {e}"
        used = [b for b in BANNED if b in plans[0]]
        return name, problem or (f"plan has {used}" if used else None)

    with ThreadPoolExecutor(6) as pool:
        return dict(pool.map(run, QUERIES))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(outcomes, name):
    assert outcomes[name] is None, outcomes[name]


def test_entry_and_names(spark):
    assert entry.entry(spark).columns
    assert set(SQL) <= set(QUERIES) and len(TABLES) == 14
