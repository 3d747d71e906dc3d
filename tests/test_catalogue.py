import json
import os
import subprocess
import sys

import pytest
from check_oracle import connect, differences

from __spark_entry__ import entry, oracle_sql, queries
from condeval.plans.catalogue import QUERIES
from condeval.plans.oracle import ORACLE

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_its_statement():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_its_statement(spark, con, name):
    assert differences(QUERIES[name](spark, FOLDER), con, ORACLE[name]) == []


def test_entry(spark):
    assert entry(spark).count() == 11


def test_bench_prints_one_line():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {**os.environ, "BENCH_SF_DIR": FOLDER, "BENCH_CPUS": "2"}
    done = subprocess.run(
        [sys.executable, "bench.py", "q09", "q29"], cwd=root, env=env, capture_output=True, text=True, timeout=300
    )
    line = json.loads(done.stdout.strip().splitlines()[-1])
    assert line["unit"] == "sec" and set(line["queries"]) == {"q09_rates_by_step", "q29_categories"}
