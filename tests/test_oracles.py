"""Every registered job beside its SQL on the smallest given tables."""

import pytest

import __spark_entry__ as contract
from check import compare
from parley.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_every_job_has_an_oracle():
    assert set(QUERIES) <= set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_job(spark, name):
    outcome = compare(spark, FOLDER, name, contract.queries()[name], contract.oracle_sql()[name])
    assert outcome.startswith("ok"), outcome
