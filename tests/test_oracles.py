"""Registered queries against their SQL oracles.

By default one query per group runs; ``RULELOOM_ALL_ORACLES=1`` runs every one.
"""

import os

import pytest

from ruleloom.catalog import all_oracles, all_queries
from tests.compare import compare, connect

SF_DIR = os.environ.get("RULELOOM_SF_DIR", "/root/testdata/sf0.001")
SOME = (
    "glob_match", "regex_hits", "evidence_records", "violations_normalized", "report_findings", "report_status", "config_chain", "rule_chain", "config_effective",
    "merge_exceptions", "doctor_findings", "fix_prompts_grouped", "fix_prompt_of_issue", "localized_rules", "localized_config", "audit_context",
)
NAMES = list(all_queries()) if os.environ.get("RULELOOM_ALL_ORACLES") else SOME


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, con, name):
    assert compare(spark, con, SF_DIR, name, all_queries()[name], all_oracles().get(name)) is None


def test_every_oracle_has_a_query():
    assert set(all_oracles()) <= set(all_queries())
