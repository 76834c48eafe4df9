"""Every registered query against its SQL twin on the smallest tables that hold what it looks for."""

import pytest
from compare import difference, duck

from voxledger.catalog import load

SMALLEST, SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
# The smallest tables hold no burst.
BURSTS = {
    "spike_windows", "spike_tickets", "ticket_sources", "ticket_samples", "ticket_numbering", "ticket_action_flag",
    "ticket_title_lookup", "title_prompts", "anomalies", "stream_spikes",
}
REGISTRY = load()


@pytest.fixture(scope="module")
def con():
    return {sf_dir: duck(sf_dir) for sf_dir in (SMALLEST, SMALL)}


def test_every_query_has_a_twin():
    assert set(REGISTRY.twins) == set(REGISTRY.queries)


@pytest.mark.parametrize("key", sorted(REGISTRY.queries))
def test_query(spark, con, key):
    sf_dir = SMALL if key in BURSTS else SMALLEST
    assert difference(REGISTRY.queries[key](spark, sf_dir), REGISTRY.twins[key], con[sf_dir]) is None
