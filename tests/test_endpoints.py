"""Trailing queries over all events have their endpoints in every event, whatever its type."""

import os

import pytest

from tidemark.plans import catalogue

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize(("name", "least"), [("w05_theil_sen_all", 2), ("j08_history_features_all", 3)])
def test_every_type_is_an_endpoint(spark, name, least):
    days, types = catalogue.DAY * 3 // 1_000_000, {}
    for r in spark.read.parquet(f"{DATA}/events.parquet").collect():
        types.setdefault(r.user_id, []).append((r.ts, r.event_id))
    want = set()
    for rows in types.values():
        for t, event in rows:
            seen = [u for u, _ in rows if 0 <= (t - u).total_seconds() <= days]
            if len(set(seen) if least == 2 else seen) >= least:
                want.add(event)
    assert {r.event_id for r in catalogue.queries()[name](spark, DATA).collect()} == want
