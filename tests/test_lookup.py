"""Point reads of many keys: matches are found on ids and urls, whole rows are joined once."""

from __future__ import annotations

import pytest

from linkloom.operators import listing, skew
from linkloom.plans import enrich
from tests.helpers import T0, by, table


def stored(spark):
    rows = table(spark, *[{"url": f"https://e.org/{i}", "summary": "long " * i} for i in range(6)])
    ids = {r.url: r.id for r in rows.collect()}
    # One row has the id of another as its url, which the id match hides.
    return rows.unionByName(table(spark, {"url": ids["https://e.org/1"], "id": "odd"})), ids


@pytest.mark.parametrize("few_keys", [1000, 0])
def test_lookup_joins_whole_rows_once(spark, monkeypatch, few_keys):
    monkeypatch.setattr(skew, "FEW_KEYS", few_keys)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, ids = stored(spark)
        keys = [ids["https://e.org/1"], "https://e.org/1", "https://e.org/2", "none", "none", None]
        found = listing.lookup(rows, spark.createDataFrame([(k,) for k in keys], "key string"))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join Inner") == 1 and "LeftSemi" not in plan
        got = sorted(((r.key, r.id, r.url) for r in found.collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    one, two = ids["https://e.org/1"], ids["https://e.org/2"]
    want = [(one, one, "https://e.org/1"), ("https://e.org/1", one, "https://e.org/1"), ("https://e.org/2", two, "https://e.org/2")]
    assert got == sorted([*want, ("none", None, None), (None, None, None)], key=str)


def test_reset_needs_no_join(spark):
    rows, _ = stored(spark)
    done = enrich.reset(rows, T0)
    assert "Join" not in done._jdf.queryExecution().optimizedPlan().toString()
    assert {r["summary"] for r in by(done).values()} == {""} and {r["scrape_status"] for r in by(done).values()} == {"pending"}
