"""Intake queries against brute force."""

from collections import Counter

from docfiling.plans import queries


def brute_decisions(spark, sf_dir):
    last = {}
    for user, second, event in spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id", "unix_timestamp(ts)", "event_id").collect():
        at = f"doc-{user}.pdf", second // 3600
        last[at] = max(event, last.get(at, event))
    keys = {f"{path}#{scan}": (path, event // 300) for (path, scan), event in last.items()}
    case = {key: (int(key.rsplit("#", 1)[1]) * 7 + modified) % 6 for key, (_, modified) in keys.items()}
    old = {path for key, (path, _) in keys.items() if case[key] == 4}
    found = {}
    for key, (path, modified) in keys.items():
        n = case[key]
        if n < 2:
            found[key] = ("mine_" if n == 0 else "other_") + ("done" if modified % 2 == 0 else "claimed")
        elif n == 2:
            found[key] = "claim"
        elif n == 3 or path in old:
            found[key] = "claim" if 130 - modified >= 120 else "hold"
        else:
            found[key] = "claim_new_local"
    return found


def test_decisions(spark, sf_dir):
    got = [tuple(r) for r in queries.queries()["j14_decisions"](spark, sf_dir).select("key", "decision").collect()]
    assert sorted(got) == sorted(brute_decisions(spark, sf_dir).items())


def test_status(spark, sf_dir):
    n = Counter(brute_decisions(spark, sf_dir).values())
    (got,) = queries.queries()["a10_status"](spark, sf_dir).select("held_for_others", "claimed_by_others", "processed_here", "machines").collect()
    assert tuple(got) == (n["hold"], n["other_claimed"], n["mine_done"], "m0,m1,m2")
