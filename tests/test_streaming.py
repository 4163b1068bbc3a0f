"""Each stateful stream against its batch twin, fed in files."""

import pytest
from pyspark.sql import functions as F

from docfiling import corpus
from docfiling.operators import intake as I
from docfiling.operators import lifecycle as L
from docfiling.streaming import stateful as S


def reader(spark, sf_dir):
    return lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")


def replay(spark, df, order, folder, build, mode):
    """Write df in three files by order, stream them one by one, and return all rows given out, oldest first."""
    S.use_rocksdb(spark)
    # state with a time to live would keep an availableNow run going with batches that hold no rows
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    cuts = df.approxQuantile(order, [0.33, 0.66], 0.0)
    parts = [df.filter(F.col(order) <= cuts[0]), df.filter((F.col(order) > cuts[0]) & (F.col(order) <= cuts[1])), df.filter(F.col(order) > cuts[1])]
    for k, p in enumerate(parts):
        p.coalesce(1).write.mode("append").parquet(f"{folder}/in/p{k}")
    out = []
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    q = build(stream).writeStream.outputMode(mode).foreachBatch(lambda b, n: out.append((n, b.collect()))).option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    q.awaitTermination(240)
    return [tuple(r) for _, rows in sorted(out) for r in rows]


@pytest.fixture(autouse=True)
def two_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_item_states(spark, sf_dir, tmp_path):
    events = corpus.item_events(reader(spark, sf_dir)).select("item", "seq", "event", "to_status", "ts")
    got = {}
    for item, status, illegal in replay(spark, events, "seq", tmp_path, S.item_states, "update"):
        got[item] = (status, illegal)
    assert got == {r["item"]: (r["status"], r["illegal"]) for r in L.folded_status(events).collect()}


def test_claims(spark, sf_dir, tmp_path):
    events = corpus.claim_events(reader(spark, sf_dir))
    got = {}
    for key, *state in replay(spark, events, "ts", tmp_path, S.claim_states, "update"):
        got[key] = tuple(state)
    assert got == {r["key"]: (r["owner"], r["state"], r["refused"]) for r in I.folded_claims(events).collect()}


def test_stability(spark, sf_dir, tmp_path):
    scans = corpus.scans(reader(spark, sf_dir)).filter(F.pmod(F.crc32(F.col("path").cast("binary")), F.lit(12)) == 0)  # the state costs a call for each key
    got = replay(spark, scans, "scan_no", tmp_path, S.stable_files, "append")
    assert sorted(r[1:] for r in got) == sorted((r["path"], r["scan_no"], r["size"], r["modified_secs"]) for r in I.stable(scans).filter("stable").collect())


def progress_of(spark, folder, df, order, build, batches, mode="append", empty=True):
    """Rows given out, and the number of state rows after each batch."""
    S.use_rocksdb(spark)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(empty).lower())
    for k, (low, high) in enumerate(batches):
        df.filter((F.col(order) >= low) & (F.col(order) < high)).coalesce(1).write.parquet(f"{folder}/in/p{k}")
    out = []
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    q = build(stream).writeStream.outputMode(mode).foreachBatch(lambda b, n: out.extend(map(tuple, b.collect()))).option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    q.awaitTermination(240)
    return out, [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]


def test_two_machines_and_a_gap(spark, tmp_path):
    """Both machines see the same path; one file vanishes for a scan and comes back as it was; others go for good."""
    rows = []
    for scan in range(1, 7):
        for machine, paths in (("m1", ["a", "b"]), ("m2", ["a"])):
            rows += [(machine, p, scan + 10 * (machine == "m2"), 5, 7) for p in paths if not (p == "b" and scan in (3, 6)) and not (machine == "m1" and p == "a" and scan % 2)]
    rows += [("m1", f"gone{k}", 1, 1, 1) for k in range(40)] + [("m1", "a", 11, 5, 7), ("m2", "a", 3, 5, 7)]
    scans = spark.createDataFrame(rows, "machine_id string, path string, scan_no long, size long, modified_secs long").withColumn("round", F.pmod("scan_no", F.lit(10)))
    got, sizes = progress_of(spark, tmp_path, scans.filter("not (machine_id = 'm2' and scan_no = 3) and not (machine_id = 'm1' and scan_no = 11)"), "round", lambda s: S.stable_files(s, 2), [(k, k + 1) for k in range(7)], empty=False)
    own = scans.filter("not (machine_id = 'm2' and scan_no = 3) and not (machine_id = 'm1' and scan_no = 11)")
    assert sorted(got) == sorted(map(tuple, I.stable(own).filter("stable").select("machine_id", "path", "scan_no", "size", "modified_secs").collect()))
    assert ("m2", "a", 12, 5, 7) in got and ("m1", "b", 2, 5, 7) in got and ("m1", "b", 4, 5, 7) not in got
    assert max(sizes) > 40 and sizes[-1] < 10


DAY = 86_400


def test_state_leaves_after_thirty_days(spark, tmp_path):
    """Rows of a hundred keys, then one key alone 40 days later and again 80 days later."""
    times = [(f"k{k}", 1000 + k, k, k % 3) for k in range(100)] + [("tick", 1000 + d * DAY, 1000 + d, 1) for d in (40, 80, 120)]
    cuts = [(0, 2000), (2000, 41 * DAY), (41 * DAY, 81 * DAY), (81 * DAY, 999 * DAY)]
    rows = spark.createDataFrame(times, "key string, ts long, seq long, digest long")
    got, sizes = progress_of(spark, tmp_path / "a", rows, "ts", lambda s: S.changes(s, "0 seconds"), cuts)
    assert sorted(got) == sorted(map(tuple, I.changes(rows).collect())) and len([r for r in got if r[0] == "tick"]) == 3
    assert max(sizes) >= 100 and sizes[-1] < 10
    moves = [(k, t, s, "claim" if k % 2 else "cancel", "extracting" if k % 2 else "canceled") for k, (_, t, s, _) in enumerate(times)]
    items = spark.createDataFrame(moves, "item long, ts long, seq long, event string, to_status string")
    got, sizes = progress_of(spark, tmp_path / "b", items, "ts", lambda s: S.item_states(s, "0 seconds"), cuts, "update")
    last = {r[0]: r[1:] for r in got}
    assert last == {r["item"]: (r["status"], r["illegal"]) for r in L.folded_status(items).collect()} and {v[0] for v in last.values()} >= {"canceled"}
    live = sum(v[0] not in S.Lifecycle.ended for v in last.values())
    assert max(sizes) >= 100 and sizes[-1] <= 2 * live + 10
    leases = spark.createDataFrame([(k, 1, t, s, t + 10) for k, t, s, _ in times], "owner string, item long, ts long, seq long, lease_expires_at long")
    got, sizes = progress_of(spark, tmp_path / "c", leases, "ts", S.expired_leases, cuts)
    assert len([r for r in got if r[0] != "tick"]) == 100 and max(sizes) >= 100 and sizes[-1] < 10


def test_enqueued_once_for_ever(spark, tmp_path):
    """Over batches, restarts and repeated batches, each key and hash comes once; nulls are keys as others."""
    rows = [(k, f"p{k % 30}" if k % 7 else None, f"h{k % 4}" if k % 5 else None) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, source_path_key string, source_hash string")
    told = []
    handle = lambda new, n: told.extend((n, r["source_path_key"], r["source_hash"]) for r in new.collect())
    for k in range(3):
        df.filter((F.col("id") >= 100 * k) & (F.col("id") < 100 * (k + 1))).coalesce(1).write.parquet(f"{tmp_path}/in/p{k}")
        stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        q = S.enqueue(stream, f"{tmp_path}/known", handle, f"{tmp_path}/ck", {"availableNow": True})  # starts again each time
        q.awaitTermination(240)
        assert not any(p["stateOperators"] for p in q.recentProgress)
    keys = [t[1:] for t in told]
    assert len(keys) == len(set(keys)) and set(keys) == {r[1:] for r in rows}
    again = S.first_rows(df.filter("id >= 200"), 2, f"{tmp_path}/known")
    assert sorted(map(str, again.select("source_path_key", "source_hash").collect())) == sorted(str(r) for r in spark.createDataFrame([t[1:] for t in told if t[0] == 2], "source_path_key string, source_hash string").collect())
    assert S.first_rows(df, 3, f"{tmp_path}/known").count() == 0


def test_claims_are_handed_over(spark, tmp_path):
    """Claim states as they change, and what the host is told of them."""
    from docfiling.plans import jobs

    rows = [("a", 0, 1, "m1", "claim", 900), ("b", 1, 2, "m2", "claim", 900), ("a", 5000, 3, "m2", "claim", 6000), ("c", 5001, 4, "m1", "claim", 6000), ("c", 9000, 5, "m1", "done", 0)]
    events = spark.createDataFrame(rows, "key string, ts long, seq long, machine_id string, event string, lease_expires_at long")
    S.use_rocksdb(spark)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    for k, (low, high) in enumerate([(0, 100), (100, 6000), (6000, 10_000)]):
        events.filter((F.col("ts") >= low) & (F.col("ts") < high)).coalesce(1).write.parquet(f"{tmp_path}/in/p{k}")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    told = []
    handle = lambda new, lost, n: told.append(([r[0] for r in new.collect()], [r[0] for r in lost.collect()]))
    jobs.per_batch(S.claim_states(stream), "m1", handle, f"{tmp_path}/handed", f"{tmp_path}/ck", {"availableNow": True}).awaitTermination(240)
    assert told == [(["a"], []), (["c"], ["a"]), ([], [])]


def test_plain_streams(spark, sf_dir, tmp_path):
    steps = reader(spark, sf_dir)("events").select((F.col("event_id") % 20).alias("item"), F.col("event_id").alias("ts"), (F.col("event_id") % 150).alias("current"), F.when(F.col("event_id") % 3 != 0, 100).alias("total"))
    last = {}
    for item, percent in replay(spark, steps, "ts", tmp_path / "b", S.progress, "update"):
        last[item] = percent
    want = {r["item"]: (min(r["current"], 100.0) if r["total"] else None) for r in sorted(steps.collect(), key=lambda r: r["ts"])}
    assert last == want


def watch(folder, df, order, build, spark, batches=3):
    """As replay, with the empty batches that let timers and windows end."""
    S.use_rocksdb(spark)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    cuts = df.approxQuantile(order, [k / batches for k in range(1, batches)], 0.0)
    for k, (low, high) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
        part = df.filter((F.lit(low is None) | (F.col(order) > low)) & (F.lit(high is None) | (F.col(order) <= high)))
        part.coalesce(1).write.parquet(f"{folder}/in/p{k}")
    out = []
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    q = build(stream).writeStream.outputMode("append").foreachBatch(lambda b, n: out.extend(map(tuple, b.collect()))).option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    q.awaitTermination(240)
    return sorted(out)


def test_leases(spark, sf_dir, tmp_path):
    """Owners that go silent, with several items each: gaps and the end of the log."""
    e = reader(spark, sf_dir)("events").filter("event_id % 20 = 0")
    events = e.select((F.concat(F.lit("s"), (F.col("event_id") % 7).cast("string"))).alias("owner"), (F.col("event_id") % 3).cast("long").alias("item"), (F.col("event_id") * 3 + 1000).cast("long").alias("ts"), F.col("event_id").alias("seq"), (F.col("event_id") * 3 + 1000 + F.col("event_id") % 1200).cast("long").alias("lease_expires_at"))
    top = events.agg(F.max("ts")).first()[0]
    last = spark.createDataFrame([("end", 0, top + 400, 10**9, top + 10**6)], events.schema)
    got = watch(tmp_path, events.unionByName(last), "ts", S.expired_leases, spark)
    want = sorted(map(tuple, I.expired_leases(events.unionByName(last), F.lit(top + 400), L.SESSION_SECONDS).collect()))
    assert len(want) > 10 and got == want
    # both items of the silent owners run out
    assert len({(r[0], r[1]) for r in got}) > 7


def test_released_and_pruned(spark, tmp_path):
    files = spark.createDataFrame([(f"f{k}", 1000 + 10 * k, 1000 + 11 * k) for k in range(30)] + [("f2", 1190, 1195), ("late", 900, 1300), ("tick", 99_999, 1400)], "path string, modified_secs long, seen_at long")
    got = watch(tmp_path / "a", files, "seen_at", S.released, spark)
    want = sorted(map(tuple, I.due(I.courtesy_due(files), "path", F.lit(1400)).collect()))
    assert got == want and ("f2", 1310) in got and ("late", 1020) in got and not any(p == "f29" and due < 1400 for p, due in got if due != 1410)
    day = 86400
    rows = [
        ("claim", "a", "a.json", True, "done", 0, 5 * day, day, 0, 0, 0, day), ("claim", "b", "b.json", True, "claimed", 0, 9 * day, None, 0, 0, 0, day), ("origin", "c", "c (copy).json", True, None, 0, 0, None, 0, 0, 2 * day, 2 * day),
        ("machine", "d", "d.json", False, None, 0, 0, None, 0, 0, 3 * day, 3 * day), ("claim", "a", "a.json", True, "done", 0, 5 * day, 20 * day, 0, 0, 0, 21 * day), ("origin", "z", "z.json", True, None, 0, 0, None, 90 * day, 0, 0, 45 * day),
    ]
    records = spark.createDataFrame(rows, "kind string, key string, file_name string, readable boolean, state string, claimed_at long, heartbeat_at long, done_at long, observed_at long, last_seen_at long, file_mtime long, seen_at long")
    got = watch(tmp_path / "b", records, "seen_at", S.pruned, spark)
    assert got == sorted(map(tuple, I.due(I.retention_due(records), "file_name", F.lit(45 * day)).collect()))
    assert got == [("b.json", 39 * day), ("c (copy).json", 3 * day), ("d.json", 4 * day)]


def test_precedence(spark, tmp_path):
    """At one instant the owner's renewal beats another's takeover, whatever their order in the log; done is final."""
    rows = [("k", 0, 1, "m1", "claim", 900), ("k", 2000, 2, "m2", "claim", 2900), ("k", 2000, 3, "m1", "renew", 2900), ("j", 0, 4, "m1", "claim", 900), ("j", 2000, 5, "m2", "claim", 2900), ("i", 0, 6, "m1", "claim", 900), ("i", 5, 7, "m1", "done", 0), ("i", 9000, 8, "m2", "claim", 9900)]
    events = spark.createDataFrame(rows, "key string, ts long, seq long, machine_id string, event string, lease_expires_at long")
    want = {("k", "m1", "claimed", 1), ("j", "m2", "claimed", 0), ("i", "m1", "done", 1)}
    assert {tuple(r) for r in I.folded_claims(events).collect()} == want
    got = {}
    for key, *state in replay(spark, events, "ts", tmp_path, S.claim_states, "update"):
        got[key] = (key, *state)
    assert set(got.values()) == want


def test_changes_and_presence(spark, sf_dir, tmp_path):
    e = reader(spark, sf_dir)("events").filter("event_id < 600")
    # no event at time 0, which is what a stream's watermark starts from
    rows = e.select((F.col("user_id") % 9).cast("string").alias("key"), (F.col("event_id") + 1).alias("ts"), F.col("event_id").alias("seq"), (F.floor(F.col("event_id") / 4) % 5).alias("digest"))
    got = sorted(map(tuple, replay(spark, rows, "ts", tmp_path / "a", S.changes, "append")))
    assert got == sorted(map(tuple, I.changes(rows).collect())) and len(got) < rows.count()
    seen = e.select(F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")).alias("machine_id"), (F.col("event_id") * 7 + 600).alias("last_seen_at"))
    last = {}
    for machine, at in replay(spark, seen, "last_seen_at", tmp_path / "b", S.presence, "update"):
        last[machine] = at
    assert last == {r[0]: r[1] for r in seen.groupBy("machine_id").agg(F.max("last_seen_at")).collect()}
    late = spark.createDataFrame([("x", 10**6)], seen.schema)
    got = watch(tmp_path / "c", seen.unionByName(late), "last_seen_at", S.active_machines, spark)
    by = {}
    for start, machine, _ in got:
        by.setdefault(start, set()).add(machine)
    assert {k: len(v) for k, v in by.items()} == {r["start"]: r["machines"] for r in I.machines_by_window(seen).collect()}


def test_arrivals(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("a.pdf", "x"), (".hidden.pdf", "x"), ("~$b.docx", "x"), ("c.exe", "x"), ("empty.txt", ""), ("d.MD", "yy")):
        (tmp_path / "in" / name).write_text(text)
    out = []
    q = S.arrivals(spark, str(tmp_path / "in")).writeStream.foreachBatch(lambda b, n: out.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["path"].rsplit("/", 1)[-1], r["size"]) for r in out) == [("a.pdf", 1), ("d.MD", 2)] and all(r["modified_secs"] > 0 for r in out)
