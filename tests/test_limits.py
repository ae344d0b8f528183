import random

from quire.streaming.limits import decide, limited_by_windows

S = 1_000_000


def loop(times, windows):
    """The limits as a service would keep them: a list for each window."""
    held, out = [[] for _ in windows], []
    for now in times:
        for i, (_, seconds) in enumerate(windows):
            held[i] = [t for t in held[i] if now - t <= seconds * S]
        ok = all(len(h) < limit for h, (limit, _) in zip(held, windows))
        if ok:
            for h in held:
                h.append(now)
        out.append(ok)
    return out


def events(seed=1, n=500):
    rng, at, rows = random.Random(seed), 1_700_000_000 * S, []
    for _ in range(n):
        at += rng.choice([0, S // 2, 3 * S, 20 * S, 60 * S, 400 * S])
        rows.append((rng.choice("abc"), at))
    return rows


def test_decisions_against_the_loop():
    windows = ((3, 60), (12, 3000))
    for seed in range(20):
        times = [t for _, t in events(seed)]
        assert decide(times, [], windows)[0] == loop(times, windows)
        half = len(times) // 2
        first, kept = decide(times[:half], [], windows)
        assert first + decide(times[half:], kept, windows)[0] == loop(times, windows) and len(kept) <= 12


def expected(rows, windows):
    out = []
    for k in "abc":
        times = sorted(t for x, t in rows if x == k)
        out += [(k, t, ok) for t, ok in zip(times, loop(times, windows))]
    return sorted(out)


def plain(rows):
    return sorted((r["key"], round(r["at"].timestamp() * S), r["allowed"]) for r in rows)


def table(spark, rows):
    return spark.createDataFrame(rows, "user string, at long").selectExpr("user", "timestamp_micros(at) AS ts")


def test_batch(spark):
    windows, rows = ((3, 60), (12, 3000)), events()
    odd = spark.createDataFrame([(None, 1), ("a", None)], "user string, at long").selectExpr("user", "timestamp_micros(at) AS ts")
    assert plain(limited_by_windows(table(spark, rows).unionByName(odd).repartition(5), "user", "ts", windows=windows).collect()) == expected(rows, windows)


def test_stream_of_shuffled_batches(spark, tmp_path):
    """Events come out of order, within what counts as late, in several micro-batches; a last one moves the watermark past all."""
    windows, rows = ((3, 60), (12, 3000)), events(3, 200)
    order = sorted(range(len(rows)), key=lambda i: rows[i][1] + random.Random(i).randrange(0, 240 * S))
    parts = [order[i : i + 50] for i in range(0, len(order), 50)]
    for i, part in enumerate(parts):
        table(spark, [rows[j] for j in part]).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    far = max(t for _, t in rows) + 10**6 * S
    for i in range(2):
        table(spark, [("z", far + i * 10**6 * S)]).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema("user string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = limited_by_windows(stream, "user", "ts", "5 minutes", windows).writeStream.format("memory").queryName("decided").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert query.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert plain(spark.table("decided").filter("key <> 'z'").collect()) == expected(rows, windows)
