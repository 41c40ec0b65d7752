"""State machines: batch folds against plain loops, and streams against batch."""

import random

from pyspark.sql import functions as F

from glyphmill.streaming import state


def events(spark, seed=11, n=600, users=5):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(10_000), rng.choice([1, 1, 1, *range(users), None]), rng.choice(["error", "error", "click", "view"])) for i in range(n)]
    rows.append((n, None, 1, "error"))
    df = spark.createDataFrame(rows, "event_id bigint, s bigint, user_id bigint, event_type string").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    return df.withColumn("t", F.lit("clash")), sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[0]))


def per_user(rows):
    out = {}
    for r in rows:
        out.setdefault(r[2], []).append(r)
    return out


def test_ttl(spark):
    df, rows = events(spark)
    got = {r.user_id: (r.n_events, r.n_misses, r.n_hits) for r in state.ttl_hits(df, ["user_id"], "ts", "event_id", 30).collect()}
    for user, own in per_user(rows).items():
        last, misses = None, 0
        for r in own:
            if last is None or r[1] - last >= 30:
                last, misses = r[1], misses + 1
        assert got[user] == (len(own), misses, len(own) - misses)
    assert state.ttl_hits(df.limit(0), ["user_id"], "ts", "event_id", 30).count() == 0


def test_store_breaker(spark):
    df, rows = events(spark)
    kind = F.when(F.col("event_type") == "error", "failure").otherwise("success")
    got = {r.user_id: (r.n_events, r.n_openings, r.n_rejected, r.failures) for r in state.store_breaker(df, ["user_id"], "ts", "event_id", kind, 3, 100).collect()}
    for user, own in per_user(rows).items():
        n = until = openings = rejected = 0
        for r in own:
            if until and r[1] > until:
                n = until = 0
            if r[1] < until:
                rejected += 1
            elif r[3] == "error":
                n += 1
                if n >= 3:
                    until, openings = r[1] + 100, openings + 1
            elif n:
                n = until = 0
        assert got[user] == (len(own), openings, rejected, n), user


def test_compiler_breaker(spark):
    df, rows = events(spark, 12)
    kind = F.when(F.col("event_type") == "error", "network_failure").when(F.col("event_type") == "click", "compiler_error").otherwise("success")
    got = {r.user_id: (r.n_openings, r.n_rejected, r.n_network, r.n_compiler, r.n_success, r.failures) for r in state.compiler_breaker(df, ["user_id"], "ts", "event_id", kind, 2, 20, 90).collect()}
    for user, own in per_user(rows).items():
        n = until = openings = rejected = network = compiler = success = 0
        for r in own:
            if r[1] < until:
                rejected += 1
            elif r[3] == "error":
                n, network = n + 1, network + 1
                if n >= 2:
                    until, openings = r[1] + min(20 * 2 ** min(n - 2, 5), 90), openings + 1
            elif r[3] == "click":
                n, compiler = 0, compiler + 1
            else:
                n, until, success = 0, 0, success + 1
        assert got[user] == (openings, rejected, network, compiler, success, n), user


def test_stream_equals_batch(spark, tmp_path):
    df, _ = events(spark)
    clean = df.filter("user_id is not null and ts is not null").drop("t")
    cuts = [0, 2_500, 5_000, 10_001]
    for i in range(3):  # files in time order, one to a micro-batch
        clean.filter((F.col("s") >= cuts[i]) & (F.col("s") < cuts[i + 1])).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(clean.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = state.ttl_stream(stream, "user_id", "ts", 30).writeStream.format("memory").queryName("ttl_out").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.user_id: (r.n, r.m) for r in spark.sql("select user_id, count(*) n, count_if(not is_hit) m from ttl_out group by 1").collect()}
    assert got == {r.user_id: (r.n_events, r.n_misses) for r in state.ttl_hits(clean, ["user_id"], "ts", "event_id", 30).collect()}


def test_window_counts(spark, tmp_path):
    df, _ = events(spark)
    clean = df.filter("ts is not null").drop("t")
    clean.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(clean.schema).parquet(str(tmp_path / "in"))
    query = state.window_counts(stream, "ts", "event_type", "1 hour").writeStream.outputMode("complete").format("memory").queryName("win_out").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.sql("select sum(n) s from win_out").first().s == clean.count()
