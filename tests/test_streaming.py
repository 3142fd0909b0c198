"""The tail source, and the live service against the batch plan."""

import json

from pyspark.sql import functions as F

from weblens.functions import fixed
from weblens.operators.features import window_features
from weblens.plans import detection
from weblens.sources import tail
from weblens.streaming import live


def record(t, path, ip="10.0.0.1"):
    return json.dumps({"@timestamp": f"2024-01-01T{t // 3600:02d}:{t // 60 % 60:02d}:{t % 60:02d}Z", "observer": {"server": "s"}, "source": {"ip": ip}, "http": {"request": {"method": "GET"}, "response": {"status_code": 200}}, "url": {"path": path}, "event": {"type": "access"}})


def test_tail_follows_growth_and_waits_for_line_ends(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.json").write_text("one\ntwo\nhal")
    reader = tail.TailReader({"path": str(logs)})
    read = lambda a, b: [v for p in reader.partitions(a, b) for v, _ in reader.read(p)]
    first = reader.latestOffset()
    assert read(reader.initialOffset(), first) == ["one", "two"]
    with (logs / "a.json").open("a") as f:
        f.write("f\nthree\n")
    (logs / "b.json").write_text("new\n")
    second = reader.latestOffset()
    assert read(first, second) == ["half", "three", "new"]
    (logs / "a.json").write_text("again\n")
    assert read(second, reader.latestOffset()) == ["again"]
    assert tail.TailReader({"path": str(logs), "startAtEnd": "true"}).initialOffset() == {str(logs / "a.json"): 6, str(logs / "b.json"): 4}


def test_pieces_of_a_file_hold_each_line_once(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "SPLIT", 7)
    (tmp_path / "a.json").write_text("".join(f"line{i}\n" for i in range(50)))
    reader = tail.TailReader({"path": str(tmp_path)})
    got = [v for p in reader.partitions({}, reader.latestOffset()) for v, _ in reader.read(p)]
    assert got == [f"line{i}" for i in range(50)]


def test_closed_windows_equal_the_batch(spark, tmp_path):
    logs, out = tmp_path / "logs", {}
    logs.mkdir()
    times = [(i * 20, f"/p{i % 5}") for i in range(60)]
    (logs / "a.json").write_text("".join(record(t, p) + "\n" for t, p in times) + "not json\n")

    def keep(df, n):
        for r in df.select("epoch", "url_path").collect():
            out.setdefault(r.epoch // 300, []).append(r.url_path)

    stream = live.tailed(spark, str(logs))
    run = lambda: live.closed_requests(stream).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    run()
    with (logs / "a.json").open("a") as f:
        f.write(record(5000, "/late") + "\n")
    run()
    with (logs / "a.json").open("a") as f:
        f.write(record(0, "/too-late") + "\n" + record(9000, "/end") + "\n")
    run()
    start = 1704067200 // 300
    assert {b - start: len(v) for b, v in out.items() if b - start < 4} == {0: 15, 1: 15, 2: 15, 3: 15}
    assert not any("/too-late" in v for v in out.values())


def test_live_batches_score_like_the_batch_plan(spark, tmp_path):
    from tests.test_detection import traffic

    requests = traffic(spark, 12, 40)
    bots, recon = detection.train(requests, "bot_detection", "v1"), detection.train(requests, "web_recon", "v1")
    service = live.Live(spark, str(tmp_path / "state"), bots, recon)
    first = requests.agg(F.min("epoch")).first()[0]
    cut = (first // 300 + 3) * 300
    # Two micro-batches of whole windows pass the keyed memory; the second runs twice.
    for i, part in enumerate((requests.where(F.col("epoch") < cut), requests.where(F.col("epoch") >= cut))):
        part.select(*live.COLUMNS).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
        stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in" / "part=0")).schema).parquet(str(tmp_path / "in" / "part=*"))

        def batch(rows, number):
            if not rows.isEmpty():
                for _ in range(number + 1):
                    service.batch(rows, number)

        with live.state_in_rocksdb(spark):
            timed = stream.withColumn("closes", F.col("ts")).withWatermark("closes", "0 seconds")
            live.remembering(timed).writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    log = spark.read.parquet(str(tmp_path / "state" / "log"))
    windows = window_features(requests, recon.profile).count()
    assert log.count() == 2 * windows and log.select("usecase", "server", "source_ip", "ua_hash", "window_start").distinct().count() == 2 * windows
    whole = detection.score_windows(window_features(requests, bots.profile), bots)
    got = log.where("usecase = 'bot_detection'").withColumnRenamed("fused_pct", "live_pct").join(whole, [*detection.ENTITY, "window_start"])
    assert got.where(F.abs(F.col("live_pct") - F.round("fused_pct", 5)) > 1e-9).count() == 0
    service.drift_s = 0.0
    service.check_drift(2)
    assert spark.read.parquet(str(tmp_path / "state" / "drift")).where("usecase = 'web_recon'").count() >= 1
    assert live.drift_check(service, recon, least=5).first().band in ("stable", "moderate", "significant")
    assert fixed.GRACE_S == 120


def test_memory_by_client_lies_in_the_state_store(spark, tmp_path):
    """Five micro-batches: each row leaves with what its client had shown in the batches before, and nothing is read but state."""
    got = []
    for i in range(5):
        rows = [(i * 10 + k, "s", f"10.0.0.{k % 2}", "curl/8", "/robots.txt" if (i, k) == (3, 0) else "/p", 200, "GET", None, 5, "US", "access", "raw", 1704067200 + 3600 * i) for k in range(4)]
        names = "event_id long, server string, source_ip string, user_agent string, url_path string, status_code int, http_method string, referrer string, body_bytes long, geo_country string, event_type_ecs string, original string, epoch long"
        frame = spark.createDataFrame(rows, names).withColumn("us", F.col("epoch") * 1000000).withColumn("ts", F.timestamp_micros("us"))
        frame.select(*live.COLUMNS).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    stream = spark.readStream.schema(frame.select(*live.COLUMNS).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part=*"))
    told = live.remembering(stream.withColumn("closes", F.col("ts")).withWatermark("closes", "0 seconds"))
    with live.state_in_rocksdb(spark):
        query = told.writeStream.foreachBatch(lambda df, n: got.extend((n, r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(got) == 20 and len({n for n, _ in got}) == 5
    for _, r in got:
        n = (r.epoch - 1704067200) // 3600
        assert [r[f"b{h}"] for h in range(24)] == [2 if h < n else 0 for h in range(24)]
        assert r.ever_before == (n > 3 and r.source_ip == "10.0.0.0")


def test_drain_ends_under_steady_input(spark, tmp_path):
    rate = spark.readStream.format("rate").option("rowsPerSecond", 100).load()
    query = rate.writeStream.foreachBatch(lambda df, n: df.count()).option("checkpointLocation", str(tmp_path / "ck")).start()
    live.drain(query, 30.0)
    assert not query.isActive and query.exception() is None


def test_days_and_snapshots(spark, tmp_path):
    t = live.Tables(spark, str(tmp_path))
    for n in range(6):
        t.put_days(spark.createDataFrame([(n * 86400 + 5, n)], "window_end long, n long"), "scored", n, "window_end")
        t.put_snapshot(spark.createDataFrame([(n,)], "n long"), "robots", n)
    got = t.get_days("scored", 5, 3 * 86400)
    assert sorted(r.n for r in got.collect()) == [3, 4] and all("/day=0/" not in f for f in got.inputFiles())
    assert t.get_snapshot("robots", 6).first().n == 5 and t.get_snapshot("robots", 2) is None
