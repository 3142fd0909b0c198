"""The streaming sink: each document once, whatever fails or runs again."""

import os

from pyspark.sql import functions as F

from weblens import plugins
from weblens.sources import sinks


def numbers(spark, folder, parts):
    for i in range(parts):
        spark.range(i * 10, i * 10 + 10).coalesce(2).write.parquet(f"{folder}/part={i}")
    return spark.readStream.schema("id long").option("maxFilesPerTrigger", 2).parquet(f"{folder}/part=*")


def run(stream, out, checkpoint):
    return stream.writeStream.format("weblens_once").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def test_a_failed_task_and_a_repeated_batch_leave_each_document_once(spark, tmp_path):
    spark.dataSource.register(sinks.OnceSink)
    out, ck, flag = str(tmp_path / "out"), str(tmp_path / "ck"), str(tmp_path / "failed")

    @F.udf("string")
    def told(i):
        if i == 25 and not os.path.exists(flag):
            open(flag, "w").close()
            raise RuntimeError("this task fails once")
        return f'{{"id": {i}}}'

    stream = numbers(spark, str(tmp_path / "in"), 4).select(told("id").alias("value"))
    first = run(stream, out, ck)
    try:
        first.awaitTermination()
        failed = False
    except Exception:
        failed = True
    assert failed and os.path.exists(flag)
    run(stream, out, ck).awaitTermination()
    want = sorted(f'{{"id": {i}}}' for i in range(40))
    assert sorted(r.value for r in sinks.delivered(spark, out).collect()) == want
    # The last batch's commit is lost after the sink has it: the batch runs again.
    last = max(int(n) for n in os.listdir(f"{ck}/commits") if n.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(f"{ck}/commits/{name}"):
            os.remove(f"{ck}/commits/{name}")
    run(stream, out, ck).awaitTermination()
    assert sorted(r.value for r in sinks.delivered(spark, out).collect()) == want


def test_sinks_by_name(spark, tmp_path):
    sink = plugins.get("sink", "files")(str(tmp_path))
    sink.emit_alerts(spark.createDataFrame([('{"a": 1}',)], "value string"))
    sink.emit_insights(spark.createDataFrame([(1, "x")], "n int, s string"))
    sink.emit_dead_letters(spark.createDataFrame([("f", "json", "{")], "source string, reason string, raw string"))
    assert [r.value for r in spark.read.text(f"{tmp_path}/insights").collect()] == ['{"n":1,"s":"x"}']
    assert spark.read.text(f"{tmp_path}/alerts").count() == spark.read.text(f"{tmp_path}/dead_letters").count() == 1
