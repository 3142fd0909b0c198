"""Command line over the same functions: ``python -m weblens.cli COMMAND ...``."""

import argparse
import json
import os
import signal
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblens import plugins
from weblens.functions import fixed
from weblens.operators import sessions
from weblens.plans import detection, usecases
from weblens.plans.registry import Registry, load, new_version
from weblens.sources import ndjson

#: Thresholds are part of the rules, not of a configuration.
POLICY = {"input", "registry", "usecases", "mode", "budget", "state", "checkpoint", "pattern"}


#: Requests from which a service without bundles learns at most.
WARM_UP = 2_000_000


def newest(rows: DataFrame, most: int) -> DataFrame:
    """The newest ``most`` requests or so: those from the hour on in which that many are reached."""
    hours = sorted(map(tuple, rows.where("epoch is not null").groupBy(F.floor(F.col("epoch") / 3600).alias("hour")).count().collect()), reverse=True)  # a row an hour
    n = 0
    for hour, count in hours:
        n += count
        if n >= most:
            return rows.where(F.col("epoch") >= hour * 3600)
    return rows


def session() -> SparkSession:
    return SparkSession.builder.appName("weblens").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def requests(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    rows = ndjson.records(ndjson.parsed(ndjson.lines(spark, path))).withColumn("us", F.unix_micros("ts")).withColumn("epoch", F.floor(F.col("us") / 1000000))
    return ndjson.first_events(rows, limit) if limit else rows


def show(rows: DataFrame) -> None:
    for r in rows.collect():  # reports of a few rows
        print(json.dumps(r.asDict(True), default=str))


def validate(a) -> int:
    rows = ndjson.parsed(ndjson.lines(session(), a.input)).persist()
    show(ndjson.ingest_stats(rows))
    show(ndjson.failure_reasons(rows))
    return 0 if rows.where("reason is null").limit(1).count() else 1


def report_sessions(a) -> int:
    show(sessions.session_report(sessions.session_features(sessions.sessionized(requests(session(), a.input, a.limit)))))
    return 0


def lint_config(a) -> int:
    config = configured(a.config)
    unknown, wrong = sorted(set(config) - POLICY), faults(config)
    print(json.dumps({"not_policy": unknown, "faults": wrong}))
    return 1 if unknown or wrong else 0


def configured(path: str, environ: dict[str, str] | None = None) -> dict:
    """A JSON file of settings; ``WEBLENS_`` and a setting's name in capitals overrides it, as JSON or plain text."""
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    for name, text in (os.environ if environ is None else environ).items():
        if name.startswith("WEBLENS_") and (key := name.removeprefix("WEBLENS_").lower()) in POLICY:
            try:
                config[key] = json.loads(text)
            except ValueError:
                config[key] = text
    return config


def faults(config: dict) -> list[str]:
    """What the rules of a deployment forbid."""
    out, live = [], config.get("mode") == "live"
    if config.get("mode", "shadow") not in ("observe", "shadow", "live"):
        out.append("mode is observe, shadow or live")
    if live and not config.get("checkpoint"):
        out.append("a live service names its checkpoint")
    if not isinstance(config.get("budget", 1), int) or config.get("budget", 1) < 1:
        out.append("budget is a number of alerts from 1")
    return out + [f"no use case {u}" for u in config.get("usecases", []) if u not in plugins.names("usecase")]


def list_plugins(a) -> int:
    if a.folder:
        plugins.discover(a.folder)
    print(json.dumps({k: plugins.names(k) for k in plugins.KINDS}))
    return 0


def train(a) -> int:
    registry = Registry(a.registry)
    bundle = detection.train(requests(session(), a.input, a.limit), a.uc, new_version())
    registry.add(bundle)
    if a.promote:
        registry.promote(a.uc, bundle.version)
    print(json.dumps(bundle.metadata))
    return 0


def backtest(a) -> int:
    log, _, _ = detection.backtest(requests(session(), a.input, a.limit), a.uc)
    report = detection.backtest_report(log).persist()
    show(report)
    return 0 if report.first().canary_found else 1


def promote(a) -> int:
    registry = Registry(a.registry)
    print(registry.rollback(a.uc) if a.rollback else registry.promote(a.uc, a.version))
    return 0


def status(a) -> int:
    print(json.dumps([Registry(a.registry).describe(u) for u in deployed()]))
    return 0


def check(a) -> int:
    """Compare a candidate with the serving bundle over the same requests; 1 if it may not serve."""
    spark, registry = session(), Registry(a.registry)
    serving, version = registry.load_current(spark, a.uc), a.version or registry.candidate(a.uc)
    if serving is None or version is None:
        print(json.dumps({"approve": False, "reason": "nothing to compare"}))
        return 1
    report = detection.candidate_check(requests(spark, a.input, a.limit), serving, load(spark, registry.folder(a.uc, version))).persist()
    show(report)
    return 0 if report.first().approve else 1


def deployed() -> list[str]:
    """All registered use cases, exporters first."""
    return usecases.in_order(plugins.names("usecase"))


def run(a) -> int:
    from weblens.streaming.live import Health, Live, drain, tailed

    spark, registry = session(), Registry(a.registry)
    names = deployed()
    bundles = [registry.load_current(spark, u) for u in names]
    if None in bundles:  # a cold start learns from what is there, the newest WARM_UP requests at most
        rows = newest(requests(spark, a.input), WARM_UP).persist()
        version = new_version()
        for u, b in zip(names, bundles, strict=True):
            if b is None:
                registry.add(detection.train(rows, u, version))
                registry.promote(u, version)
        rows.unpersist()
        bundles = [registry.load_current(spark, u) for u in names]
    spark.streams.addListener(Health(f"{a.state}/health.json"))
    query = Live(spark, a.state, *bundles, mode=a.mode).start(tailed(spark, a.input), f"{a.state}/checkpoint-{'+'.join(names)}", once=a.once)
    # A signal ends the service after the batch that runs.
    for s in (signal.SIGINT, signal.SIGTERM):
        signal.signal(s, lambda *_: drain(query))
    query.awaitTermination()
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weblens")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, run_, *flags):
        c = sub.add_parser(name)
        c.set_defaults(run=run_)
        known = {"input": {"required": True}, "registry": {"default": "registry"}, "uc": {"choices": deployed(), "default": "web_recon"}, "limit": {"type": int}, "version": {}, "config": {"required": True}, "folder": {}, "state": {"default": "state"}, "mode": {"choices": ("observe", "shadow", "live"), "default": "shadow"}}
        for f in flags:
            c.add_argument(f"--{f}", **known.get(f, {"action": "store_true"}))

    command("validate", validate, "input")
    command("sessions", report_sessions, "input", "limit")
    command("lint-config", lint_config, "config")
    command("train", train, "input", "uc", "limit", "registry", "promote")
    command("backtest", backtest, "input", "uc", "limit")
    command("promote", promote, "uc", "version", "rollback", "registry")
    command("status", status, "registry")
    command("check", check, "input", "uc", "limit", "version", "registry")
    command("plugins", list_plugins, "folder")
    command("run", run, "input", "registry", "state", "mode", "once")
    command("version", lambda a: print(fixed.__name__.split(".")[0], "0.1") or 0)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    return a.run(a)


if __name__ == "__main__":
    sys.exit(main())
