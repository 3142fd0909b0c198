"""Commands over small files."""

import json

from weblens import cli
from weblens.plans.scalar_queries import LINES


def test_validate_sessions_and_lint(spark, tmp_path, capsys):
    (tmp_path / "a.json").write_text("\n".join(LINES) + "\n")
    assert cli.main(["validate", "--input", str(tmp_path)]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[0])["parsed"] == 3
    assert cli.main(["sessions", "--input", str(tmp_path)]) == 0
    (tmp_path / "c.cfg").write_text(json.dumps({"input": "x", "gate_percentile": 0.9}))
    assert cli.main(["lint-config", "--config", str(tmp_path / "c.cfg")]) == 1
    assert cli.main(["status", "--registry", str(tmp_path / "none")]) == 0 and cli.main(["version"]) == 0


def test_sinks(spark, tmp_path):
    from weblens.plans.scalar_queries import parsed
    from weblens.sources import ndjson, sinks

    sinks.write_dead_letters(ndjson.dead_letters(parsed(spark)), str(tmp_path / "dead"))
    sinks.write_insights(spark.createDataFrame([(1, "a")], "n int, what string"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "dead")).count() == 4 and spark.read.json(str(tmp_path / "out")).first().what == "a"
    rows = spark.createDataFrame([("u", "d", 1), ("u", "e", 2)], "usecase string, disposition string, n int")
    sinks.write_log(rows, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).where("disposition = 'e'").first().n == 2


def test_plugins_and_configuration(tmp_path, capsys):
    (tmp_path / "mine.py").write_text("from weblens import plugins\n\n@plugins.register('sink', 'mine')\nclass Mine: pass\n")
    (tmp_path / "broken.py").write_text("raise ValueError\n")
    assert cli.main(["plugins", "--folder", str(tmp_path)]) == 0
    assert "mine" in json.loads(capsys.readouterr().out)["sink"]
    (tmp_path / "c.cfg").write_text(json.dumps({"mode": "shadow", "budget": 5}))
    got = cli.configured(str(tmp_path / "c.cfg"), {"WEBLENS_MODE": "live", "WEBLENS_BUDGET": "0", "WEBLENS_OTHER": "1"})
    assert got == {"mode": "live", "budget": 0} and len(cli.faults(got)) == 2
