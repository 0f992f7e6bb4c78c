import json

from spanlake import sinks
from spanlake.__main__ import main
from spanlake.session import scratch_path
from test_spans import span, table


def test_commands(spark, capsys):
    lake, log, out = (scratch_path(spark, n) for n in ("lake", "log", "out"))
    sinks.write_spans(table(spark, *[span(i) for i in range(5)]), lake)
    spark.createDataFrame([(json.dumps({"type": "error", "path": "/x"}),), ("broken",)], "value STRING").write.text(log)
    main(["stats", lake])
    main(["inspect", lake, "--limit", "2"])
    main(["calls", lake, "--early", "--limit", "1"])
    main(["logs", log, "--details"])
    main(["logs", log, "--type", "error"])
    shown = capsys.readouterr().out
    for text in ("kilobytes", "name, trace_id", "s0000", "/x", "broken"):
        assert text in shown
    records = spark.createDataFrame([("1", "p", "r", 1.0)], "id STRING, prompt STRING, response STRING, timestamp DOUBLE")
    records.write.parquet(scratch := scratch_path(spark, "sft"))
    main(["export", scratch, out, "--sft-format", "text"])
    assert spark.read.parquet(out).first()["text"] == "User: p\nAssistant: r"
