"""One report from all tasks, a log by epochs, and scans of what is new."""

import json
import os

import pytest
from pyspark.sql import functions as F

from umbra.operators.scanning import report, scan_contents, status_table
from umbra.profiles import load
from umbra.scan import json_lines, main
from umbra.sources.allfiles import read_files, stream_files
from umbra.sources.lines import read_log, write_log, write_report
from umbra.streaming.logs import log_lines


def files(top, n, first=0):
    os.makedirs(top, exist_ok=True)
    for i in range(first, first + n):
        with open(f"{top}/f{i:04d}.txt", "w") as f:
            f.write(f"mail a{i}@b.co" if i % 3 == 0 else f"ténth {i}")


def test_one_report_in_order(spark, tmp_path):
    files(f"{tmp_path}/in", 60)
    results = scan_contents(read_files(spark, [f"{tmp_path}/in"]), load("file_scan"))
    rows = [r.asDict(True) for r in report(results).orderBy("path").collect()]
    write_report(json_lines(results), f"{tmp_path}/report", head="[\n", between=",\n", tail="\n]\n", empty="[]\n")
    assert open(f"{tmp_path}/report").read() == json.dumps(rows, indent=4) + "\n"
    write_report(json_lines(results.limit(0)), f"{tmp_path}/report", head="[\n", between=",\n", tail="\n]\n", empty="[]\n")
    assert open(f"{tmp_path}/report").read() == "[]\n"
    assert sorted(os.listdir(tmp_path)) == ["in", "report"]


def test_a_failed_job_leaves_the_report(spark, tmp_path):
    write_report(spark.createDataFrame([("old\n",)], "line string"), f"{tmp_path}/report")
    bad = spark.range(100).select(F.when(F.col("id") == 99, F.raise_error(F.lit("no"))).otherwise(F.lit("new\n")).alias("line"))
    with pytest.raises(Exception, match="no"):
        write_report(bad, f"{tmp_path}/report")
    assert open(f"{tmp_path}/report").read() == "old\n" and os.listdir(tmp_path) == ["report"]


def test_cli_prints_the_same_table(spark, tmp_path, capsys):
    files(f"{tmp_path}/in", 30)
    assert main([f"{tmp_path}/in", "--bail"], spark) == 1
    out = capsys.readouterr().out
    table = status_table(scan_contents(read_files(spark, [f"{tmp_path}/in"]), load("file_scan"))).orderBy("file_path").collect()
    lines = [("Status", "Findings", "File Path"), *((r.status, r.findings, r.file_path) for r in table)]
    widths = [max(len(x[i]) for x in lines) for i in range(3)]
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    want = [rule] + [y for i, x in enumerate(lines) for y in (["| " + " | ".join(v.ljust(w) for v, w in zip(x, widths)) + " |"] + ([rule] if i in (0, len(lines) - 1) else []))]
    assert "\n".join(want) in out and "Files with findings: 10" in out
    assert main([f"{tmp_path}/none", "--output", "json"], spark) == 0
    assert "[]\n\nScan complete. Files scanned: 0" in capsys.readouterr().out


def test_each_log_line_once(spark, tmp_path):
    """Killed after its epoch was committed and before Spark knew: the epoch comes again, its lines don't."""
    source, log, state = (f"{tmp_path}/{x}" for x in ("source", "log", "state"))
    records = lambda a, b: spark.range(a, b).select(F.lit("2024-01-01").cast("timestamp").alias("datetime"), F.lit("app").alias("channel"), F.lit("I").alias("level"), F.concat(F.lit("n "), "id").alias("message"))
    records(0, 40).write.parquet(source)

    def run():
        stream = spark.readStream.schema(records(0, 1).schema).parquet(source)
        q = write_log(log_lines(stream, load("default")), log, state, availableNow=True)
        q.awaitTermination()

    run()
    records(40, 70).write.mode("append").parquet(source)
    run()
    last = max(int(n) for n in os.listdir(f"{state}/commits") if n.isdigit())
    os.remove(f"{state}/commits/{last}")
    if os.path.exists(crc := f"{state}/commits/.{last}.crc"):
        os.remove(crc)
    run()  # the last epoch is written again
    lines = [r.value for r in read_log(spark, log).collect()]
    assert len(lines) == 70 and len(set(lines)) == 70
    assert {r.epoch for r in read_log(spark, log).collect()} == {0, last}


def test_only_new_and_changed_files_are_scanned(spark, tmp_path):
    top, out, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    files(top, 9)

    def run():
        found = scan_contents(stream_files(spark, [top], settle=0), load("file_scan")).select("path", F.size("findings").alias("n"))
        q = found.writeStream.format("parquet").option("checkpointLocation", state).start(out)
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return {(os.path.basename(r.path), r.n) for r in spark.read.parquet(out).collect()}, spark.read.parquet(out).count()

    _, first = run()
    assert first == 9
    files(top, 3, first=9)
    with open(f"{top}/f0001.txt", "w") as f:
        f.write("now with mail x@y.zz")
    rows, second = run()
    assert second == 13 and ("f0001.txt", 1) in rows and ("f0001.txt", 0) in rows and ("f0009.txt", 1) in rows
    assert run()[1] == 13
