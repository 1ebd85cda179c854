"""The file source, scans and their reports, log lines, SQL functions and streams."""

import hashlib
import json
import os

from pyspark.sql import functions as F

from umbra.functions.sql import pattern_hits, register
from umbra.operators.scanning import report, scan_contents, scan_documents, status_table, summary
from umbra.profiles import from_config, load
from umbra.queries import file_source
from umbra.scan import main
from umbra.sources import allfiles
from umbra.sources.allfiles import collect_files, missing_paths, read_files
from umbra.streaming.logs import batch_lines, log_lines, tap

SECRET = "api_key=abcdefghijklmnop1234 and more\n"


def tree(top):
    for path, data in {
        "clean.txt": b"Nothing to see here, only a few plain words.\n",
        ".env": SECRET.encode(),
        "_hidden/x.txt": b"mail me: a@b.co",
        "sub/y.lock": SECRET.encode(),
        "sub/latin.bin": b"\xe9555-123-4567\xff",
        "sub/vendor/z.js": SECRET.encode(),
        "big.txt": b"x " * 2500,
        "empty": b"",
    }.items():
        os.makedirs(os.path.dirname(f"{top}/{path}"), exist_ok=True)
        with open(f"{top}/{path}", "wb") as f:
            f.write(data)
    os.symlink(f"{top}/clean.txt", f"{top}/link.txt")


def test_listing(tmp_path):
    tree(tmp_path)
    names = lambda found: [os.path.relpath(p, os.path.realpath(tmp_path)) for p, _ in found]
    assert set(names(collect_files([str(tmp_path)], ["*.lock", "vendor/*"], 4000))) == {".env", "clean.txt", "empty", "_hidden/x.txt", "sub/latin.bin", "sub/vendor/z.js"}
    assert names(collect_files([f"{tmp_path}/sub/y.lock", str(tmp_path), f"{tmp_path}/none"], ["*"])) == ["sub/y.lock"]
    assert "sub/vendor/z.js" not in names(collect_files([str(tmp_path)], exclude_paths=["*vendor/*"]))
    assert missing_paths([str(tmp_path), f"{tmp_path}/none"]) == [f"{tmp_path}/none"]


def test_trees_are_listed_in_parts(tmp_path, monkeypatch):
    monkeypatch.setattr(allfiles, "OPENED", 3)
    for i in range(5):
        tree(tmp_path / f"d{i}")
    reader = allfiles._Reader({"paths": json.dumps([f"{tmp_path}/d0/.env", str(tmp_path), f"{tmp_path}/d1"]), "exclude": '["*.lock"]', "max_size": "4000"})
    parts = reader.partitions()
    listed = [row for p in parts for row in reader.read(p)]
    assert len(parts) > 4 and set(listed) == set(collect_files([str(tmp_path)], ["*.lock"], 4000))


def test_scan(spark, tmp_path):
    tree(tmp_path)
    results = scan_contents(read_files(spark, [str(tmp_path)], ["*.lock"]), load("file_scan"))
    rows = {os.path.basename(r.path): r for r in report(results).collect()}
    assert {n: r.status for n, r in rows.items()} == {
        ".env": "findings", "x.txt": "findings", "latin.bin": "findings", "z.js": "findings", "clean.txt": "clean", "big.txt": "clean", "empty": "clean",
    }
    assert rows[".env"].findings[0].asDict() == {"type": "full_content_redacted", "reason": "Entire content was redacted", "original_length": 38, "profile": "file_scan"}
    assert summary(results).first().asDict() == {"files_scanned": 7, "files_with_findings": 4}
    large = from_config({"strategies": ["large_string"], "max_value_length": 4000}, "x")
    count = lambda compat: summary(scan_contents(read_files(spark, [str(tmp_path)]), large, compat=compat)).first().files_with_findings
    assert count(False) == 1 and count(True) == 0


def test_reports(spark):
    df = spark.createDataFrame([("p" * 70, None), ("short", bytearray(b"a@b.co"))], "path string, content binary")
    results = scan_contents(df, load("file_scan"))
    assert {tuple(r) for r in status_table(results).collect()} == {("SKIPPED", "-", "..." + "p" * 57), ("FINDINGS", "1", "short")}
    assert {(r.status, r.error) for r in report(results).collect()} == {("skipped", "File unreadable"), ("findings", None)}
    docs = spark.createDataFrame([("a", '{"password":1,"x":{"password":2,"pin":3}}'), ("b", '{"x":1}')], "path string, doc string")
    found = {r.path: [f.type for f in r.findings] for r in scan_documents(docs, from_config({"strategies": ["blocked_keys"], "blocked_keys": ["password", "pin"], "track_redacted_keys": True}), "path", "doc").collect()}
    assert found == {"a": ["password", "pin"], "b": []}


def test_command(spark, tmp_path, capsys):
    tree(tmp_path)
    assert main([str(tmp_path), f"{tmp_path}/none", "--bail", "--output", "json"], spark) == 1
    out = capsys.readouterr().out
    assert f"Path not found or not accessible: {tmp_path}/none" in out and "Files with findings: 4" in out
    rows = json.loads(out[out.index("[\n") : out.rindex("]") + 1])
    assert set(rows[0]) == {"path", "status", "findings_count", "findings", "profile", "error"}
    assert main([f"{tmp_path}/clean.txt", "--bail", "--summary-only"], spark) == 0 and "| Status" not in capsys.readouterr().out
    assert main([f"{tmp_path}/clean.txt"], spark) == 0 and "| CLEAN" in capsys.readouterr().out
    assert main([str(tmp_path), "--profile", "nope"], spark) == 2


RECORDS = "select timestamp'2023-12-25 14:30:45.123456' datetime, 'app' channel, 'INFO' level, {message} message, {context} context"


def line(spark, message, context, profile="default"):
    return log_lines(spark.sql(RECORDS.format(message=message, context=context)), load(profile)).first().line


def test_log_lines(spark):
    head = "[2023-12-25 14:30:45.123456] app.INFO: "
    assert line(spark, "'User logged in successfully'", "'{}'") == head + "User logged in successfully\n"
    assert line(spark, "'x'", "cast(null as string)") == head + "x\n"
    assert line(spark, "'mail a@b.co'", "named_struct('user_id', cast(null as int), 'action', 'a/b')") == head + '[REDACTED] {"user_id":null,"action":"a/b"}\n'
    assert line(spark, "'x'", "map('password', 'p', 'n', 'é')") == head + 'x {"password":"[REDACTED]","n":"\\u00e9","_redacted":true}\n'
    two = spark.sql(RECORDS.format(message="'a'", context="'{}'")).union(spark.sql(RECORDS.format(message="'b'", context="'{}'")))
    assert batch_lines(two, load("default"), first_only=True).count() == 1 and batch_lines(two, load("default")).count() == 2


def test_stream(spark, tmp_path):
    spark.sql(RECORDS.format(message="'a@b.co'", context="'{}'")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    seen = []
    writer = tap(stream, load("default"), lambda batch, n: seen.extend(r.line for r in batch.collect()))
    writer.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert seen == ["[2023-12-25 14:30:45.123456] app.INFO: [REDACTED]\n"]


def test_sql_functions(spark):
    register(spark, load("strict"))
    row = spark.sql("select byte_entropy('abcd') e, is_common_pattern('http://x') c, key_blocked('MY_TOKEN') k, mask_text('a@b.co') t, mask_json('{\"pin\":1}') j, mask_text(null) n").first()
    assert (row.e, row.c, row.k, row.t, row.n) == (2.0, True, True, "[REDACTED]", None) and json.loads(row.j)["pin"] == "[REDACTED]"
    hits = spark.createDataFrame([("a@b.co 1.2.3.4",)], "t string").select(pattern_hits(F.col("t"), load("strict"))).first()[0]
    assert "email" in hits and "ipv4" in hits and "uuid" not in hits


def test_file_source_reads_every_file(spark, tmp_path):
    sizes = {"small.parquet": 10, "above_a_mebibyte.parquet": (1 << 20) + 1, "above_the_scan_limit.parquet": 10_485_761}
    for name, n in sizes.items():
        (tmp_path / name).write_bytes(bytes(n))
    rows = file_source(spark, str(tmp_path)).collect()
    assert {r.name: (r.length, r.sha256) for r in rows} == {name: (n, hashlib.sha256(bytes(n)).hexdigest()) for name, n in sizes.items()}


def test_a_large_file_is_digested_in_blocks(spark, tmp_path):
    """A file source's task holds a block of a file, not the file: one beyond 2 GB fits no cell."""
    with open(tmp_path / "large", "wb") as f:
        f.truncate((2 << 30) + 5)
    (tmp_path / "empty").write_bytes(b"")
    want = hashlib.sha256()
    for _ in range(2048):
        want.update(bytes(1 << 20))
    want.update(bytes(5))
    got = {r.name: (r.length, r.sha256) for r in file_source(spark, str(tmp_path)).collect()}
    assert got == {"large": ((2 << 30) + 5, want.hexdigest()), "empty": (0, hashlib.sha256(b"").hexdigest())}
