import io
import json

from trigrove import cli
from trigrove.operators.engine import Engine
from trigrove.plans import compiler
from trigrove.plans.parser import parse_query
from trigrove.plans.planner import plan, rewrite
from trigrove.streaming.ingest import matching


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a").write_bytes(b"needle in hay")
    root = (tmp_path / "db").as_uri()
    assert cli.main([root, "--new"]) == 0
    assert cli.main([root, "-c", f'index "{tmp_path / "files"}"']) == 0
    assert cli.main([root, "-c", 'select "needle"']) == 0
    assert capsys.readouterr().out.strip().endswith("/files/a")
    assert cli.main([root, "--json", "-c", "nonsense"]) == 1
    assert json.loads(capsys.readouterr().out)["type"] == "error"
    assert cli.main([root, "--compact", "all", "--trim"]) == 0
    assert cli.main([root, "--bench", "3", "--bench-bytes", "2000"]) == 0
    assert capsys.readouterr().out.count(" ms") == 3
    monkeypatch.setattr("sys.stdin", io.StringIO('select "needle" & "hay";\n\nping\n'))
    assert cli.main([root]) == 0
    out = capsys.readouterr().out
    assert "/files/a" in out and '"status": "ok"' in out


def test_explain_and_standing_query(spark, tmp_path):
    engine = Engine(spark, (tmp_path / "db").as_uri())
    assert engine.explain(parse_query('"abcd"'), ["gram3"]) == "and(1_616263, 1_626364)"
    docs = spark.createDataFrame([("x", bytearray(b"abcd")), ("y", bytearray(b"abc"))], "path string, content binary")
    tree = rewrite(plan(parse_query('"abcd"'), ["gram3", "text4"]))
    assert [r["path"] for r in matching(docs, compiler.scan_condition(tree, docs["content"])).collect()] == ["x"]
    assert compiler.scan_condition(rewrite(plan(parse_query('"abcd"'), ["hash4"])), docs["content"]) is None
