"""Index, search and CLI end to end, symbol attachment, the stream, the registry, and the subpackage's independence."""

import json
import pathlib
import subprocess
import sys

import pytest

from intentlake import cli
from intentlake.functions.encoders import HashEncoder
from intentlake.operators import index
from intentlake.operators.index import Index, IndexParams
from intentlake.streaming.ingest import index_stream, latest_version

REPO = pathlib.Path(__file__).parent.parent


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "reader.py").write_text("class Reader:\n    def open_index(self, path):\n        return load(path)\n\n\ndef unrelated():\n    pass\n")
    (tmp_path / "src" / "store.go").write_text("package store\n\nfunc SaveIndex(path string) error {\n\treturn nil\n}\n")
    (tmp_path / "src.py").write_text("x = 1\n")
    (tmp_path / "notes.md").write_text("# Notes\n\nHow to open an index.\n")
    (tmp_path / "blank.rs").write_text("\n\n")
    return tmp_path


def test_search(spark, tree):
    found = Index.from_path(spark, str(tree), HashEncoder()).persist()
    assert [(r.file_path, r.chunk_no) for r in found.chunks.collect()] == [("src/reader.py", 0), ("src/store.go", 0), ("src.py", 0)]
    best = found.search("open_index").collect()
    assert best[0].chunk.file_path == "src/reader.py" and best[0].location == "src/reader.py:1-7"
    assert [m.line for m in best[0].match_lines] == [2] and best[0].score > best[1].score
    assert {r.chunk.file_path for r in found.search("index", languages=["go"]).collect()} == {"src/store.go"}
    assert found.search("index", languages=["cobol"]).count() == 3 and found.search("  ").count() == 0 and found.search("x", 0).count() == 0
    stats = found.stats().first()
    assert (stats.indexed_files, stats.total_chunks, stats.languages) == (3, 3, {"python": 2, "go": 1})
    assert {r.file_path: list(r.chunks) for r in found.file_mapping().collect()}["src.py"] == [0] and found.language_mapping().count() == 2
    found.save(str(tree / "saved"))
    assert Index.load(spark, str(tree / "saved"), HashEncoder()).search("SaveIndex").first().chunk.file_path == "src/store.go"
    rows = json.loads(index.result_json(found.search("open_index", 2)))
    assert list(rows[0]) == ["chunk", "score", "match_lines"] and list(rows[0]["chunk"]) == ["content", "file_path", "start_line", "end_line", "language"]
    assert index.result_json(found.search("")) == "[]" and "match_lines" not in json.loads(index.result_json(found.search("zz qq", 1)))[0]


def test_options_and_errors(spark, tree):
    every = Index.from_path(spark, str(tree), HashEncoder(), text_files=True, params=IndexParams(chunk_size=20))
    assert "notes.md" in {r.file_path for r in every.chunks.collect()} and every.chunks.count() > 4
    with pytest.raises(ValueError, match="No supported files"):
        Index.from_path(spark, str(tree), HashEncoder(), extensions=[".hs"])
    with pytest.raises(ValueError, match="does not exist"):
        Index.from_path(spark, str(tree / "none"), HashEncoder())
    with pytest.raises(ValueError, match="at least 1"):
        IndexParams(chunk_size=0)


def test_command_line(spark, tree, capsys):
    assert cli.main(["search", "SaveIndex", str(tree), "-k", "1"], spark) == 0
    assert json.loads(capsys.readouterr().out)[0]["chunk"]["file_path"] == "src/store.go"
    assert cli.main(["search", " ", str(tree)], spark) == 0 and capsys.readouterr().out.strip() == "[]"
    for bad in (["--candidates", "0"], ["--chunk-size", "0"], ["--model", "no/such-model"]):
        assert cli.main(["search", "x", str(tree), *bad], spark) == 1
    assert cli.main(["search", "x", str(tree / "none")], spark) == 1
    assert "must be at least 1" in capsys.readouterr().err


def test_symbols_on_lines(spark):
    chunks = spark.createDataFrame([("f", 0, 1, 5, ["old"]), ("f", 1, 5, 9, []), ("g", 0, 1, 9, None), (None, 0, 1, 9, [])], "file_path string, chunk_no int, start_line int, end_line int, symbols array<string>")
    symbols = spark.createDataFrame([("f", "b", 5), ("f", "a", 2), ("f", "a", 3), ("f", "z", 99), (None, "n", 2)], "file_path string, name string, line int")
    got = {(r.file_path, r.chunk_no): r.symbols for r in index.attach_symbols(chunks, symbols).collect()}
    assert got == {("f", 0): ["a", "a", "b"], ("f", 1): ["b"], ("g", 0): [], (None, 0): []}
    assert index.attach_symbols(chunks, symbols.limit(0)).count() == 4


def test_files_without_text(spark):
    files = spark.createDataFrame([("a.py", "python", None), ("b.py", "python", " "), ("c.py", None, "def f():\n    pass\n"), ("d.py", "python", "def f():\n    pass\n")], "file_path string, language string, source string")
    got = index.chunk_files(files).collect()
    assert [(r.file_path, r.symbols) for r in got] == [("c.py", []), ("d.py", ["f"])]
    assert index.symbols_of(files).count() == 1 and index.chunk_files(files.limit(0)).count() == 0
    assert index.index_stats(index.chunk_files(files.limit(0))).first()[:2] == (0, 0)


def test_stream(spark, tmp_path):
    schema = "file_path string, language string, source string, loaded_at timestamp"
    at = lambda n: f"2026-01-0{n} 00:00:00"
    for n, text in ((1, "def old():\n    pass\n"), (2, "def new():\n    pass\n")):
        spark.createDataFrame([("a.py", "python", text, at(n)), ("a.py", "python", "x = 0\n", at(n - 1) if n > 1 else None)], "file_path string, language string, source string, loaded_at string").selectExpr("file_path", "language", "source", "cast(loaded_at as timestamp) loaded_at").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = index_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), HashEncoder(), str(tmp_path / "index"), str(tmp_path / "state"))
        assert query.awaitTermination(120)
    stored = spark.read.parquet(str(tmp_path / "index"))
    assert stored.count() == 2 and [r.symbols for r in latest_version(stored).collect()] == [["new"]]


def test_registry(spark):
    sys.path.insert(0, str(REPO))
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 30
    rows = entry.entry(spark).collect()
    assert len(rows) == 10 and [r.place for r in sorted(rows, key=lambda r: r.place)] == list(range(1, 11))


def test_nothing_outside_imports_the_llm_subpackage():
    for path in (REPO / "intentlake").rglob("*.py"):
        if "llm" not in path.relative_to(REPO).parts:
            assert "intentlake.llm" not in path.read_text()
    code = "import sys; sys.modules['intentlake.llm'] = None; import __spark_entry__ as e; assert e.llm is None and e.queries() and e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=REPO).returncode == 0
