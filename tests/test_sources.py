"""Paths, ignore files and the folder source."""

import os

import pytest
from pyspark.sql import functions as F

from intentlake.sources import filetree, gitignore, paths


@pytest.mark.parametrize("name", ["lib.min.js", "a/style.MIN.css", "app.bundle.js", "x.bundle.css", "jquery-min.js", "m.min.mjs", "core.prod.js"])
def test_minified_names(name):
    assert paths.minified_name(name)


@pytest.mark.parametrize("name", ["app.js", "src/minify.rs", "admin.ts", "a.min.js/b.js"])
def test_ordinary_names(name):
    assert not paths.minified_name(name)


def test_extension_sets():
    assert len(paths.LANGUAGE_OF) == 40 and len(set(paths.LANGUAGE_OF.values())) == 29 and len(paths.DOCUMENT_TYPES) == 5
    assert ".md" not in paths.extensions() and ".md" in paths.extensions(text_files=True)
    assert paths.extensions(["PY", ".x"], True) == [".x", "PY"]  # word for word
    assert paths.language_for_path("a/B.PY") == "python" and paths.language_for_path("Makefile") is None
    assert paths.extension_of(".sh") == "" and paths.extension_of("a/.py") == "" and paths.extension_of("x.tar.gz") == ".gz"


def test_path_columns(spark):
    rows = [("./src/App.TSX",), ("a\\b\\c.py",), (".py",), ("dir/.sh",), ("node_modules/x.js",), ("src/build",), ("x.min.js",), ("no_ext",), (None,)]
    df = spark.createDataFrame(rows, "file_path string").select("file_path", paths.slashes(F.col("file_path")).alias("p"))
    got = df.select("p", paths.extension(F.col("p")), paths.language(F.col("p")), paths.is_minified(F.col("p")), paths.is_ignored(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [
        ("src/App.TSX", ".tsx", "typescript", False, False), ("a/b/c.py", ".py", "python", False, False), (".py", "", None, False, False), ("dir/.sh", "", None, False, False), ("node_modules/x.js", ".js", "javascript", False, True),
        ("src/build", "", None, False, True), ("x.min.js", ".js", "javascript", True, False), ("no_ext", "", None, False, False), (None, None, None, None, None),
    ]
    joined = paths.with_language(df.withColumn("language", F.lit("clash")).withColumn("ext", F.lit(1)))
    assert joined.count() == len(rows) and joined.where("path_language is not null").count() == 4


def test_admission(spark):
    rows = [("a.py", "x"), ("b.md", "x"), ("dist/a.py", "x"), ("a.min.js", "x"), ("big.py", "xx" * 10), ("edge.py", "x" * 10), ("wide.py", "ß" * 6), ("blank.py", " \n"), ("null.py", None), (None, "x"), ("mine/a.py", "x")]
    files = spark.createDataFrame(rows, "file_path string, source string")
    assert [r.file_path for r in paths.admitted(files, max_bytes=10, ignore=["mine"]).collect()] == ["a.py", "edge.py"]
    assert {r.file_path for r in paths.admitted(files, max_bytes=10, text_files=True).collect()} == {"a.py", "edge.py", "b.md", "mine/a.py"}
    assert paths.admitted(files.limit(0)).count() == 0


def test_walk_order_is_not_string_order(spark):
    names = ["a.py", "a/b.py", "a/B.py", "b.py"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    assert [r.p for r in df.orderBy(paths.walk_key(F.col("p"))).collect()] == ["a/B.py", "a/b.py", "a.py", "b.py"]


@pytest.mark.parametrize(
    ("rules", "path", "folder", "ignored"),
    [
        ("*.log", "a/b.log", False, True), ("*.log\n!keep.log", "x/keep.log", False, False), ("/only.py", "only.py", False, True), ("/only.py", "a/only.py", False, False), ("docs/", "docs", True, True), ("docs/", "docs", False, False),
        ("a/**/z", "a/b/c/z", False, True), ("a/**/z", "a/z", False, True), ("**/tmp", "x/y/tmp", True, True), ("a/**", "a/b/c", False, True), ("a/**", "a", True, False), ("x/*.c", "x/y/z.c", False, False), ("[ab].py", "b.py", False, True),
        ("[!ab].py", "b.py", False, False), ("# note\n\n \nf?o", "foo", False, True), ("\\#x", "#x", False, True), ("\\!x", "!x", False, True), ("a b ", "a b", False, True), ("[", "[", False, True),
    ],
)
def test_gitignore(rules, path, folder, ignored):
    assert gitignore.ignored(path, folder, [("", gitignore.parse(rules))]) is ignored


def test_inner_ignore_files_come_first():
    levels = [("", gitignore.parse("*.py")), ("a", gitignore.parse("!x.py"))]
    assert not gitignore.ignored("a/x.py", False, levels) and gitignore.ignored("a/y.py", False, levels) and gitignore.ignored("x.py", False, levels)


@pytest.fixture
def tree(tmp_path):
    def put(name, data):
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data if isinstance(data, bytes) else data.encode())

    for name in ("__init__.py", ".hidden.py", ".github/x.py", "a/b.py", "a.py", "UP.PY", "dist/no.py", "sub/node_modules/no.js", "x.min.js", "skip.py", "keep/skip.py", "notes.md", "plain.txt"):
        put(name, f"# {name}\nx = 1\n")
    put("latin.py", b"x = '\xe9'\n")
    put("blank.py", " \n")
    put("large.py", "x" * 1_000_001)
    put("exact.py", "x" * 1_000_000)
    put("build", "file")
    put("code/build.py/inner.go", "package a\n")
    put(".gitignore", "skip.py\n")
    put("keep/.gitignore", "!skip.py\n")
    return tmp_path


def test_folder_source(spark, tree):
    names = lambda df: {r.file_path for r in df.select("file_path").collect()}
    every = {"__init__.py", ".hidden.py", ".github/x.py", "a/b.py", "a.py", "UP.PY", "skip.py", "keep/skip.py", "blank.py", "exact.py", "code/build.py/inner.go"}
    assert names(filetree.read_tree(spark, str(tree))) == every  # without .git no ignore file counts
    os.mkdir(tree / ".git")
    assert names(filetree.read_tree(spark, str(tree))) == every - {"skip.py"}
    assert names(filetree.read_tree(spark, str(tree), gitignore=False)) == every
    assert names(filetree.read_tree(spark, str(tree), textFiles=True)) == every - {"skip.py"} | {"notes.md"}
    assert names(filetree.read_tree(spark, str(tree), extensions=[".go"], ignore=["code"])) == set()
    rows = {r.file_path: r for r in filetree.read_tree(spark, str(tree), maxBytes=20).collect()}
    assert rows["a/b.py"].source == "# a/b.py\nx = 1\n" and rows["a/b.py"].language == "python" and rows["a/b.py"].n_bytes == 15 and "exact.py" not in rows


def test_walk_is_sorted_by_names(tree):
    found = [p for p, _ in filetree.walk(str(tree), {".py"}, set(), False)]
    assert found == sorted(found, key=lambda p: [os.fsencode(x) for x in p.split("/")])


def test_bad_roots(tmp_path):
    with pytest.raises(ValueError, match="does not exist"):
        filetree.check_root(str(tmp_path / "none"))
    (tmp_path / "f").write_text("x")
    with pytest.raises(ValueError, match="not a directory"):
        filetree.check_root(str(tmp_path / "f"))
