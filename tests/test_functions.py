"""Text and vector expressions, encoders and model folders."""

import json
import os
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from intentlake.functions import encoders, packing, text, vectors


def one(spark, column, *values, schema):
    return spark.createDataFrame([values], schema).select(column).first()[0]


@pytest.mark.parametrize(
    ("query", "symbol", "tail", "names"),
    [
        ("main", False, "main", []), ("Main", True, "Main", ["Main"]), ("_x", True, "_x", ["_x"]), ("parse_file", True, "parse_file", ["parse_file"]), ("a.b", True, "b", ["a.b", "b"]), ("a::b.c", True, "b.c", ["a::b.c", "b.c"]),
        ("ns\\Thing", True, "Thing", ["Thing", "ns\\Thing"]), ("p->next", True, "next", ["next", "p->next"]), ("find getUserById in FooBar", False, "find getUserById in FooBar", ["FooBar", "getUserById"]), (" Trimmed ", True, "Trimmed", ["Trimmed"]),
        ("", False, "", []), ("HTTPServer fooB", False, "HTTPServer fooB", []), ("Main\n", True, "Main", ["Main"]), ("two words", False, "two words", []),
    ],
)
def test_queries(spark, query, symbol, tail, names):
    q = F.col("q")
    row = spark.createDataFrame([(query,)], "q string").select(text.is_symbol_query(q), text.symbol_tail(q), text.query_names(q)).first()
    assert tuple(row) == (symbol, tail, names)


@pytest.mark.parametrize(
    ("value", "doc"),
    [("// one", True), ("# a\n# b", True), ("/* a */", True), ("* x", True), ('"""x"""', True), ("'''x'''", True), ("// a\n// b\n// c", False), ("// a: b", False), ("// a; b", False), ("// a-b", False), ("code", False), ("// a\ncode", False), ("", False), (" \n ", False), ("// a\r\n// b\n", True)],
)
def test_doc_comments(spark, value, doc):
    assert one(spark, text.is_doc_comment(F.col("t")), value, schema="t string") is doc
    assert bool(packing.BRIEF.match(value)) is doc


def test_match_lines(spark):
    def found(content, query, start=1):
        rows = one(spark, text.match_lines(F.col("c"), F.col("s"), F.col("q")), content, start, query, schema="c string, s bigint, q string")
        return None if rows is None else [tuple(r) for r in rows]

    assert found("  Foo = 1\r\nbar\n\nfoobar()\n", "FOO x", 10) == [(10, "Foo = 1"), (13, "foobar()")]
    assert found("a\nb", "a b") == []  # words of one byte don't count
    assert found("café é\nx", "é") == [(1, "café é")]  # two bytes do
    assert found("x (y),", "y),") == [(1, "x (y),")]
    assert found("x", "  \t  ") == [] and found("", "ab") == [] and found(None, "ab") is None


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abé \n\r\t", max_size=40), st.text(alphabet="ABé ", max_size=8)), min_size=1, max_size=20))
def test_match_lines_against_a_model(spark, cases):
    def model(content, query):
        words = [w for w in query.lower().split() if len(w.encode()) >= 2]
        lines = content.replace("\r\n", "\n").split("\n")
        return [(i, x.strip(" \n\r\t")) for i, x in enumerate(lines, 1) if any(w in x.lower() for w in words)]

    df = spark.createDataFrame([(i, c, q) for i, (c, q) in enumerate(cases)], "i int, c string, q string")
    got = {r.i: [tuple(m) for m in r.m] for r in df.select("i", text.match_lines(F.col("c"), F.lit(1), F.col("q")).alias("m")).collect()}
    assert got == {i: model(c, q) for i, (c, q) in enumerate(cases)}


def test_lines_and_locations(spark):
    for offset, line in ((0, 1), (2, 1), (3, 2), (4, 3), (7, 3)):
        assert one(spark, text.line_at(F.col("t"), F.col("o")), "ab\n\ncéd", offset, schema="t string, o int") == line
    assert one(spark, text.location(F.lit("a/b.py"), F.lit(3), F.lit(9)), 1, schema="x int") == "a/b.py:3-9"
    assert one(spark, text.trimmed(F.col("t")), "\t x  \n", schema="t string") == "x"
    assert one(spark, text.is_blank(F.col("t")), "  \n", schema="t string") is True


def test_vectors(spark):
    v, w = F.col("v"), F.col("w")
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "v array<float>, w array<double>")
    rows = df.select(vectors.norm(v), vectors.cosine(v, w), vectors.normalized(v)).collect()
    assert rows[0][0] == 5 and rows[0][1] == pytest.approx(0.96) and rows[0][2] == pytest.approx([0.6, 0.8])
    assert rows[1][1] == 0 and rows[1][2] == [0, 0] and rows[2][0] is None and rows[2][1] is None


def test_hash_encoder(spark):
    encoder = encoders.HashEncoder(16)
    df = spark.createDataFrame([(1, "Read the index, read!"), (2, ""), (3, None), (4, "éè")], "id int, t string")
    rows = {r.id: r.embedding for r in encoder.encode(df, "t").collect()}
    assert rows[1] == pytest.approx(encoder.encode_one("read THE index read")) and np.linalg.norm(rows[1]) == pytest.approx(1)
    assert rows[2] == rows[3] == rows[4] == [0.0] * 16
    bucket = one(spark, encoder.bucket(F.col("w").cast("binary")), "read", schema="w string")
    assert rows[1][bucket] == max(rows[1])
    shown = encoders.ColumnEncoder("v").encode(spark.createDataFrame([([3.0, 4.0],)], "v array<double>"), "t").first()
    assert shown.embedding == pytest.approx([0.6, 0.8])


def model(folder, dim=4):
    os.makedirs(folder)
    table = np.arange(5 * dim, dtype="<f4").reshape(5, dim)
    header = json.dumps({"embeddings": {"dtype": "F32", "shape": [5, dim], "data_offsets": [0, table.nbytes]}}).encode()
    with open(f"{folder}/model.safetensors", "wb") as f:
        f.write(struct.pack("<Q", len(header)) + header + table.tobytes())
    with open(f"{folder}/config.json", "w") as f:
        f.write("{}")
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.WordLevel({"[UNK]": 0, "read": 1, "index": 2, "chunk": 3, "a": 4}, unk_token="[UNK]"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    t.save(f"{folder}/tokenizer.json")
    return table


def test_model_resolution(tmp_path):
    hub = tmp_path / "hub"
    model(str(hub / "models--o--m" / "snapshots" / "old"))
    model(str(hub / "models--o--m" / "snapshots" / "new"))
    os.makedirs(hub / "models--o--m" / "snapshots" / "broken")
    os.utime(hub / "models--o--m" / "snapshots" / "old", (1, 1))
    own = tmp_path / "own"
    model(str(own))
    env = {"HF_HUB_CACHE": str(hub)}
    assert encoders.resolve_model("o/m", env).endswith("new")
    assert encoders.resolve_model("o/m", env | {encoders.MODEL_VARIABLE: str(own)}) == str(own)
    assert encoders.resolve_model("o/m", env | {encoders.MODEL_VARIABLE: str(tmp_path)}).endswith("new")
    assert encoders.resolve_model(str(tmp_path), env) == str(tmp_path)  # a folder wins unseen
    with pytest.raises(FileNotFoundError, match="not found locally"):
        encoders.resolve_model("o/other", env)
    assert encoders.cache_roots({"HF_HOME": "/h", "HOME": "/u"}) == ["/h/hub", "/u/.cache/huggingface/hub"]


def test_static_model_encoder(spark, tmp_path):
    table = model(str(tmp_path / "m"))
    encoder = encoders.StaticModelEncoder(str(tmp_path / "m"))
    mean = (table[1] + table[2]) / 2
    rows = [r.embedding for r in encoder.encode(spark.createDataFrame([("read index zzz",), ("zzz",), (None,)], "t string"), "t").collect()]
    assert rows[0] == pytest.approx(list(mean / np.linalg.norm(mean)), rel=1e-5) and rows[1] == rows[2] == [0.0] * 4
    assert encoder.encode_one("read index") == pytest.approx(rows[0]) and encoder.dim == 4
    with pytest.raises(ValueError, match="too large"):
        encoders.StaticModelEncoder(str(tmp_path / "m"), most_bytes=1)


def test_static_model_pools_the_whole_text(tmp_path):
    table = model(str(tmp_path / "m"))
    text = "read " * 600 + "index " * 600
    mean = (table[1] + table[2]) / 2
    assert encoders.StaticModelEncoder(str(tmp_path / "m")).encode_one(text) == pytest.approx(list(mean / np.linalg.norm(mean)), rel=1e-5)
    assert encoders.StaticModelEncoder(str(tmp_path / "m"), most_tokens=512).encode_one(text) == pytest.approx(list(table[1] / np.linalg.norm(table[1])), rel=1e-5)
