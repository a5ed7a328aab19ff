"""Outlines, packing, plain text splitting, symbols."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from intentlake.functions.outline import STRUCTURED, masked, outline
from intentlake.functions.packing import CODE_LEVELS, Measure, chunk_source, merged, split_text
from intentlake.functions.symbols import extract_symbols


def body(n, line):
    return "\n".join(line.format(i=i) for i in range(n))


def rust(name, n):
    return f"fn {name}() {{\n" + body(n, "    let value_{i} = compute({i});") + "\n}\n"


def test_small_file_is_one_chunk():
    source = "use std::io;\n\nfn read() {}\n\nstruct Index {\n    n: u8,\n}\n"
    chunks = chunk_source(source, "rust")
    assert len(chunks) == 1 and all(x in chunks[0].content for x in ("use std", "fn read", "struct Index"))
    assert (chunks[0].start_line, chunks[0].end_line) == (1, 7)


@pytest.mark.parametrize("n", [80, 100])
def test_large_functions_are_apart(n):
    source = "\n".join(rust(f"part_{k}", n) for k in range(3))
    chunks = chunk_source(source, "rust")
    assert len(chunks) >= 2
    whole = "".join(c.content for c in chunks)
    assert all(f"fn part_{k}" in whole for k in range(3)) and not any(all(f"fn part_{k}" in c.content for k in range(3)) for c in chunks)


CASES = {
    "python": ("import os\n\nclass Reader:\n" + body(100, "    def get_{i}(self):\n        return {i}") + "\n\ndef main():\n" + body(100, "    print({i})") + "\n", ["class Reader", "def main"], 2),
    "javascript": ("const a = 1;\nfunction read(x) {\n  return { y: x };\n}\nclass Index {\n  get(k) { return k; }\n}\n", ["function read", "class Index"], 1),
    "typescript": ("export interface A {\n  x: number;\n}\nexport const f = (a: A): number => {\n  return a.x;\n};\n", ["interface A", "const f"], 1),
    "go": ('package a\n\nimport "fmt"\n\nfunc One() {\n\tfmt.Println("}")\n}\n\nfunc Two() int {\n\treturn 2\n}\n', ["func One", "func Two"], 1),
    "java": ("class A {\n" + body(120, "  int f{i}() {{ return {i}; }}") + "\n}\n", ["class A", "f119"], 2),
    "c": ("#include <a.h>\n#define X {\nstruct s { int a; };\nint f(void) {\n" + body(260, "  g({i});") + "\n}\n", ["#include", "struct s", "int f"], 2),
    "cpp": ("namespace n {\nclass A {\n public:\n  void f();\n};\n}\n", ["namespace n"], 1),
    "ruby": ("class A\n  def f\n    if x\n      1\n    end\n  end\nend\n\nmodule M\nend\n\ndef g\n" + body(260, "  call({i})") + "\nend\n", ["class A", "module M", "def g"], 2),
    "php": ("<?php\nnamespace App;\nclass A {\n  function f() { return 1; }\n}\nfunction g() {\n  return 'x;{';\n}\n", ["class A", "function g"], 1),
    "swift": ("import Foo\nstruct S {\n  let a: Int\n}\nclass C {\n  func m() {}\n}\nfunc f() {}\n", ["struct S", "class C", "func f"], 1),
}


@pytest.mark.parametrize("language", sorted(CASES))
def test_languages(language):
    source, parts, least = CASES[language]
    chunks = chunk_source(source, language)
    whole = "\n".join(c.content for c in chunks)
    assert len(chunks) >= least and all(p in whole for p in parts)
    assert "".join(whole.split()) == "".join(source.split())
    lines = source.split("\n")
    for c in chunks:
        assert 1 <= c.start_line <= c.end_line and c.content.split("\n")[0].strip() in lines[c.start_line - 1] and c.content.split("\n")[-1].strip() in lines[c.end_line - 1]
    assert all(len(c.content.encode()) <= 2250 for c in chunks)


def test_unknown_languages_are_split_as_text():
    assert [c.content for c in chunk_source("one\ntwo\nthree\n", None)] == ["one\ntwo\nthree"]
    assert len(chunk_source("word " * 1000, "haskell", 100)) >= 50


def test_blank_and_null():
    assert chunk_source(None) == [] and chunk_source(" \n\t\n", "python") == [] and chunk_source("", "rust") == []
    assert [c.content for c in chunk_source("{", "rust")] == ["{"]
    assert chunk_source("}}}} x", "c") and chunk_source("((((", "go") and chunk_source('"open', "java")


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab é.;\n\t{}()#\"'/*:", max_size=300), st.sampled_from(sorted(STRUCTURED)), st.integers(5, 60))
def test_any_text_is_chunked_in_order(source, language, size):
    chunks = chunk_source(source, language, size)
    assert bool(chunks) == bool(source.strip())
    at = 0
    for c in chunks:
        at = source.index(c.content, at)
    assert all(a.start_line <= b.start_line for a, b in zip(chunks, chunks[1:]))
    assert len(masked(source, language)) == len(source) and masked(source, language).count("\n") == source.count("\n")
    extract_symbols(source, language)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab .!\n ß", max_size=200), st.integers(1, 40))
def test_plain_pieces(text, budget):
    pieces = split_text(text, budget)
    assert all(0 < b - a <= budget and text[a:b] == text[a:b].strip() for a, b in pieces)
    assert all(x[1] <= y[0] for x, y in zip(pieces, pieces[1:]))
    assert "".join("".join(text[a:b].split()) for a, b in pieces) == "".join(text.split())


def test_comments_travel_with_what_follows():
    source = "fn a() {\n" + body(40, "    x({i});") + "\n}\n\n// reads the index\nfn b() {\n" + body(40, "    y({i});") + "\n}\n"
    chunks = chunk_source(source, "rust", 500)
    holder = [c for c in chunks if "fn b" in c.content][0]
    assert holder.content.startswith("// reads the index")


def test_small_spans_are_merged():
    measure = Measure.of("a" * 100)
    assert merged([(0, 5), (5, 40), (40, 80), (80, 82)], measure, 50) == [(0, 40), (40, 82)]
    assert merged([(0, 40), (40, 80)], measure, 50) == [(0, 40), (40, 80)]
    measure = Measure.of("// note\n" + "x" * 60)
    assert merged([(0, 7), (8, 68)], measure, 30) == [(0, 7), (8, 68)]  # over the cap
    assert merged([(0, 7), (8, 68)], measure, 50) == [(0, 68)]
    assert merged([], measure, 50) == []


def test_sizes_are_bytes_along_an_outline():
    measure = Measure.of("é" * 10)
    assert measure.size(0, 10) == 20 and measure.line(5) == 1


def test_long_statements_are_cut_at_signs_of_code():
    text = "call(" + ", ".join(f"argument_{i}" for i in range(60)) + ");"
    pieces = [text[a:b] for a, b in split_text(text, 100, CODE_LEVELS)]
    assert all(p.endswith((",", ";")) for p in pieces) and all(len(p) <= 100 for p in pieces)


ODD = {
    "nested braces": ("c", "{" * 50_000 + "}" * 50_000),
    "nested and open": ("java", "class A {" + "{" * 50_000),
    "brackets": ("javascript", "f(" * 50_000),
    "ampersands": ("c", "&" * 100_000 + "\n" + "a & " * 30_000),
    "impls": ("rust", "impl A {\n" * 30_000),
    "raw strings": ("rust", 'r#"' * 100_000),
    "blank lines": ("typescript", "\n" * 300_000),
    "annotations": ("java", "@a(\n" * 50_000),
    "typedefs": ("c", "typedef int " * 30_000),
    "types": ("rust", "type a " * 50_000),
    "lets": ("swift", "a b c d " * 40_000 + "\n" + "a\n" * 50_000),
    "braces too many": ("go", "}\n" * 100_000),
    "calls": ("c", "int f(int a(" * 30_000),
    "consts": ("javascript", "const a=(" * 40_000),
    "stars": ("javascript", "function" + " " * 200_000 + "x"),
    "indents": ("python", "".join(" " * i + "if x:\n" for i in range(1500))),
    "comments": ("ruby", "# a\n" * 50_000 + "=begin\n" * 50_000),
    "values": ("javascript", "x = " + "{} + " * 40_000),
    "words": ("java", "public " * 60_000),
    "members": ("cpp", "a::" * 60_000),
    "dots": ("javascript", "\n" + "a." * 100_000),
}


@pytest.mark.parametrize("case", sorted(ODD))
def test_odd_sources_take_linear_time(case):
    language, source = ODD[case]
    began = time.perf_counter()
    chunk_source(source, language)
    extract_symbols(source, language)
    assert time.perf_counter() - began < 4


def test_outline_kinds():
    nodes = outline("# note\nx = 1\ndef f():\n    return 1\n", "python")
    assert [n.kind for n in nodes] == ["comment", "item", "item"] and len(nodes[2].children) == 2


SYMBOLS = {
    "rust": ("pub fn free() {}\nstruct S;\nenum E { A }\nimpl S {\n    fn m(&self) {}\n}\ntrait T {\n    fn t();\n}\nmod inner {}\nmacro_rules! mac { () => {} }\ntype A = u8;\n// fn no() {}\n", {("free", "function"), ("S", "class"), ("E", "class"), ("m", "method"), ("T", "interface"), ("t", "method"), ("inner", "module"), ("mac", "macro"), ("A", "class")}),
    "python": ("LIMIT = 3\nclass A(B):\n    def m(self):\n        x = 1\ndef f():\n    '''def no(): pass'''\n", {("LIMIT", "constant"), ("A", "class"), ("m", "function"), ("f", "function")}),
    "javascript": ("class A {\n  constructor() {}\n  m(x) {\n    if (x) {\n    }\n  }\n}\nfunction f() {}\nconst g = (a) => a;\nlet h = function () {};\na.b = () => 1;\nconst o = { k: function () {} };\n", {("A", "class"), ("m", "method"), ("f", "function"), ("g", "function"), ("h", "function"), ("b", "function"), ("k", "function")}),
    "typescript": ("export async function load(): Promise<void> {}\nexport const pick = (a: string): string => a;\nexport interface Row { id: number }\nabstract class B {\n  abstract run(): void;\n}\nnamespace N {}\n", {("load", "function"), ("pick", "function"), ("Row", "interface"), ("B", "class"), ("run", "method"), ("N", "module")}),
    "go": ("package a\n\nfunc F() {}\n\nfunc (r *R) M(x int) {}\n\ntype R struct {\n}\n", {("F", "function"), ("M", "method"), ("R", "type")}),
    "java": ("class A {\n  private int n;\n  A() { }\n  public static int f(int a) { return g(a); }\n}\ninterface I {\n  void h();\n}\n", {("A", "class"), ("f", "method"), ("I", "interface"), ("h", "method")}),
    "c": ("struct s { int a; };\ntypedef int num;\nenum e { X };\nstatic int f(int a) {\n  return g(a);\n}\nvoid proto(void);\n", {("s", "class"), ("num", "type"), ("e", "type"), ("f", "function"), ("proto", "function")}),
    "cpp": ("class A {\n};\nvoid A::run() {\n}\n", {("A", "class"), ("run", "method")}),
    "ruby": ("module M\n  class A < B\n    def f?; end\n    def self.g\n    end\n    alias h f\n  end\nend\n", {("M", "module"), ("A", "class"), ("f?", "method"), ("g", "method"), ("h", "method")}),
    "php": ("<?php\nnamespace App\\Core;\ninterface I {}\ntrait T {}\nclass A {\n  private int $n;\n  public function m() {}\n}\nfunction f() {}\n", {("App\\Core", "module"), ("I", "interface"), ("T", "interface"), ("A", "class"), ("n", "field"), ("m", "function"), ("f", "function")}),
    "swift": ("protocol P {}\nstruct S {\n  let a: Int\n  func m() {}\n}\nfunc f() {}\n", {("P", "interface"), ("S", "class"), ("m", "method"), ("f", "function")}),
}


@pytest.mark.parametrize("language", sorted(SYMBOLS))
def test_symbols(language):
    source, wanted = SYMBOLS[language]
    found = extract_symbols(source, language)
    assert wanted <= {(n, k) for n, k, _ in found}
    assert not {"no", "if", "constructor"} & {n for n, _, _ in found}
    lines = source.split("\n")
    assert all(n.split("\\")[-1] in lines[line - 1] for n, _, line in found) and [x[2] for x in found] == sorted(x[2] for x in found)


def test_no_symbols():
    assert extract_symbols("fun main() {}", "kotlin") == [] and extract_symbols(None, "rust") == [] and extract_symbols("fn f() {}", None) == []
