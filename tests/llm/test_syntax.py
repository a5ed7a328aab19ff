"""Parsers: valid texts with many constructs pass, damaged ones fail, and the operator minds odd rows."""

import ast
import json
import random
import time

import pytest

from intentlake.llm.syntax import PARSERS, Reader, check_files, extension, failure_rates
from pyspark.sql import functions as F

VALID = {
    "python": [
        "import a.b as c\nfrom . import (x, y as z)\n@d(1)\nasync def f(a, /, b: int = 2, *c, d=None, **e) -> 'T':\n    async with g() as h, i:\n        await j\n    return [k for k in l if k if not m], {**n, 'o': 1}, (yield), lambda *p: p[1:2, ::3]\n",
        "class A(B, metaclass=C):\n    x: int = 1\n    def f(self):\n        try:\n            pass\n        except (E, F) as e:\n            raise G from e\n        else:\n            del h[0], i.j\n        finally:\n            global k\nif (n := 10) > 5: print(f'{n!r:>{n}}')\nelif not a is not b not in c: pass\nelse:\n    while 1:\n        break\nmatch x:\n    case [1, *r] if r: pass\n    case {'k': v, **w}: pass\n    case _: pass\nmatch = 1\n",
        "a = b = c, *d = 1, 2\nx **= -1 ** ~2 if y else z @ w\nassert a, 'b' \\\n  'c'\nwith (open(a) as b, c):\n    nonlocal_ = 0x1F + 0b1 + 1_000.5e-3j\n",
    ],
    "javascript": [
        "import a, { b as c, default as d } from './x';\nexport * as y from 'z';\nexport default class extends A { #p = 1; static async *g() { yield* h; } get q() { return this.#p } static { f() } }\n",
        "const { a = 1, b: [c, ...d], ...e } = f ?? g?.h?.[i]?.(j);\nlet k = async (l, { m } = {}) => ({ ...n, [o]: p, q() {}, get r() { return 1 } });\nfor (const s of t) if (u) continue; else break\nlabel: for (let i = 0, n = 2; i < n; i++) { continue label }\n",
        "var x = a / b / c, r = /[/\\]]+/gi.test(y) ? `t${ z + `${1}` }` : !0\nx ||= 2 ** 3\nif (x) ; else do { x-- } while (x)\ntry { throw new Error } catch { } finally { }\nswitch (x) { case 1: default: y }\nx\n++y\nfunction* g() { const z = yield }\n(function () { return })()\nnew A.B(c)(d)\n",
    ],
    "typescript": [
        "import type { A } from './a';\nexport interface B<T extends object = {}> extends C<T>, D { readonly a?: string[]; [k: string]: unknown; (x: number): void; m<U>(u: U): u is T }\nexport type E = { [K in keyof T]-?: T[K] } | (new () => F) | `a${string}` | [x: number, y?: string, ...z: Z[]];\n",
        "abstract class G<T> extends H<T> implements I, J { private readonly k: number = 1; constructor(public a: string, protected b?: number) { super() } abstract m(): void; static n<T>(this: Window, x?: T): asserts x is T { } declare p: string; q!: number }\nenum K { A = 1, B = 'b' }\ndeclare module 'm' { export function f(a: number): string; }\nnamespace N.O { const x = 1 }\nfunction over(a: string): void;\nfunction over(a: any) { const b = <any>a; return (b as unknown as Foo)!.c satisfies D }\nconst f = async <T,>(x: T): Promise<Map<string, Array<T>>> => { return x! };\n",
    ],
    "go": [
        'package a\nimport (\n\t"fmt"\n\t. "b"\n\t_ "c"\n)\nconst (\n\tX = iota\n\tY\n)\ntype T[K comparable] struct {\n\tA, B int `json:"a"`\n\t*C\n\td.E\n}\ntype I interface {\n\tM(a int, b ...string) (c error)\n\t~int | string\n}\nfunc (t *T[K]) F(a, b int, c func(int) bool) (x int, err error) {\n\tif v, ok := m[k]; ok && v.(type_) != nil {\n\t\treturn\n\t} else if a < b {\n\t}\n\tfor i := range ch {\n\t\tgo func() { <-done }()\n\t}\n\tfor ; ; {\n\t}\n\tswitch y := x.(type) {\n\tcase int, *T:\n\t\tfallthrough\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-ch:\n\tcase ch <- 1:\n\t}\n\ts := []map[string]int{{"a": 1}, {}}\n\tdefer mu.Unlock()\n\tz := a[1:2:3]\nL:\n\tgoto L\n\treturn s, &T{A: 1, B: 2}\n}\n',
    ],
    "rust": [
        "#![allow(x)]\nuse a::{b::*, c as d, self};\npub(crate) mod m { pub use super::*; }\n#[derive(Debug)]\npub struct S<'a, T: Clone + 'a = u8, const N: usize = 3> where T: Fn(u8) -> u8 { pub a: &'a mut T, b: [u8; N] }\nstruct U; struct V(pub u8, i8);\nenum E { A, B(u8), C { x: i8 } = 4 }\ntrait Tr: Send { type X: Copy; const C: u8 = 1; fn f(&self) -> Self::X; fn g() {} }\nimpl<'a, T> Tr for S<'a, T> where T: Clone { type X = Vec<Vec<u8>>; fn f(&mut self) -> <T as Tr>::X { self.a?.b.0.await } }\n",
        "async unsafe fn f<T>(mut a: u8, &(b, _): &(u8, u8)) -> impl Iterator<Item = u8> + '_ {\n    let x @ 1..=5 = a else { return };\n    let c = move |y: u8, z| -> u8 { y };\n    if let Some(ref q) | Ok(q) = r && s { } else if t { } else { }\n    'l: loop { break 'l 5; }\n    match v { A::B { x, .. } | C(1, ..) if x > 0 => 1, 'a'..='z' => { } [first, .., last] => 2, _ => vec![1, 2] };\n    for (i, j) in 0..n.len() { continue }\n    let p = P { a, b: 2, ..Default::default() };\n    let s = r#\"raw \"x\" \"#; let v = (a as u8 as f64) < 2.0; let w = x.collect::<Vec<_>>()[..];\n    println!(\"{}\", x); unsafe { *p = 1 }\n    a <<= 1; a >>= 2; &a[1..] == b\"x\"\n}\nmacro_rules! m { ($a:expr) => { $a + 1 }; }\nm! { x }\n",
    ],
    "java": [
        "package a.b;\nimport static c.D.*;\n@Ann(x = 1) public abstract class A<T extends B & C> extends D<T> implements E, F {\n  static { int[] a = {1, 2}, b[] = new int[3][]; }\n  private final Map<String, List<? super T>> m = new HashMap<>();\n  public A(int... x) throws G { super(x); }\n  abstract <U> U f(final U u, T[] t);\n  enum H { I(1) { void g() { } }, J; int k; }\n  record R(int a, String b) { R { } }\n  @interface N { int v() default 1; }\n  void g() {\n    for (var x : xs) { outer: while (true) { break outer; } }\n    for (int i = 0, j = 1; i < j; i++, j--) ;\n    Function<A, B> f = (a, b) -> a.b(), g = x -> { return x; }, h = A::new, k = int[]::new;\n    int y = (int) z + (a) + (B) c >>> 2; y >>>= 1; Object o = (Runnable & X) () -> { };\n    try (var r = s(); q) { } catch (E | F e) { throw e; } finally { }\n    switch (x) { case 1, 2: f(); break; default: g(); }\n    String t = switch (x) { case 1 -> \"a\"; case 2 -> { yield \"b\"; } default -> throw new E(); };\n    if (o instanceof String s && !s.isEmpty()) synchronized (this) { assert x : y; } else do { } while (x ? y : z);\n    List<String> l = a.<B>c().d[1].e;\n    char c = '\\u0041'; long n = 0xFFL + 1_000;\n  }\n}\n",
    ],
    "c": [
        "#include <x.h>\n#define A(x) \\\n  ((x) + 1)\ntypedef struct s { int a : 3, b; union { char *c[2]; }; } s_t, *p_t;\nenum e { X = 1, Y, };\nstatic inline const unsigned long *f(int a[], void (*cb)(int, ...), const char *restrict b);\nint g(void) {\n  struct s v = { .a = 1, .c = { [0] = \"x\" \"y\" } }, *w = &v;\n  for (int i = 0; i < 3; i++) { if (!w->a) continue; else goto end; }\n  size_t n = sizeof(struct s) * sizeof v; foo_t *q = (foo_t *) x + (int) -1;\n  switch (n) { case 'a': case 2 ... 3: break; default: ; }\n  do { *w++ = (s_t){ 0 }; } while (a ? b : c, d);\nend:\n  return n << 2 >= 3u && ~n;\n}\nint (*table[])(void) = { g, };\n",
    ],
    "ruby": [
        "require 'a'\nmodule M\n  class A < B::C\n    attr_reader :x, :y\n    CONST = %w[a b].freeze\n    def initialize(a, b = 1, *c, k: 2, **o, &blk)\n      @a, @b = a, b\n      @h = { :a => 1, b: 2, 'c': 3 }\n    end\n    def self.m?(x) = x > 1\n    def [](i)\n      return nil unless i && !i.zero?\n      case i\n      when 1, 2 then puts \"a#{b ? \"c\" : d}\"\n      else raise Foo, 'x' if i =~ /a[b\\/]c/i\n      end\n    rescue Foo, Bar => e\n      retry\n    ensure\n      x.each_with_index.map { |v, (w, z)| v + w }.select(&:odd?)\n    end\n  end\nend\nfoo.bar 1, a: 2 do |x|\n  next if x\n  y ||= begin; 1; end\nend\nx = if a then b else c end\nwhile i < 3 do i += 1 end\nputs [1, 2]\n  .map(&:to_s)\n  .join\nf = ->(a) { a * 2 }\ntext = <<~EOS\n  hi \\#{x}\nEOS\na = b ? c : d\nuntil x; y; end\np(*args, **opts)\n",
    ],
    "json": ['{"a": [1, -2.5e3, true, null, {"b": "\\u00e9\\n"}], "c": {}}', "[]", ' "x" \n'],
    "toml": ['title = "x"\n[a.b]\n"k 1" = [1, 2.5,\n  "c", # note\n]\nd = 2020-01-01T00:00:00Z\n[[t]]\nx.y = { a = 1, b = \'c\' }\nm = """\nlong\n"""\n'],
}


@pytest.mark.parametrize("language", sorted(VALID))
def test_valid_texts_have_no_issue(language):
    reader = Reader()
    for text in VALID[language]:
        assert reader.issues(text, language)[0] == []
        assert reader.issues(text.replace("\n", "\r\n"), language)[0] == []


@pytest.mark.parametrize("language", sorted(VALID))
def test_damaged_texts_are_found(language):
    """Cut off inside of a bracket, a conflict left at a line of its own, or text of another kind."""
    reader = Reader()
    for text in VALID[language]:
        openings = [i for i, c in enumerate(text) if c in "([{" and i < len(text) - 2]
        if language in ("c", "java", "go", "rust", "typescript", "javascript") and text.count("{"):
            assert reader.issues(text[: text.rindex("}")].rstrip("}) ;\n"), language)[0]
        assert openings or language in ("json", "toml", "ruby", "python")
        lines = text.split("\n")
        assert reader.issues("\n".join(["<<<<<<< HEAD", *lines]), language)[0]
        assert reader.issues("\n".join([*lines, ">>>>>>> main"]), language)[0]
    for other in ("The parser sees a worker where the motor should run twice.\n\nSo it goes.", "<!doctype html>\n<html><body><p>Text.</p></body></html>", "# Title\n\n```\ncode\n```\n\nMore words, and more.\n"):
        assert reader.issues(other, language)[0]


def test_recovery_reports_every_place():
    found, lines = Reader().issues("int f(void) {\n  int a = ;\n  int b = 1;\n  c d e;\n  return b;\n}\n", "c")
    assert len(found) == 2 and lines == [2, 4]


def test_shapes_that_were_accepted_once_stay_accepted_and_others_do_not():
    reader = Reader()
    assert reader.issues("const a = f(1);\nconst b = g(2);\n", "javascript")[0] == []
    assert reader.issues("const a = f(1;\n", "javascript")[0]
    assert reader.issues("function f() { return 1; }\n", "javascript")[0] == []
    assert reader.issues("return 1;\n", "javascript")[0]


def test_python_agrees_with_its_own_compiler_on_damaged_texts():
    rng = random.Random(4)
    reader = Reader()
    for text in VALID["python"]:
        for _ in range(60):
            a = rng.randrange(len(text))
            broken = text[:a] + text[a + rng.randrange(1, 4) :]
            try:
                ast.parse(broken)
                valid = True
            except (SyntaxError, ValueError):
                valid = False
            if valid:
                assert reader.issues(broken, "python")[0] == []


def test_json_agrees_with_the_library():
    rng = random.Random(4)
    reader = Reader()
    for text in VALID["json"][:1] * 80:
        a = rng.randrange(len(text))
        broken = text[:a] + text[a + 1 :]
        try:
            json.loads(broken)
            valid = True
        except ValueError:
            valid = False
        if broken.strip():
            assert bool(reader.issues(broken, "json")[0]) != valid


def test_operator(spark):
    rows = [
        (1, "r", "a/B.PY", "def f(:\n", "x"), (1, "r", "a/B.PY", "def f(:\n", "y"), (2, "r", "b.py", "x = 1\n", "x"), (3, None, "c.go", "func", "x"), (4, "r", "d.md", "<<<<<<<", "x"),
        (5, "r", "e.js", None, "x"), (6, "r", "f.js", " \n\t", "x"), (7, "r", None, "(", "x"), (8, "r", ".py", "(", "x"), (9, "r", "dir\\g.rs", "fn f( {", "x"), (10, "r", "x.unknown", "(", "x"), (11, "r", "h.c", "int x;\n" * 3000 + "int (;", "x"), (None, "r", "i.json", "{", "x"),
    ]
    files = spark.createDataFrame(rows, "file_id bigint, repo string, file_path string, source string, language string")
    got = check_files(files).collect()
    assert {r.file_id for r in got if r.n_errors} == {1, 3, 9, 11, None}
    assert {r.file_id for r in got if not r.n_errors} == {2}
    assert all((r.first_cause is None) == (not r.n_errors) and len(r.errors) == r.n_errors for r in got)
    rates = {(r.repo, r.language): (r.files, r.invalid_files, r.invalid_rate) for r in failure_rates(files).collect()}
    assert rates[("r", "python")] == (2, 1, 0.5) and rates[(None, "go")] == (1, 1, 1.0)
    assert check_files(files.limit(0)).count() == 0
    assert set(PARSERS) == {"py", "js", "ts", "go", "rs", "java", "c", "rb", "json", "toml"}
    paths = spark.createDataFrame([("a/b.JS",), (".py",), ("x.tar.gz",), ("a.b/c",), ("w\\z.C",)], "p string")
    assert [r.e for r in paths.select(extension(F.col("p")).alias("e")).collect()] == ["js", "", "gz", "", "c"]


@pytest.mark.parametrize(
    "language, first, second",
    [
        ("go", "package a\nfunc f() {\n\tg(x)\n\tx := g(y)\n}\n", "package a\ng(x)\n"),
        ("go", "package a\nfunc f() {\n\tx := g(y)\n}\n", "package a\nx := g(y)\n"),
        ("rust", "fn f() { let a = b; }\n", "let a = b;\n"),
        ("java", "class A { void g() { f(x); } }\n", "class A { f(x); }\n"),
        ("java", "class A { abstract T f(T x); }\n", "class A { void g() { T f(T x); } }\n"),
        ("javascript", "import a from 'b';\n", "{ import a from 'b'; }\n"),
        ("c", "int f(void) { g(); return 1; }\n", "return 1;\n"),
    ],
)
def test_verdicts_do_not_depend_on_what_was_read_before(language, first, second):
    reader = Reader()
    assert reader.issues(first, language)[0] == []
    assert reader.issues(second, language)[0] and reader.issues(second, language)[0] == Reader().issues(second, language)[0]


DEEP = 50_000
NESTED = {
    "json": ("[" * DEEP, "]" * DEEP),
    "toml": ("x = " + "[" * DEEP, "]" * DEEP + "\n"),
    "python": ("x = " + "(" * DEEP + "1", ")" * DEEP + "\n"),
    "ruby": ("x = " + "(" * DEEP + "1", ")" * DEEP + "\n"),
    "javascript": ("x = " + "(" * DEEP + "1", ")" * DEEP + ";"),
    "typescript": ("x = " + "(" * DEEP + "1", ")" * DEEP + ";"),
    "go": ("package a\nvar x = " + "(" * DEEP + "1", ")" * DEEP + "\n"),
    "rust": ("fn f() { let x = " + "(" * DEEP + "1", ")" * DEEP + "; }"),
    "java": ("class A { int x = " + "(" * DEEP + "1", ")" * DEEP + "; }"),
    "c": ("int x = " + "(" * DEEP + "1", ")" * DEEP + ";"),
}


@pytest.mark.parametrize("language", sorted(NESTED))
def test_depth_is_no_error_and_takes_linear_time(language):
    before, after = NESTED[language]
    began = time.perf_counter()
    assert Reader().issues(before + after, language)[0] == []
    assert Reader().issues(before + after.replace(")", "", 1).replace("]", "", 1), language)[0]
    assert time.perf_counter() - began < 15


@pytest.mark.parametrize(
    "language, source",
    [
        ("python", "f(a=1, 2)\n"), ("python", "f(**a, *b)\n"), ("python", "f(x for x in y, 1)\n"), ("python", "f(1=2)\n"), ("python", "del f()\n"), ("python", "a[1] + 2 = 3\n"),
        ("toml", "a = 1\na = 2\n"), ("toml", "[a]\n[a]\n"), ("toml", "a.b = 1\n[a.b]\n"), ("toml", "a = 1\na.b = 2\n"), ("toml", "[[a]]\n[a]\n"),
        ("javascript", "1++"), ("javascript", "for (let i of a, b) {}"), ("javascript", "break;"), ("javascript", "for (;;) { (() => { break })() }"), ("javascript", "switch (a) { case 1: continue }"), ("javascript", "new.target"),
        ("go", "package a\nfunc f() {\n\tif x\n\t{\n\t}\n}\n"),
    ],
)
def test_early_errors(language, source):
    assert Reader().issues(source, language)[0]


@pytest.mark.parametrize(
    "language, source",
    [
        ("python", "match x:\n    case (A() as a, b) | [1, *_]: pass\n    case {'k': v} if v:\n        pass\nmatch[1] = case\nmatch: int = 1\nmatch(x)\ncase = match if x else y\n"),
        ("python", "f(*a, b, *c, d=1, *g, **e)\ndel a, b[1], (c.d, e)\na[b[c] + 1] = 2\nf(x for x in y)\n"),
        ("toml", 'a.b = 1\na.c = 2\n[x]\na = 1\n[[y]]\na = 1\n[y.z]\nq = 1\n[[y]]\na = 1\n[y.z]\nq = 1\n[m.n.o]\n[m.n]\n["m x"]\n'),
        ("javascript", "a++; a.b++; a[1]--; (a)++; a.true++; l: { break l }\nfor (;;) { if (x) break; else continue }\nswitch (x) { case 1: break; default: for (;;) continue }\nfunction f() { return new.target }"),
        ("go", "package a\nfunc f() {\n\tif x := g(); x {\n\t}\n}\n"),
    ],
)
def test_what_is_no_early_error(language, source):
    assert Reader().issues(source, language)[0] == []
