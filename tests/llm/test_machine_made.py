"""Grammars, notes and marks, and the operator over files of each kind."""

import base64
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from intentlake.llm.grammar import Grammar, phrases
from intentlake.llm.machine_made import machine_made, note
from intentlake.llm.superminhash import U, mix

RNG = random.Random(9)
NAMES = [a + b for a in ("read", "write", "open", "close", "merge", "split", "find") for b in ("File", "Index", "Chunk", "Line", "Vector", "Query")]


def hand_written(n=12, seed=0):
    r = random.Random(seed)
    out = ["// Copyright (c) the index team.", 'import { base } from "./base";', ""]
    for _ in range(n):
        f, g, h = r.sample(NAMES, 3)
        out += [f"export function {f}({g}, limit) {{", f"  const {h} = {r.choice(NAMES)}({g}, {r.randrange(900)});", r.choice([f"  if ({h} > limit) {{\n    return null;\n  }}", f"  for (const item of {h}) {{\n    {r.choice(NAMES)}(item);\n  }}", "  // nothing to do"]), f"  return {h};", "}", ""]
    return "\n".join(out)


FILES = {
    "app/a.js": hand_written(),
    "app/gen.js": "// Code generated by tool v1. DO NOT EDIT.\n" + hand_written(5, 1),
    "app/late.js": hand_written(5, 2) + "\n// @generated\n// source: x.idl\n",
    "app/de.js": "// Dieser Quelltext wurde maschinell von x erzeugt. Nicht bearbeiten.\n" + hand_written(5, 3),
    "generated/api_pb.js": hand_written(5, 4),
    "app/speaks.js": hand_written(8, 5) + "\n// the template prints DO NOT EDIT above each file\n// ids are generated by the store, edit them freely\n" + hand_written(12, 6),
    "app/codegen/tool_generator.js": hand_written(8, 7),
    "vendor/some-lib/src/x.js": hand_written(10, 8),
    "app/copied.js": hand_written(10, 8),
    "app/note.js": "// Third-party code: LibX 1.2\n// Imported unmodified; report bugs upstream.\n" + hand_written(5, 9),
    "src/vendors/list.js": hand_written(6, 10),
    "app/x.min.js": "".join(f"function a{i}(b,c){{return d.e(b,{i})}}if(f>{i}){{g.h(b)}}else j[{i}]=k;" for i in range(60)),
    "app/data.js": "export default [\n" + "\n".join(f'  {{"width": {RNG.random() * 900:.4f}, "height": {RNG.random() * 90:.4f}, "tag": "x y"}},' for _ in range(80)) + "\n];\n",
    "app/blob.js": 'export const B = "' + base64.b64encode(bytes(RNG.randrange(256) for _ in range(1500))).decode() + '";\n',
    "app/bytes.c": "static const unsigned char x[] = {\n" + "".join(f"  0x{RNG.randrange(256):02x}," for _ in range(600)) + "\n};\n",
    "app/small.js": 'const SMALL = ["one", "two", "three"];\n' + hand_written(6, 11),
    "app/settings.json": '{\n  "a": {"b": 1, "c": [true, "d"]},\n' + "".join(f'  "k{i}": "{RNG.choice(NAMES)}",\n' for i in range(30)) + '  "z": 0\n}\n',
    "app/deps.lock.json": '{"resolved": {' + ",".join(f'"p{i}": {{"integrity": "sha512-{base64.b64encode(bytes(RNG.randrange(256) for _ in range(64))).decode()}"}}' for i in range(20)) + "}}",
    "app/notes.md": "# Notes\n\nThe files under vendor are generated. Do not edit them by hand, please.\n",
}
MADE = {p for p in FILES if p in ("app/gen.js", "app/late.js", "app/de.js", "generated/api_pb.js", "vendor/some-lib/src/x.js", "app/copied.js", "app/note.js", "app/x.min.js", "app/data.js", "app/blob.js", "app/bytes.c", "app/deps.lock.json")}


def test_operator(spark):
    ids = {p: i for i, p in enumerate(FILES)}
    rows = [(ids[p], f"r{ids[p] % 3}", p, s) for p, s in FILES.items()]
    rows += [(500, "r", "a.js", None), (501, "r", "a.js", " \n"), (502, None, None, "x"), (503, "r", "one.js", "x"), (ids["app/gen.js"], "r1", "app/gen.js", FILES["app/gen.js"])]
    files = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "file_id bigint, repo string, file_path string, source string, phrases string, tokens double")
    got = machine_made(files).collect()
    assert len(got) == len({r.file_id for r in got}) == len(FILES) + 2
    assert {p for p in FILES for r in got if r.file_id == ids[p] and (r.generated or r.minified or r.vendored or r.data)} == MADE
    assert machine_made(files.limit(0)).count() == 0


def test_notes():
    assert note(["/*", " * Code generated by x v1. DO NOT EDIT.", " */"]) == (True, False)
    assert note(['x = "// Code generated by x. DO NOT EDIT."']) == (False, False)
    assert note(["# LibX v1 | (c) LibX contributors | upstream release copy"]) == (False, True)
    assert note(["// replaces the old auto-generated parser with a hand-written one"]) == (False, False)
    assert note(["// AUTO-GENERATED 10/04/2025 from schema listener-module", "// Regenerate with: make listener"]) == (True, False)
    assert note(["# Copyright (c) 2024 Widget contributors", "# The file is generated by the exporter when a user asks."]) == (False, False)
    assert note(["// the auto-generated ids are read from the store"]) == (False, False)
    assert note([]) == (False, False)


def grammar_of(texts):
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return Grammar(owner, mix(np.array([ord(c) for t in texts for c in t], np.int64).astype(U)), len(texts))


def test_repetition_makes_small_grammars():
    rng = random.Random(1)
    noise = "".join(chr(65 + rng.randrange(2000)) for _ in range(500))
    g = grammar_of(["abcd" * 200, noise, "", "ab", "a" * 64, "xyxyxyx"])
    c = g.compression()
    assert c[0] < 0.05 and c[1] > 0.9 and c[2] == 1 and c[3] == 1 and c[4] < 0.3 and c[5] < 1.2
    assert g.reuse()[0] == 1


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="abc", max_size=60), max_size=6))
def test_every_sequence_ends_and_is_independent(texts):
    together = grammar_of(texts)
    for i, t in enumerate(texts):
        alone = grammar_of([t])
        assert together.length[i] == len(t) == alone.length[0]
        assert (together.left[i], together.rules[i]) == (alone.left[0], alone.rules[0])
        # it goes on as long as a digram repeats, so a text that repeats one apart has a rule
        pairs = [t[j : j + 2] for j in range(len(t) - 1)]
        if any(p in t[j + 2 :] for j, p in enumerate(pairs)):
            assert together.rules[i] and together.left[i] < len(t)


def test_equal_stretches_have_equal_phrases():
    rng = np.random.default_rng(2)
    common = rng.integers(0, 1000, 400)
    one, two = np.concatenate((rng.integers(0, 1000, 30), common)), np.concatenate((common, rng.integers(0, 1000, 50)))
    owner = np.repeat([0, 1], [len(one), len(two)])
    who, symbol, weight = phrases(owner, mix(np.concatenate((one, two)).astype(U)))
    shared = set(symbol[who == 0]) & set(symbol[who == 1])
    assert weight[(who == 0) & np.isin(symbol, list(shared))].sum() > 300
    assert np.bincount(who, weights=weight).tolist() == [len(one), len(two)]


def test_notes_below_a_long_licence():
    licence = [f"Line {i} of the licence, which grants and disclaims." for i in range(20)]
    code = ["int x;"] * 40
    for block in ([f"// {x}" for x in licence], ["/*", *licence, " */"], ["/*", *[f" * {x}" for x in licence], " */"]):
        assert note([*block, "", "// Code generated by x. DO NOT EDIT.", *code]) == (True, False)
        assert note([*block, *code, "// Code generated by x. DO NOT EDIT.", *code]) == (False, False)


def test_rules_alone_tell_generated_files(spark):
    names = [f"{a}{b}" for a in ("Order", "Part", "Region", "Nation", "Event", "Line") for b in ("Key", "Name", "Size", "Date", "Note")]
    made = "".join(f"int get_{n}(struct row *self, int fallback) {{\n  if (self == NULL) {{\n    return fallback;\n  }}\n  return self->{n};\n}}\n\n" for n in names)
    classes = "".join(f"public class {n}Holder {{\n  private final String value;\n  public {n}Holder(String value) {{ this.value = value; }}\n  public String get{n}() {{ return value; }}\n}}\n" for n in names * 2)
    rows = [(1, "r", "app/access.c", made), (2, "r", "app/a.js", hand_written(30)), (3, "r", "src/Holders.java", classes)]
    rows += [(4, "r", "contrib/imported/lib-x/a.js", hand_written(5, 50)), (5, "r", "contrib/a.js", hand_written(5, 51))]
    files = spark.createDataFrame(rows, "file_id bigint, repo string, file_path string, source string")
    assert {r.file_id for r in machine_made(files).where("generated").collect()} == {1, 3}
    assert {r.file_id for r in machine_made(files).where("vendored").collect()} == {4}


def test_code_of_many_repositories_is_vendored(spark):
    rows = [(i, f"r{i}", f"lib{i}/x.js", hand_written(10, 77)) for i in range(12)] + [(100 + i, f"r{i}", f"app{i}/y.js", hand_written(10, 78)) for i in range(4)]
    rows += [(200 + i, "r0", f"app{i}/z.js", hand_written(10, 79)) for i in range(40)]
    got = machine_made(spark.createDataFrame(rows, "file_id bigint, repo string, file_path string, source string")).collect()
    assert {r.file_id for r in got if r.vendored} == set(range(12))


def test_repeated_phrases_count_each_time(spark):
    line = "total = first * second + third / fourth - offset(index, limit, width);\n"
    text = "".join(line + hand_written(2, i) + line * 20 for i in range(2))
    files = spark.createDataFrame([(1, "a", "vendor/x/m.c", text), (2, "b", "app/m.c", text), (2, "b", "app/m.c", text), (3, "b", "app/n.c", hand_written(9, 40))], "file_id bigint, repo string, file_path string, source string")
    got = {r.file_id: r for r in machine_made(files).collect()}
    assert {i for i, r in got.items() if r.vendored} == {1, 2} and 0.9 < got[2].shared <= 1
