"""Problem 5: generated, minified or vendored source files, and data saved as code."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intentlake.llm.grammar import Grammar, phrases
from intentlake.llm.superminhash import U, mix
from intentlake.plans.runtime import spread, store

TOKEN = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|[^\W\d]\w*|\d[\w.]*|[^\s\w]')
# Words that shape code in most languages; other words are names to the grammar.
KEYWORDS = frozenset("if else elif for while do switch case return break const let var def class struct enum interface function func fn import from export use package pub public private static final void int long end new try catch match in".split())

#: Literals of this many characters may be blobs.
LONG_LITERAL = 60

# Folders that hold third-party code, and names that generators and bundlers give.
VENDOR_PATH = re.compile(r"(?:^|/)(?:_?vendor|vendored|third[_-]?party|3rd[_-]?party|node_modules|bower_components|jspm_packages|site-packages|(?:external|contrib)/(?:deps|imported)|godeps/_workspace|pods|carthage)/")
GENERATED_PATH = re.compile(r"(?:^|/)(?:__)?generated(?:__)?/|(?:_pb2?|\.pb|\.pb-c|_autogen|[._]generated|\.g|\.gen|\.designer|_pb2_grpc|_grpc_pb)\.[a-z]+$|\.pb\.[a-z]+$")
MINIFIED_PATH = re.compile(r"(?:[.-]min|[.-]bundle|\.packed|\.prod|\.chunk(?:\.[0-9a-f]+)?)\.[cm]?[jt]s$")
LOCK_PATH = re.compile(r"(?:[._-]lock|[._-]resolved|[._-]lockfile)\.json$")

# What tools write above or below the code that they make or copy, without the comment's marks.
GENERATED_NOTE = re.compile(
    r"@generated\b|<auto-?generated|auto-?generated\b(?: file\b| code\b|.{0,40}\b(?:from|by)\b)|this (?:file|code|source|module) (?:is|was|has been) (?:automatically |auto-?|machine[- ])?generated\b|code generated by\b|automatically generated (?:by|from)\b"
    r"|generated (?:by|from|with)\b.*\b(?:do not|don't) (?:edit|modify|change|touch)\b|output of\b.*\bregenerated\b|any manual changes? (?:is|are|will be) overwritten\b|(?:[\w.-]+: )?machine[- ](?:written|generated|made)\b"
    r"|.*\b(?:maschinell|automatisch)\b.*\b(?:erzeugt|generiert|erstellt)\b|.*\b(?:produit|généré|créé)e? automatiquement\b|.*\b(?:generad|producid|cread)[oa] (?:automáticamente|de forma automática)\b"
)
VENDOR_NOTE = re.compile(r"third[- ]party code\b|vendored from\b|(?:this is )?a?\s*bundled copy of\b|imported unmodified\b|.*\bupstream (?:release )?copy\b|.*\bcopied (?:verbatim|unmodified) from\b")
COMMENT = re.compile(r"\s*(?://+|#+|/\*+!?|\*+|--+|<!--|;+|\"\"\"|''')\s*(.*)")
#: Lines at either end of a file in which such a note counts, besides the comments above all code; further in, code may be quoting it.
NOTE_LINES = 12
#: How a comment of several lines begins, and what ends it.
BLOCKS = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''"}


class Kinds(dict):
    """Token to its kind: names, numbers and strings fall together, keywords and signs stay."""

    def __missing__(self, token: str) -> int:
        c = token[0]
        if len(token) > 1 and c in "\"'":
            return 1
        if c.isdigit():
            return 2
        if c.isalpha() or c == "_":
            kind = 3 if token not in KEYWORDS else sum(ord(x) * 31**i for i, x in enumerate(token)) + 1000
        else:
            kind = 100_000_000 + ord(c)
        if len(self) > 200_000:
            self.clear()
        self[token] = kind
        return kind


def leading_comments(filled: list[str]) -> int:
    """Number of lines, without blank ones, that are comments above all code."""
    close = ""
    for i, line in enumerate(filled):
        text = line.strip()
        if close:
            if close in text:
                close = ""
            continue
        if not COMMENT.match(line[:400]):
            return i
        mark = next((m for m in BLOCKS if text.startswith(m)), "")
        if mark and BLOCKS[mark] not in text[len(mark) :]:
            close = BLOCKS[mark]
    return len(filled)


def note(lines: list[str]) -> tuple[bool, bool]:
    """Whether the comments above all code or at either end say that the text is generated, or a third party's."""
    filled = [x for x in lines if x and not x.isspace()]
    top = max(NOTE_LINES, leading_comments(filled))
    ends = filled if len(filled) <= top + NOTE_LINES else filled[:top] + filled[-NOTE_LINES:]
    generated = vendored = False
    for line in ends:
        m = COMMENT.match(line[:400])
        if m:
            text = m[1].lower()
            generated = generated or bool(GENERATED_NOTE.match(text))
            vendored = vendored or bool(VENDOR_NOTE.match(text))
    return generated, vendored


FEATURES = ["tokens", "compression", "reuse", "blanks", "short_names", "numbers", "literals", "long_literals", "literal_compression"]
SCHEMA = pa.schema(
    [("file_id", pa.int64()), ("repo", pa.string()), ("ext", pa.string()), ("generated_mark", pa.bool_()), ("vendored_mark", pa.bool_()), ("minified_mark", pa.bool_()), ("lock_mark", pa.bool_())]
    + [(f, pa.float64()) for f in FEATURES]
    + [("phrases", pa.list_(pa.int64())), ("weights", pa.list_(pa.int32()))]
)
DDL = "file_id bigint, repo string, ext string, generated_mark boolean, vendored_mark boolean, minified_mark boolean, lock_mark boolean, " + ", ".join(f"{f} double" for f in FEATURES) + ", phrases array<bigint>, weights array<int>"


def per_file(who: np.ndarray, symbol: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each phrase of a file once, with the tokens of all its occurrences."""
    if not len(who):
        return who, symbol, weight
    order = np.lexsort((symbol, who))
    who, symbol, weight = who[order], symbol[order], weight[order]
    starts = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (symbol[1:] != symbol[:-1]))))
    return who[starts], symbol[starts], np.add.reduceat(weight, starts).astype(np.int32)


def measure(ids: list, repos: list, paths: list[str], sources: list[str]) -> pa.RecordBatch:
    """Marks, grammar features and phrases of a batch of files."""
    kinds = Kinds()
    marks: list[list[bool]] = [[], [], [], []]
    columns = {f: np.zeros(len(ids)) for f in FEATURES}
    shapes, texts, lengths, literal_chars, literal_owner = [], [], [], [], []
    exts = []
    for i, (path, source) in enumerate(zip(paths, sources, strict=True)):
        path = path.lower().replace("\\", "/")
        exts.append(path.rpartition("/")[2].rpartition(".")[2])
        generated, vendored = note(source.splitlines())
        for mark, value in zip(marks, (generated or bool(GENERATED_PATH.search(path)), vendored or bool(VENDOR_PATH.search(path)), bool(MINIFIED_PATH.search(path)), bool(LOCK_PATH.search(path))), strict=True):
            mark.append(value)
        tokens = TOKEN.findall(source)
        shape = np.fromiter(map(kinds.__getitem__, tokens), np.int64, len(tokens))
        shapes.append(shape)
        texts.extend(tokens)
        lengths.append(len(tokens))
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        size, n = max(1, len(source)), max(1, len(tokens))
        names = (shape == 3) | ((shape >= 1000) & (shape < 100_000_000))
        long = np.flatnonzero((shape == 1) & (sizes > LONG_LITERAL))
        columns["tokens"][i] = len(tokens)
        columns["blanks"][i] = (len(source) - sizes.sum() + sum(x.count(" ") for x in (tokens[k] for k in np.flatnonzero(shape == 1)))) / size
        columns["short_names"][i] = (sizes[names] <= 3).sum() / max(1, names.sum())
        columns["numbers"][i] = sizes[shape == 2].sum() / size
        columns["literals"][i] = ((shape == 1) | (shape == 2)).sum() / n
        columns["long_literals"][i] = sizes[long].sum() / size
        for k in long:
            codes = np.frombuffer(tokens[k].encode("utf-32-le"), np.uint32)
            literal_chars.append(codes)
            literal_owner.append(np.full(len(codes), i))
    lengths = np.array(lengths, np.int64)
    owner = np.repeat(np.arange(len(ids)), lengths)
    structure = Grammar(owner, mix(np.concatenate([*shapes, np.zeros(0, np.int64)]).astype(U)), len(ids))
    columns["compression"], columns["reuse"] = structure.compression(), structure.reuse()
    if literal_chars:
        columns["literal_compression"] = Grammar(np.concatenate(literal_owner), mix(np.concatenate(literal_chars).astype(U)), len(ids)).compression()
        columns["literal_compression"][columns["long_literals"] == 0] = 0
    if texts:
        codes, words = pd.factorize(np.array(texts, dtype=object))
        hashed = mix(pd.util.hash_array(words, categorize=False).astype(U))[codes]
        who, symbol, weight = phrases(owner, hashed)
        keep = weight >= 8
        who, symbol, weight = per_file(who[keep], symbol[keep], weight[keep])
    else:
        who, symbol, weight = np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int32)
    offsets = pa.array(np.searchsorted(who, np.arange(len(ids) + 1)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(repos, pa.string()), pa.array(exts, pa.string()), *[pa.array(m, pa.bool_()) for m in marks], *[pa.array(columns[f]) for f in FEATURES], pa.ListArray.from_arrays(offsets, pa.array(symbol.view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(weight))],
        schema=SCHEMA,
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        sizes = np.cumsum([len(s) for s in batch.column(3).to_pylist()])
        while at < batch.num_rows:  # about a million characters at a time
            stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + 1_000_000)))
            part = batch.slice(at, stop - at)
            yield measure(*[c.to_pylist() for c in part.columns])
            at = stop


def file_features(files: DataFrame) -> DataFrame:
    """Marks, grammar features and phrases of every file with text, written once; a file that comes again has a row each time."""
    rows = files.select(F.col("file_id").cast("bigint").alias("file_id"), F.col("repo").cast("string").alias("repo"), F.coalesce("file_path", F.lit("")).alias("path"), "source").where(F.col("source").rlike(r"(?U)\S"))
    return store(spread(rows).mapInArrow(_measure, DDL))


#: Size of the grammar over the text's, and share of tokens under rules, from which rules alone tell that a program wrote it.
MOULDED, ALL_RULES = 0.12, 0.995
#: Share of a file's tokens in phrases of marked third-party files from which it counts as another copy.
COPY_SHARE = 0.7
#: Repositories in which a phrase of third parties' code occurs where no copy is marked. Code that an owner copies between repositories spreads less.
MANY_REPOS = 12


def machine_made(files: DataFrame) -> DataFrame:
    """file_id, repo, generated, minified, vendored, data, and the features, of every file with text.

    files: file_id, repo, file_path, source. A null or blank source gives no
    row, a null path has no marks, a file that comes again counts once.

    generated: a note or the name says so, or all of the text is made by a few
    rules (reuse of lesser degree is found in code by hand too). minified: hardly any
    blanks, short names, and a grammar far smaller than the text (one that
    reuses its rules), or a bundler's name and hardly any blanks. data: mostly
    numbers, or near-incompressible long literals, or rows that one rule makes.
    vendored: folder or note, or most of the text consists of rules that occur
    in files of third parties so marked, in any repository (column shared), or
    in MANY_REPOS repositories (column spread; settings and notes are left out).
    """
    rows = file_features(files)
    # a phrase stands once in each row, with all its tokens; rows of one file with the same phrases are one version of it
    version = F.xxhash64("phrases", "weights").alias("version")
    posted = rows.select("file_id", "repo", "tokens", "vendored_mark", version, F.explode(F.arrays_zip("phrases", "weights")).alias("e")).select("file_id", "repo", "tokens", "vendored_mark", "version", F.col("e.phrases").alias("phrase"), F.col("e.weights").alias("weight"))
    marked = posted.where("vendored_mark").select("phrase", F.lit(1).alias("marked"), F.lit(0).alias("wide"))
    wide = posted.select("phrase", "repo").distinct().groupBy("phrase").agg(F.count("repo").alias("n")).where(F.col("n") >= MANY_REPOS).select("phrase", F.lit(0).alias("marked"), F.lit(1).alias("wide"))
    third = marked.unionByName(wide).groupBy("phrase").agg(F.max("marked").alias("marked"), F.max("wide").alias("wide"))
    # per version of a file the tokens in phrases of third parties; phrases meet theirs in one equi-join
    met = posted.where("not vendored_mark").select("file_id", "version", "tokens", "phrase", "weight").distinct().join(third, "phrase")
    share = lambda c: F.sum(F.col("weight") * F.col(c)) / F.greatest("tokens", F.lit(1.0))
    shared = met.groupBy("file_id", "version", "tokens").agg(share("marked").alias("s"), share("wide").alias("w")).groupBy("file_id").agg(F.max("s").alias("shared"), F.max("w").alias("spread"))
    once = rows.drop("phrases", "weights").groupBy("file_id").agg(F.max(F.struct(*[c for c in rows.columns if c not in ("file_id", "phrases", "weights")])).alias("r")).select("file_id", "r.*")
    joined = once.join(shared, "file_id", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("shared", "spread")})
    settings = F.col("ext").isin("json", "toml", "md")
    dense = (F.col("blanks") < 0.1) & (F.col("tokens") >= 40)
    minified = ~settings & dense & (F.col("numbers") < 0.2) & ((F.col("short_names") > 0.35) & (F.col("compression") < 0.45) | F.col("minified_mark"))
    moulded = ~settings & (F.col("tokens") >= 200) & (F.col("reuse") > ALL_RULES) & (F.col("compression") < MOULDED)
    blob = (F.col("long_literals") > 0.25) & (F.col("literal_compression") > 0.5)
    tables = ~settings & ((F.col("numbers") > 0.18) & (F.col("literals") > 0.3) & (F.col("compression") < 0.35) | (F.col("literals") > 0.38) & (F.col("compression") < 0.12))
    return joined.select(
        "file_id",
        "repo",
        (F.col("generated_mark") | moulded).alias("generated"),
        minified.alias("minified"),
        (F.col("vendored_mark") | (F.col("shared") >= COPY_SHARE) | (~settings & (F.col("tokens") >= 40) & (F.col("spread") >= COPY_SHARE))).alias("vendored"),
        ((blob & (F.col("ext") != "md")) | tables | (F.col("lock_mark") & (F.col("long_literals") > 0.1))).alias("data"),
        *FEATURES,
        "shared",
        "spread",
    )
