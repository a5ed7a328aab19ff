"""Problem 2: source files that do not parse in the language their path names."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intentlake.llm.syntax.base import Parser, SyntaxIssue
from intentlake.llm.syntax.cfamily import CParser, JavaParser
from intentlake.llm.syntax.data import JsonParser, TomlParser, repeated_keys
from intentlake.llm.syntax.go import CLOSERS, GoParser
from intentlake.llm.syntax.python import PythonParser
from intentlake.llm.syntax.ruby import RubyParser, prepare
from intentlake.llm.syntax.rust import RustParser
from intentlake.llm.syntax.script import ScriptParser, TypeScriptParser
from intentlake.plans.runtime import spread

#: Extension (lower case) to language and parser.
PARSERS: dict[str, tuple[str, type[Parser]]] = {
    "py": ("python", PythonParser),
    "js": ("javascript", ScriptParser),
    "ts": ("typescript", TypeScriptParser),
    "go": ("go", GoParser),
    "rs": ("rust", RustParser),
    "java": ("java", JavaParser),
    "c": ("c", CParser),
    "rb": ("ruby", RubyParser),
    "json": ("json", JsonParser),
    "toml": ("toml", TomlParser),
}


class Reader:
    """The parsers of one worker, with what they have learned about shapes of statements."""

    def __init__(self) -> None:
        self.parsers = {name: parser() for name, parser in PARSERS.values()}

    def issues(self, source: str, language: str) -> tuple[list[SyntaxIssue], list[int]]:
        """All errors in order of their place, and the line of each."""
        parser = self.parsers[language]
        source = source.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
        if language == "ruby":
            source = prepare(source)
        tokens = parser.pattern.findall(source)
        if language == "python":
            found = parser.parse_tokens(tokens)
        elif parser.line_ends:
            found = parser.parse("".join("\n" if t[0] == "\n" else parser.kinds[t] for t in tokens))
            if language == "toml" and not found:
                found = repeated_keys(tokens)
        else:
            found = parser.parse("".join(map(parser.kinds.__getitem__, tokens)))
        return found, self.line_numbers(parser, language, source, tokens, found) if found else []

    @staticmethod
    def line_numbers(parser: Parser, language: str, source: str, tokens: list[str], found: list[SyntaxIssue]) -> list[int]:
        """Lines of the errors; only texts that have some are gone through again."""
        if language == "python":
            starts = [m.start(1) for m in parser.pattern.finditer(source)]
        else:
            starts, last = [], ""
            for m in parser.pattern.finditer(source):
                kind = "\n" if m[1][0] == "\n" else parser.kinds[m[1]]
                if kind == "\n":
                    if language == "go" and last and last in CLOSERS:
                        starts.append(m.start(1))  # the semicolon that this line end stands for
                    last = ""
                    if language not in ("ruby", "toml"):
                        continue
                if kind:
                    starts.append(m.start(1))
                    last = kind
        return [source.count("\n", 0, starts[min(x.token, len(starts) - 1)]) + 1 if starts else 1 for x in found]


SCHEMA = pa.schema([("file_id", pa.int64()), ("repo", pa.string()), ("language", pa.string()), ("n_errors", pa.int64()), ("first_line", pa.int64()), ("first_cause", pa.string()), ("errors", pa.list_(pa.string()))])
DDL = "file_id bigint, repo string, language string, n_errors bigint, first_line bigint, first_cause string, errors array<string>"


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = Reader()
    for batch in batches:
        columns: list[list] = [[] for _ in SCHEMA]
        for file_id, repo, ext, source in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            language = PARSERS[ext][0]
            found, lines = reader.issues(source, language)
            errors = [f"{line}: {x.why}" for x, line in zip(found, lines, strict=True)]
            for column, value in zip(columns, (file_id, repo, language, len(found), lines[0] if lines else None, found[0].why if found else None, errors), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)


def extension(path) -> F.Column:
    """Lower-cased extension of a path with either separator; none for a dot file."""
    name = F.regexp_extract(F.lower(path), r"([^/\\]*)\z", 1)
    return F.regexp_extract(name, r"(?s).\.([^.]+)\z", 1)


def check_files(files: DataFrame) -> DataFrame:
    """One row per row of files with a parser: file_id, repo, language, n_errors, first_line, first_cause, errors.

    files: file_id, repo, file_path, source. The language is the one of the
    extension, in any case. A null path or source, a blank source, Markdown and
    extensions without a parser give no row; a file that comes again has a row
    each time. Lines are counted from 1; in Ruby, where
    joined lines shift the places, they are near the error. The files are read
    where they lie, nothing is shuffled.
    """
    rows = files.select(F.col("file_id").cast("bigint").alias("file_id"), F.col("repo").cast("string").alias("repo"), extension(F.col("file_path")).alias("ext"), "source").where(
        F.col("ext").isin(*PARSERS) & F.col("source").rlike(r"(?U)\S")
    )
    return spread(rows).mapInArrow(_check, DDL)


def failure_rates(files: DataFrame) -> DataFrame:
    """Per repo and language: files, invalid files and their rate. A file that comes again counts once."""
    once = check_files(files).groupBy("file_id", "repo", "language").agg(F.max("n_errors").alias("n_errors"))
    bad = F.sum((F.col("n_errors") > 0).cast("bigint"))
    return once.groupBy("repo", "language").agg(F.count("*").alias("files"), bad.alias("invalid_files"), F.round(bad / F.count("*"), 6).alias("invalid_rate"))
