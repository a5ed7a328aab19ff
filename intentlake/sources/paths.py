"""Languages by extension, and the path rules that admit a file, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extension, language; the documents come after the code.
CODE = """.py python .js javascript .jsx javascript .ts typescript .tsx typescript .go go .rs rust .java java .rb ruby
.php php .c c .h c .cpp cpp .hpp cpp .cs csharp .swift swift .scala scala .sbt scala .ex elixir .exs elixir
.dart dart .lua lua .sql sql .sh bash .bash bash .zig zig .hs haskell .html html .htm html .vue vue .svelte svelte
.css css .scss scss .sass scss .less css"""
DOCUMENTS = ".md markdown .yaml yaml .yml yaml .toml toml .json json"


def _pairs(text: str) -> dict[str, str]:
    words = text.split()
    return dict(zip(words[::2], words[1::2], strict=True))


CODE_TYPES, DOCUMENT_TYPES = _pairs(CODE), _pairs(DOCUMENTS)
LANGUAGE_OF = CODE_TYPES | DOCUMENT_TYPES

# Folders (and files) never walked into.
IGNORED = (
    ".git .hg .svn __pycache__ node_modules .venv venv .tox .mypy_cache .pytest_cache .ruff_cache .cache .next dist build .eggs"
).split()
# Parts of the names of minified and bundled files.
MINIFIED = ".min.js .min.mjs .min.css .bundle.js .bundle.css -min.js -min.css .prod.js".split()


def file_types(spark: SparkSession) -> DataFrame:
    """The dimension table (ext, language, category)."""
    rows = [(e, n, "Code") for e, n in CODE_TYPES.items()] + [(e, n, "Document") for e, n in DOCUMENT_TYPES.items()]
    return spark.createDataFrame(rows, "ext string, language string, category string")


def extensions(given: list[str] | None = None, text_files: bool = False) -> list[str]:
    """The caller's extensions word for word, else those of code, and of documents if wanted."""
    if given is not None:
        return sorted(set(given))
    return sorted(CODE_TYPES) + (sorted(DOCUMENT_TYPES) if text_files else [])


def language_for_path(path: str) -> str | None:
    """Language of one path, None if the extension is unknown."""
    return LANGUAGE_OF.get(extension_of(path))


def extension_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1].lower()
    stem, dot, last = name.rpartition(".")
    return dot + last if stem and last else ""


def minified_name(path: str) -> bool:
    name = path.rsplit("/", 1)[-1].lower()
    return any(p in name for p in MINIFIED)


def slashes(path: Column) -> Column:
    """The path with forward slashes and without a leading ./"""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"\A(?:\./)+", "")


def extension(path: Column) -> Column:
    """Lower-cased last extension with its dot; '' where there is none, as for a dot file."""
    found = F.lower(F.regexp_extract(path, r"(?<=[^/])\.([^./]+)\z", 1))
    return F.when(found == "", F.lit("")).otherwise(F.concat(F.lit("."), found))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def is_minified(path: Column) -> Column:
    name = F.lower(file_name(path))
    test = F.lit(False)
    for p in MINIFIED:
        test |= F.contains(name, F.lit(p))
    return test


def is_ignored(path: Column, more: list[str] | None = None) -> Column:
    """Whether any part of the path, folder or file, has an ignored name; the caller's names come on top."""
    names = sorted(set(IGNORED) | set(more or []))
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in names]))


def walk_key(path: Column) -> Column:
    """Sorts as a walk by file names does, which the plain string doesn't."""
    return F.split(path, "/")


def language(path: Column) -> Column:
    """Language of the path by a constant map: the lookup join for so small a dimension."""
    pairs = [F.lit(x) for item in LANGUAGE_OF.items() for x in item]
    return F.element_at(F.create_map(*pairs), extension(path))


def with_language(files: DataFrame, path: str = "file_path") -> DataFrame:
    """`files` with the language of each path, null if unknown: a left join with the dimension.

    The dimension has forty rows, a constant of this module, so it is broadcast.
    """
    types = file_types(files.sparkSession).select(F.col("ext").alias("_ext"), F.col("language").alias("path_language"))
    return files.join(F.broadcast(types), extension(slashes(F.col(path))) == F.col("_ext"), "left").drop("_ext")


def is_admitted(path: str = "file_path", source: str = "source", max_bytes: int = 1_000_000, given: list[str] | None = None, text_files: bool = False, ignore: list[str] | None = None) -> Column:
    """Whether a walk would index the file, in the order of its tests.

    Not ignored, known extension, not minified, not larger than `max_bytes`
    (equal is kept), not blank. Null for a null path or source.
    """
    p = slashes(F.col(path))
    return ~is_ignored(p, ignore) & extension(p).isin(extensions(given, text_files)) & ~is_minified(p) & (F.octet_length(source) <= max_bytes) & F.col(source).rlike(r"(?U)\S")


def admitted(files: DataFrame, *args, **kwargs) -> DataFrame:
    """Rows of a table of files for which is_admitted() holds; a null path or source is never admitted."""
    return files.where(is_admitted(*args, **kwargs))
