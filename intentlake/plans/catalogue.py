"""Queries of the search engine's operators over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from intentlake.functions import text, vectors
from intentlake.functions.encoders import HashEncoder
from intentlake.functions.outline import STRUCTURED
from intentlake.operators import index, ranking
from intentlake.plans.runtime import latest, newest, spread, table
from intentlake.sources import paths

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _files(spark: SparkSession, sf_dir: str, *columns: str | Column) -> DataFrame:
    """The latest version of each file; what is wanted of its text is computed where the text lies, and only that is shuffled."""
    return _latest(table(spark, sf_dir, "source_files"), "file_id", columns)


def _chunks(spark: SparkSession, sf_dir: str, *columns: str | Column) -> DataFrame:
    return _latest(table(spark, sf_dir, "chunks"), "chunk_id", columns)


def _latest(rows: DataFrame, key: str, columns: tuple) -> DataFrame:
    narrow = rows.select(key, "loaded_at", *columns)
    return latest(narrow, key, [key, *narrow.columns[2:]])


FILES = "files AS (SELECT * FROM source_files QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY loaded_at DESC) = 1)"
CHUNKS = "c AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC) = 1)"
P = r"regexp_replace(replace(file_path, '\', '/'), '^(\./)+', '')"
EXT = rf"CASE WHEN regexp_matches({P}, '[^/]\.[^./]+$') THEN '.' || lower(regexp_extract({P}, '\.([^./]+)$', 1)) ELSE '' END"
# The lists stand here a second time, in SQL's own words, so that a wrong one in the library doesn't match itself.
TYPES = """types(ext, language) AS (VALUES ('.py', 'python'), ('.js', 'javascript'), ('.jsx', 'javascript'), ('.ts', 'typescript'), ('.tsx', 'typescript'), ('.go', 'go'), ('.rs', 'rust'),
    ('.java', 'java'), ('.rb', 'ruby'), ('.php', 'php'), ('.c', 'c'), ('.h', 'c'), ('.cpp', 'cpp'), ('.hpp', 'cpp'), ('.cs', 'csharp'), ('.swift', 'swift'), ('.scala', 'scala'), ('.sbt', 'scala'),
    ('.ex', 'elixir'), ('.exs', 'elixir'), ('.dart', 'dart'), ('.lua', 'lua'), ('.sql', 'sql'), ('.sh', 'bash'), ('.bash', 'bash'), ('.zig', 'zig'), ('.hs', 'haskell'), ('.md', 'markdown'),
    ('.yaml', 'yaml'), ('.yml', 'yaml'), ('.toml', 'toml'), ('.json', 'json'), ('.html', 'html'), ('.htm', 'html'), ('.vue', 'vue'), ('.svelte', 'svelte'), ('.css', 'css'), ('.less', 'css'),
    ('.scss', 'scss'), ('.sass', 'scss'))"""
_NAME = f"lower(regexp_extract({P}, '([^/]*)$', 1))"
MINIFIED = rf"regexp_matches({_NAME}, '\.min\.(js|mjs|css)|\.bundle\.(js|css)|-min\.(js|css)|\.prod\.js')"
IGNORED = f"list_has_any(string_split({P}, '/'), ['.git', '.hg', '.svn', '__pycache__', 'node_modules', '.venv', 'venv', '.tox', '.mypy_cache', '.pytest_cache', '.ruff_cache', '.cache', '.next', 'dist', 'build', '.eggs'])"
CODE = "('.py', '.js', '.jsx', '.ts', '.tsx', '.go', '.rs', '.java', '.rb', '.php', '.c', '.h', '.cpp', '.hpp', '.cs', '.swift', '.scala', '.sbt', '.ex', '.exs', '.dart', '.lua', '.sql', '.sh', '.bash', '.zig', '.hs', '.html', '.htm', '.vue', '.svelte', '.css', '.less', '.scss', '.sass')"
DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"
NORM = "sqrt(list_sum(list_transform({a}, lambda x: x::DOUBLE * x::DOUBLE)))"
GUARD = "CASE WHEN {n} > 1e-12 THEN {n} ELSE 1 END"


def _cos(a: str, b: str) -> str:
    return f"{DOT.format(a=a, b=b)} / ({GUARD.format(n=NORM.format(a=a))} * {GUARD.format(n=NORM.format(a=b))})"


# files


@query(f"WITH {FILES}, {TYPES} SELECT file_id, {EXT} AS ext, t.language AS path_language FROM files LEFT JOIN types t ON {EXT} = t.ext")
def ext_lookup(spark, sf_dir):
    files = _files(spark, sf_dir, "file_path")
    return paths.with_language(files).select("file_id", paths.extension(paths.slashes(F.col("file_path"))).alias("ext"), "path_language")


@query(f"WITH {FILES} SELECT file_id FROM files WHERE {EXT} IN {CODE}")
def ext_filter(spark, sf_dir):
    return _files(spark, sf_dir, "file_path").where(paths.extension(paths.slashes(F.col("file_path"))).isin(paths.extensions())).select("file_id")


@query(f"WITH {FILES} SELECT file_id, {MINIFIED} AS minified FROM files")
def minified_filter(spark, sf_dir):
    return _files(spark, sf_dir, "file_path").select("file_id", paths.is_minified(paths.slashes(F.col("file_path"))).alias("minified"))


@query(f"WITH {FILES} SELECT file_id, {IGNORED} AS ignored FROM files")
def ignored_dir_filter(spark, sf_dir):
    return _files(spark, sf_dir, "file_path").select("file_id", paths.is_ignored(paths.slashes(F.col("file_path"))).alias("ignored"))


@query(f"WITH {FILES} SELECT file_id, strlen(source) AS length FROM files LEFT JOIN index_params p USING (repo) WHERE strlen(source) <= coalesce(p.max_file_bytes, 1000000)")
def size_filter(spark, sf_dir):
    limits = table(spark, sf_dir, "index_params").groupBy("repo").agg(F.min("max_file_bytes").alias("most"))
    files = _files(spark, sf_dir, "repo", F.octet_length("source").cast("bigint").alias("length")).join(limits, "repo", "left")
    return files.where(F.col("length") <= F.coalesce("most", F.lit(1_000_000))).select("file_id", "length")


@query(f"WITH {FILES} SELECT file_id, {P} AS file_path FROM files WHERE NOT {IGNORED} AND {EXT} IN {CODE} AND NOT {MINIFIED} AND strlen(source) <= 1000000 AND regexp_matches(source, '\\S')")
def admitted_files(spark, sf_dir):
    return _files(spark, sf_dir, paths.slashes(F.col("file_path")).alias("file_path"), paths.is_admitted().alias("kept")).where("kept").select("file_id", "file_path")


@query(f"WITH {FILES} SELECT {P} AS file_path FROM files ORDER BY string_split({P}, '/')")
def walk_order(spark, sf_dir):
    files = _files(spark, sf_dir, "file_path").select(paths.slashes(F.col("file_path")).alias("file_path"))
    return files.orderBy(paths.walk_key(F.col("file_path")))


# text


@query(f"WITH {FILES} SELECT file_id, 1 + length(substr(source, 1, length(source) // 2)) - length(replace(substr(source, 1, length(source) // 2), chr(10), '')) AS line FROM files WHERE source IS NOT NULL")
def line_at_offset(spark, sf_dir):
    return _files(spark, sf_dir, text.line_at(F.col("source"), F.expr("length(source) div 2")).alias("line")).where("line is not null").select("file_id", "line")


@query(f"WITH {CHUNKS} SELECT chunk_id, printf('%s:%d-%d', file_path, start_line, end_line) AS location FROM c")
def location(spark, sf_dir):
    return _chunks(spark, sf_dir, "file_path", "start_line", "end_line").select("chunk_id", text.location(F.col("file_path"), F.col("start_line"), F.col("end_line")).alias("location"))


MATCH_QUERY = "Return a Snapshot loop += ,"
_LINES = r"list_transform(string_split_regex(content, '\r?\n'), lambda x, i: {'line': start_line + i - 1, 'low': lower(x), 'text': regexp_replace(x, '^\s+|\s+$', '', 'g')})"
_WORDS = "[" + ", ".join(f"'{w}'" for w in MATCH_QUERY.lower().split() if len(w.encode()) >= 2) + "]"


@query(f"WITH {CHUNKS}, l AS (SELECT chunk_id, unnest({_LINES}) AS l FROM c WHERE content IS NOT NULL) SELECT chunk_id, l.line AS line, l.text AS text FROM l WHERE len(list_filter({_WORDS}, lambda w: contains(l.low, w))) > 0")
def match_lines(spark, sf_dir):
    found = text.match_lines(F.col("content"), F.col("start_line"), F.lit(MATCH_QUERY))
    return _chunks(spark, sf_dir, found.alias("found")).select("chunk_id", F.explode("found").alias("m")).select("chunk_id", "m.line", F.col("m.content").alias("text"))


_TRIM = r"regexp_replace({t}, '^\s+|\s+$', '', 'g')"
_START = r"""^(//|#|/\*|\*|\"{3}|''{3})"""  # a quote is written twice in SQL
_BODY = "array_to_string(string_split_regex(" + _TRIM.format(t="content") + r", '\r?\n')[1:{n}], chr(10))"
_ROWS = "list_transform(string_split(" + _TRIM.format(t="{b}") + ", chr(10)), lambda r: " + _TRIM.format(t="r") + ")"


def _doc(n: int) -> str:
    body = _BODY.format(n=n)
    rows = _ROWS.format(b=body)
    return f"{_TRIM.format(t=body)} <> '' AND len({rows}) <= 2 AND NOT regexp_matches({body}, '[:;-]') AND len(list_filter({rows}, lambda r: r <> '' AND NOT regexp_matches(r, '{_START}'))) = 0"


@query(f"WITH {CHUNKS} SELECT chunk_id, {_doc(1)} AS first_line, {_doc(2)} AS two_lines, {_doc(3)} AS three_lines FROM c WHERE content IS NOT NULL")
def doc_comment(spark, sf_dir):
    """The predicate on the first line, the first two and the first three lines of each chunk."""
    rows = F.split(text.trimmed(F.col("content")), r"\r?\n")
    tests = [text.is_doc_comment(F.array_join(F.slice(rows, 1, n), "\n")).alias(name) for n, name in ((1, "first_line"), (2, "two_lines"), (3, "three_lines"))]
    return _chunks(spark, sf_dir, *tests).where("first_line is not null").select("chunk_id", "first_line", "two_lines", "three_lines")


PROBES = ["main", "Main", "_x", "parse_file", "a.b", "a::b.c", "ns\\Thing", "p->next", "find getUserById in FooBar", " Trimmed.Name ", "", "HTTPServer fooB"]


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed probes and every symbol of the chunks."""
    own = table(spark, sf_dir, "chunks").select(F.explode("symbols").alias("query"))
    return own.unionByName(spark.createDataFrame([(p,) for p in PROBES], "query string")).distinct()


_Q = "q AS (SELECT unnest(symbols) AS query FROM chunks UNION SELECT unnest([" + ", ".join("'" + p + "'" for p in PROBES) + "]))"
_T = r"regexp_replace(query, '^\s+|\s+$', '', 'g')"
_ID = "[A-Za-z_][A-Za-z0-9_]*"
_IS = rf"(regexp_full_match({_T}, '{_ID}((::|\\|->|\.){_ID})+') OR regexp_full_match({_T}, '{_ID}') AND regexp_matches({_T}, '[A-Z_]'))"
_SHAPED = r"list_filter(regexp_extract_all(query, '[A-Za-z0-9_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z][A-Za-z0-9]*[A-Z][A-Za-z0-9]*') OR regexp_full_match(w, '[a-z][A-Za-z0-9]*[A-Z][A-Za-z0-9]+'))"
_TAIL = f"CASE WHEN contains({_T}, '::') THEN string_split({_T}, '::')[-1] WHEN contains({_T}, '\\') THEN string_split({_T}, '\\')[-1] WHEN contains({_T}, '->') THEN string_split({_T}, '->')[-1] WHEN contains({_T}, '.') THEN string_split({_T}, '.')[-1] ELSE {_T} END"


@query(f"WITH {_Q} SELECT query, {_IS} AS is_symbol FROM q")
def symbol_query(spark, sf_dir):
    return _probes(spark, sf_dir).select("query", text.is_symbol_query(F.col("query")).alias("is_symbol"))


@query(f"WITH {_Q} SELECT query, {_TAIL} AS tail FROM q")
def symbol_tail(spark, sf_dir):
    return _probes(spark, sf_dir).select("query", text.symbol_tail(F.col("query")).alias("tail"))


@query(f"WITH {_Q} SELECT query, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN {_IS} THEN [{_TAIL}, {_T}] ELSE [] END, {_SHAPED}))), ' ') AS names FROM q")
def query_names(spark, sf_dir):
    return _probes(spark, sf_dir).select("query", F.array_join(text.query_names(F.col("query")), " ").alias("names"))


# chunks

_E0_JSON = f"q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0), j AS (SELECT vec_id, row_number() OVER (ORDER BY {_cos('e.embedding', 'q.qe')} DESC, vec_id) AS place FROM embeddings e, q QUALIFY place <= 10)"


@query(f"WITH {CHUNKS} SELECT chunk_id FROM c WHERE language IN ('go', 'rust') OR file_path IN (SELECT min(file_path) FROM c)")
def selector_union(spark, sf_dir):
    chunks = _chunks(spark, sf_dir, "language", "file_path")
    first = chunks.agg(F.min("file_path")).first()[0]
    return ranking.selected(chunks, ["go", "rust"], [first] if first is not None else []).select("chunk_id")


@query(f"WITH {CHUNKS} SELECT chunk_id FROM c")
def selector_fallback(spark, sf_dir):
    return ranking.selected(_chunks(spark, sf_dir, "language", "file_path"), ["cobol"], ["no/such/path"]).select("chunk_id")


@query(f"WITH {CHUNKS} SELECT count(DISTINCT file_path) AS indexed_files, count(*) AS total_chunks, (SELECT string_agg(language || '=' || n, ',' ORDER BY language) FROM (SELECT language, count(*) AS n FROM c WHERE language IS NOT NULL GROUP BY 1)) AS languages FROM c")
def index_stats(spark, sf_dir):
    stats = index.index_stats(_chunks(spark, sf_dir, "file_path", "language"))
    entries = F.transform(F.array_sort(F.map_entries("languages")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return stats.select("indexed_files", "total_chunks", F.array_join(entries, ",").alias("languages"))


@query(f"WITH {CHUNKS} SELECT language, count(*) AS n FROM c WHERE language IS NOT NULL GROUP BY language")
def language_counts(spark, sf_dir):
    return _chunks(spark, sf_dir, "language").where("language is not null").groupBy("language").agg(F.count("*").alias("n"))


@query(f"WITH {CHUNKS} SELECT file_path, string_agg(chunk_id, ',' ORDER BY chunk_id) AS chunk_ids FROM c GROUP BY file_path")
def file_mapping(spark, sf_dir):
    ids = F.transform(F.array_sort(F.collect_list("chunk_id")), lambda x: x.cast("string"))
    return _chunks(spark, sf_dir, "file_path").groupBy("file_path").agg(F.array_join(ids, ",").alias("chunk_ids"))


_DEF = r"^[ \t]*(?:async )?def (\w+)"


@query(
    f"WITH {FILES}, {CHUNKS}, l AS (SELECT file_id, unnest(list_transform(string_split(source, chr(10)), lambda x, i: {{'line': i, 'name': regexp_extract(x, '{_DEF}', 1)}})) AS s FROM files WHERE source IS NOT NULL), "
    "s AS (SELECT file_id, s.line AS line, s.name AS name FROM l WHERE s.name <> '') "
    "SELECT c.chunk_id, coalesce((SELECT string_agg(s.name, ' ' ORDER BY s.line) FROM s WHERE s.file_id = c.file_id AND s.line BETWEEN c.start_line AND c.end_line), '') AS names FROM c"
)
def symbol_chunk_join(spark, sf_dir):
    """Definitions told by a pattern, so that SQL can tell them too, joined to the chunks by their lines."""
    lines = F.transform(F.split("source", "\n"), lambda x, i: F.struct(F.regexp_extract(x, _DEF, 1).alias("name"), (i + 1).alias("line")))
    named = _files(spark, sf_dir, F.filter(lines, lambda r: r["name"] != "").alias("named")).select("file_id", F.explode("named").alias("s"))
    defined = named.select("file_id", "s.name", "s.line")
    chunks = _chunks(spark, sf_dir, "file_id", "start_line", "end_line")
    return index.attach_symbols(chunks, defined, ("file_id",), ("chunk_id",)).select("chunk_id", F.array_join("symbols", " ").alias("names"))


def _whole_files(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] = ("file_id", "file_path", "source")) -> DataFrame:
    """The latest version of each file with its text, which stays where it lies unless the file comes again."""
    files = spread(newest(table(spark, sf_dir, "source_files").select(*columns, "loaded_at"), "file_id", list(columns)))
    return files.withColumn("language", paths.language(paths.slashes(F.col("file_path"))))


ADMITTED = f"NOT {IGNORED} AND {EXT} IN (SELECT ext FROM types) AND NOT {MINIFIED} AND strlen(source) <= 1000000 AND regexp_matches(source, '\\S')"


@query()
def chunk_source_files(spark, sf_dir):
    """Admitted files cut along their outlines, with the symbols of each chunk."""
    files = paths.admitted(_whole_files(spark, sf_dir), text_files=True)
    return index.chunk_files(files, keys=("file_id", "file_path"))


@query(f"WITH {FILES}, {TYPES} SELECT file_id, true AS whole, true AS ordered, true AS placed, true AS small FROM files WHERE {ADMITTED}")
def chunk_checks(spark, sf_dir):
    """What must hold of the chunks of every admitted file.

    whole: without white space, chunks make up the text of a file that is split
    as plain text, and never more than the text of any file. ordered: chunks
    follow each other. placed: each is what stands on its lines. small: no chunk
    is larger than the cap of merged spans unless it is one node between the
    budget and the cap widened to its block.
    """
    files = paths.admitted(_whole_files(spark, sf_dir), text_files=True)
    outlined = index.outline_files(files.withColumn("body", F.col("source")), keys=("file_id", "body")).withColumnRenamed("body", "source")
    rows = F.split("source", "\n")
    bare = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    joined = bare(F.array_join(F.transform("chunks", lambda c: c["content"]), ""))
    plain = ~F.coalesce(F.col("language").isin(sorted(STRUCTURED)), F.lit(False))
    starts = F.transform("chunks", lambda c: c["start_line"])
    on_lines = lambda c: F.concat(F.array_join(F.slice(rows, c["start_line"].cast("int"), (c["end_line"] - c["start_line"] + 1).cast("int")), "\n"), F.lit("\n"))
    placed = F.forall("chunks", lambda c: F.contains(on_lines(c), c["content"]))
    return outlined.select(
        "file_id",
        F.when(plain, joined == bare("source")).otherwise(F.length(joined) <= F.length(bare("source"))).alias("whole"),
        (starts == F.array_sort(starts)).alias("ordered"),
        placed.alias("placed"),
        F.forall("chunks", lambda c: F.octet_length(c["content"]) <= 3 * 1500).alias("small"),
    )


@query()
def extract_symbols(spark, sf_dir):
    """Definitions with their kind and line; two of one name on one line, as minified text has them, come once."""
    return index.symbols_of(_whole_files(spark, sf_dir), ("file_id",)).dropDuplicates(["file_id", "line", "name", "kind"])


@query(
    rf"WITH {FILES}, l AS (SELECT file_id, unnest(list_transform(string_split(source, chr(10)), lambda x, i: {{'line': i, 'name': regexp_extract(x, '^func\s+([A-Za-z]\w*)\s*[(\[]', 1)}})) AS s FROM files WHERE {EXT} = '.go' AND source IS NOT NULL) SELECT DISTINCT file_id, s.line AS line, s.name AS name FROM l WHERE s.name <> ''"
)
def go_functions(spark, sf_dir):
    """Functions of Go, which stand at the beginning of a line, so that SQL can tell them too."""
    files = _whole_files(spark, sf_dir).where("language = 'go'")
    return index.symbols_of(files, ("file_id",)).where("kind = 'function'").select("file_id", "line", "name").distinct()


@query()
def result_json(spark, sf_dir):
    """A search over the files of the table, as one row of JSON."""
    found = index.Index.from_files(paths.admitted(_whole_files(spark, sf_dir)), HashEncoder()).search("report snapshot of the index", 5)
    return spark.createDataFrame([(index.result_json(found),)], "json string")


@query(f"""WITH {_E0_JSON} SELECT '[' || string_agg('{{"chunk":{{"vec_id":' || vec_id || ',"language":null}},"score":' || place || '.0}}', ',' ORDER BY place) || ']' AS json FROM j""")
def ranked_json(spark, sf_dir):
    """The JSON form of results, nulls kept and empty match lines left out, over the vectors nearest to the first."""
    rows = _embeddings(spark, sf_dir)
    near = ranking.cosine_topk(rows, _probe(rows, "vec_id"), 10, ["vec_id"])
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("similarity"), "vec_id"))
    results = near.select(F.struct("vec_id", F.lit(None).cast("string").alias("language")).alias("chunk"), place.cast("double").alias("score"), F.array().cast("array<struct<line:bigint,content:string>>").alias("match_lines")).orderBy("score")
    return spark.createDataFrame([(index.result_json(results),)], "json string")


# vectors


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _probe(rows: DataFrame, key: str) -> list[float]:
    row = rows.where(F.col(key) == 0).select("embedding").first()
    return list(row[0]) if row else []


_E0 = "q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0)"
_SIM = f"s AS (SELECT e.*, {_cos('e.embedding', 'q.qe')} AS sim FROM embeddings e, q)"


@query(f"WITH {_E0}, {_SIM} SELECT vec_id, round(sim, 6) AS similarity FROM s ORDER BY sim DESC, vec_id LIMIT 50")
def cosine_topk(spark, sf_dir):
    rows = _embeddings(spark, sf_dir)
    return ranking.cosine_topk(rows, _probe(rows, "vec_id"), 50, ["vec_id"]).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_E0}, {_SIM} SELECT vec_id, round(sim, 6) AS similarity FROM s WHERE label IN (1, 3) ORDER BY sim DESC, vec_id LIMIT 20")
def cosine_topk_selected(spark, sf_dir):
    rows = _embeddings(spark, sf_dir)
    return ranking.cosine_topk(rows.where(F.col("label").isin(1, 3)), _probe(rows, "vec_id"), 20, ["vec_id"]).select("vec_id", F.round("similarity", 6).alias("similarity"))


_V = "v AS (SELECT DISTINCT ON (vec_id) vec_id, chunk_id, embedding FROM chunk_vectors)"


@query(f"WITH {_V}, n AS (SELECT vec_id, embedding, {NORM.format(a='embedding')} AS n FROM v WHERE embedding IS NOT NULL) SELECT vec_id, round(n, 6) AS norm, round(embedding[1]::DOUBLE / {GUARD.format(n='n')}, 6) AS x0, round(embedding[-1]::DOUBLE / {GUARD.format(n='n')}, 6) AS x_last FROM n")
def l2_normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "chunk_vectors").dropDuplicates(["vec_id"]).where("embedding is not null")
    unit = vectors.normalized(F.col("embedding"))
    return rows.select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"), F.round(F.element_at(unit, 1), 6).alias("x0"), F.round(F.element_at(unit, -1), 6).alias("x_last"))


def _pool(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    rows = _embeddings(spark, sf_dir)
    pool = ranking.cosine_topk(rows, _probe(rows, "vec_id"), size, ["vec_id"])
    return pool.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("similarity"), "vec_id")).cast("bigint"))


_POOL = f"{_E0}, {_SIM}, pool AS (SELECT *, row_number() OVER (ORDER BY sim DESC, vec_id) AS rank FROM s ORDER BY sim DESC, vec_id LIMIT 50)"
_DEFS = "defs AS (SELECT vec_id, row_number() OVER (ORDER BY rank) AS rank FROM pool WHERE label = 3)"
_FUSED = "f AS (SELECT vec_id, sum(w / (60 + rank)) AS score FROM (SELECT vec_id, rank, 1.0 AS w FROM pool UNION ALL SELECT vec_id, rank, 1.0 FROM defs) GROUP BY vec_id)"


@query(f"WITH {_POOL}, {_DEFS}, {_FUSED} SELECT vec_id, round(score, 10) AS score FROM f")
def weighted_rrf(spark, sf_dir):
    """The pool and its definitions as signals; a third of weight 0 adds nothing."""
    pool = _pool(spark, sf_dir, 50)
    defined = pool.where("label = 3").withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("rank")).cast("bigint"))
    nothing = _embeddings(spark, sf_dir).select("vec_id", F.col("vec_id").alias("rank"), F.lit(0.0).alias("weight"))
    signals = pool.select("vec_id", "rank", F.lit(1.0).alias("weight")).unionByName(defined.select("vec_id", "rank", F.lit(1.0).alias("weight"))).unionByName(nothing)
    return ranking.weighted_rrf(signals, ["vec_id"]).select("vec_id", F.round("score", 10).alias("score"))


@query(f"WITH {_POOL}, {_DEFS}, {_FUSED} SELECT vec_id, round(score, 10) AS score, row_number() OVER (ORDER BY score DESC, vec_id) AS place FROM f ORDER BY score DESC, vec_id LIMIT 10")
def hybrid_search(spark, sf_dir):
    """The flagship: cosine pool, fused with a definition signal (rows of label 3 stand for chunks that define the name asked for)."""
    pool = _pool(spark, sf_dir, 50).withColumn("symbols", F.when(F.col("label") == 3, F.array(F.lit("probe"))).otherwise(F.array().cast("array<string>")))
    best = ranking.fused(pool, F.array(F.lit("probe")), ranking.SearchParams(), ["vec_id"], 10)
    return ranking.low_score_filter(best, 0.12).select("vec_id", F.round("score", 10).alias("score"), "place")


@query(f"WITH {_E0}, {_SIM}, t AS (SELECT *, max(sim) OVER (PARTITION BY label) AS top, count(*) OVER (PARTITION BY label) AS n FROM s) SELECT vec_id, label FROM t WHERE n <= 1 OR (top > 0 AND sim >= top * 0.5)")
def low_score_filter(spark, sf_dir):
    rows = _embeddings(spark, sf_dir)
    scored = rows.withColumn("score", vectors.cosine(F.col("embedding"), vectors.literal(_probe(rows, "vec_id"))))
    return ranking.low_score_filter(scored, 0.5, ["label"]).select("vec_id", "label")


def _chunk_search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the chunks that exist, with their symbols; no text."""
    vectors_ = table(spark, sf_dir, "chunk_vectors").where(F.size("embedding") == 64).groupBy("chunk_id").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return vectors_.join(_chunks(spark, sf_dir, "symbols"), "chunk_id")


def _chunk_probe(spark: SparkSession, sf_dir: str) -> tuple[list[float], str] | None:
    """Vector and first symbol of the first chunk that has both; found by the keys, then fetched by its id."""
    with_vector = table(spark, sf_dir, "chunk_vectors").where(F.size("embedding") == 64).select("chunk_id")
    named = table(spark, sf_dir, "chunks").where("size(symbols) > 0").select("chunk_id")
    first = named.join(with_vector, "chunk_id", "left_semi").agg(F.min("chunk_id")).first()[0]
    if first is None:
        return None
    own = table(spark, sf_dir, "chunk_vectors").where((F.size("embedding") == 64) & (F.col("chunk_id") == first)).agg(F.min_by("embedding", "vec_id")).first()[0]
    names = latest(table(spark, sf_dir, "chunks").where(F.col("chunk_id") == first), "chunk_id", ["symbols"]).first().symbols
    return list(own), names[0]


_CS = f"{CHUNKS}, v AS (SELECT chunk_id, arg_min(embedding, vec_id) AS embedding FROM chunk_vectors WHERE len(embedding) = 64 GROUP BY chunk_id), r AS (SELECT v.chunk_id, v.embedding, c.symbols FROM v JOIN c ON v.chunk_id = c.chunk_id), q AS (SELECT embedding AS qe, symbols[1] AS name FROM r WHERE len(symbols) > 0 ORDER BY chunk_id LIMIT 1)"
_CPOOL = f"s AS (SELECT r.*, q.name, {_cos('r.embedding', 'q.qe')} AS sim FROM r, q), pool AS (SELECT *, row_number() OVER (ORDER BY sim DESC, chunk_id) AS rank FROM s ORDER BY sim DESC, chunk_id LIMIT 50)"


@query(f"WITH {_CS}, {_CPOOL} SELECT chunk_id, rank, row_number() OVER (ORDER BY rank) AS definition_rank FROM pool WHERE list_contains(symbols, name)")
def definition_list(spark, sf_dir):
    rows = _chunk_search_rows(spark, sf_dir)
    probe = _chunk_probe(spark, sf_dir)
    pool = ranking.cosine_topk(rows, probe[0] if probe else [], 50, ["chunk_id"])
    ranked = pool.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("similarity"), "chunk_id")).cast("bigint"))
    return ranking.definition_list(ranked, text.query_names(F.lit(probe[1] if probe else ""))).select("chunk_id", "rank", "definition_rank")


@query(
    f"WITH {_CS}, {_CPOOL}, d AS (SELECT chunk_id, row_number() OVER (ORDER BY rank) AS rank FROM pool WHERE list_contains(symbols, name)), "
    "f AS (SELECT chunk_id, sum(1.0 / (60 + rank)) AS score FROM (SELECT chunk_id, rank FROM pool UNION ALL SELECT chunk_id, rank FROM d) GROUP BY chunk_id), "
    "g AS (SELECT chunk_id, round(score, 10) AS score, row_number() OVER (ORDER BY score DESC, chunk_id) AS place FROM f ORDER BY score DESC, chunk_id LIMIT 10), "
    "m AS (SELECT chunk_id, array_to_string(list_transform(list_filter(list_transform(string_split_regex(content, '\\r?\\n'), lambda x, i: {'line': start_line + i - 1, 'text': x}), lambda r: contains(lower(r.text), lower(q.name))), lambda r: r.line || ':' || regexp_replace(r.text, '^\\s+|\\s+$', '', 'g')), chr(10)) AS match_lines FROM c, q) "
    "SELECT chunk_id, score, place, coalesce(match_lines, '') AS match_lines FROM g JOIN m USING (chunk_id)"
)
def hybrid_chunk_search(spark, sf_dir):
    """The whole search over the chunks and their vectors, for the first symbol as the query, with the lines that match."""
    probe = _chunk_probe(spark, sf_dir)
    contents = table(spark, sf_dir, "chunks").select("chunk_id", "content", "start_line", "loaded_at")
    found = ranking.hybrid_search(_chunk_search_rows(spark, sf_dir), probe[0] if probe else [], probe[1] if probe else "", 10, ranking.SearchParams(), ["chunk_id"], contents=contents)
    lines = F.array_join(F.transform("match_lines", lambda m: F.concat(m["line"].cast("string"), F.lit(":"), m["content"])), "\n")
    return found.select("chunk_id", F.round("score", 10).alias("score"), "place", lines.alias("match_lines"))


@query(
    f"WITH q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id, {_cos('e.embedding', 'q.qe')} AS sim FROM embeddings e, q) "
    "SELECT query_id, vec_id AS key, round(sim, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s QUALIFY rank <= 5"
)
def batch_search(spark, sf_dir):
    rows = _embeddings(spark, sf_dir)
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return ranking.batch_topk(rows, asked, 5, "vec_id").select("query_id", "key", F.round("similarity", 6).alias("similarity"), "rank")


def _buckets(rows: DataFrame, key: str, content: Column) -> DataFrame:
    words = F.regexp_extract_all(F.lower(content), F.lit("([a-z0-9]+)"), F.lit(1))
    return rows.select(key, F.explode(words).alias("w")).select(key, HashEncoder().bucket(F.col("w").cast("binary")).alias("bucket")).groupBy(key, "bucket").agg(F.count("*").alias("n"))


_B = "b AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS bucket, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents) GROUP BY 1, 2)"


@query(f"WITH {_B} SELECT * FROM b")
def hash_embed(spark, sf_dir):
    return _buckets(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


HASH_QUERY = "search the index for a snapshot of the parser"


@query(
    f"WITH {_B}, qb AS (SELECT ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS bucket, count(*) AS m FROM (SELECT unnest(string_split('{HASH_QUERY}', ' ')) AS w) GROUP BY 1), "
    "d AS (SELECT doc_id, sqrt(sum(n * n)) AS dn FROM b GROUP BY doc_id), s AS (SELECT b.doc_id, sum(n * m) AS dot FROM b JOIN qb USING (bucket) GROUP BY 1) "
    "SELECT doc_id, round(coalesce(dot, 0) / (dn * (SELECT sqrt(sum(m * m)) FROM qb)), 6) AS similarity FROM d LEFT JOIN s USING (doc_id) ORDER BY 2 DESC, 1 LIMIT 20"
)
def hash_search(spark, sf_dir):
    """A text query over all documents by hashed vectors; similarities are compared as rounded, then ids."""
    encoder = HashEncoder()
    rows = encoder.encode(table(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null"), "text")
    scored = rows.select("doc_id", F.round(vectors.cosine(F.col("embedding"), vectors.literal(encoder.encode_one(HASH_QUERY))), 6).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), "doc_id").limit(20)
