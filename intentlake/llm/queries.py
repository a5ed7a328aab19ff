"""Queries pN_... over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intentlake.llm import leakage, machine_made, mixing, near_duplicates, neighbours, spam, splitting, syntax
from intentlake.plans.runtime import table


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "index_params"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_pieces(spark, sf_dir).where("n_pieces > 1").select("chunk_id").distinct()


def p1_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the pieces of every chunk that is cut: within its size, overlapping as wanted (less only where a piece is too short), one after the other, whole."""
    chunks, params = table(spark, sf_dir, "chunks"), table(spark, sf_dir, "index_params")
    limits = params.select("repo", F.coalesce("chunk_size", F.lit(1500)).alias("size"), F.coalesce("overlap_chars", F.lit(0)).alias("overlap"))
    texts = chunks.groupBy("chunk_id").agg(F.min(F.struct("repo", F.length("content").alias("n"), "start_line")).alias("c")).select("chunk_id", "c.*").join(limits, "repo", "left")
    piece = F.struct("piece_no", "char_start", "char_end", F.length("content").alias("n"), "start_line", "end_line", (F.length("content") - F.length(F.replace("content", F.lit("\n"))) - F.endswith("content", F.lit("\n")).cast("int")).alias("breaks"))
    pieces = splitting.split_oversized(chunks, params).groupBy("chunk_id").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    joined = pieces.join(texts, "chunk_id").withColumns({"size": F.coalesce("size", F.lit(1500)), "overlap": F.coalesce("overlap", F.lit(0))})
    follows = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p") - 1), lambda a, b: a["char_end"] - b["char_start"] == F.least("overlap", F.col("size") - 1))
    return joined.select(
        "chunk_id",
        F.forall("p", lambda x: (x["n"] <= F.col("size")) & (x["n"] == x["char_end"] - x["char_start"])).alias("within_size"),
        F.forall(follows, lambda x: x).alias("overlap_kept"),
        ((F.col("p")[0]["char_start"] == 0) & (F.element_at("p", -1)["char_end"] == F.col("n"))).alias("whole"),
        F.forall("p", lambda x: x["end_line"] - x["start_line"] == x["breaks"]).alias("lines_fit"),
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.check_files(table(spark, sf_dir, "source_files")).where("n_errors > 0").select("file_id").distinct()


def p2_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.check_files(table(spark, sf_dir, "source_files")).where("n_errors > 0").distinct()


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.failure_rates(table(spark, sf_dir, "source_files"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = near_duplicates.similar_pairs(table(spark, sf_dir, "chunks"), "chunk_id", "content")
    return pairs.select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(table(spark, sf_dir, "chunks"), "chunk_id", "content").withColumnRenamed("id", "chunk_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbours.most_similar(table(spark, sf_dir, "chunk_vectors"), "vec_id", "embedding", floor=0.85)
    return near.where("cosine >= 0.85").select(F.least("id", "neighbour").alias("vec_a"), F.greatest("id", "neighbour").alias("vec_b")).distinct()


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbours.most_similar(table(spark, sf_dir, "chunk_vectors"), "vec_id", "embedding")
    return near.select(F.col("id").alias("vec_id"), "neighbour", "place", F.round("cosine", 6).alias("cosine"))


def p4_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.measured_recall(table(spark, sf_dir, "chunk_vectors"), "vec_id", "embedding")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return machine_made.machine_made(table(spark, sf_dir, "source_files")).where("generated or minified or vendored or data").select("file_id")


def p5_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = machine_made.machine_made(table(spark, sf_dir, "source_files"))
    return made.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in made.dtypes])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


def p6_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.removal_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_frame(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).where("not reachable").select("source")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.reached(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = mixing.temperature(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    return even.select("source", *[F.round(c, 6).alias(c) for c in ("share", "exponent", "weight", "reached_share")])


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.spam_scores(table(spark, sf_dir, "documents")).where("is_spam").select("doc_id").distinct()


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.spam_scores(table(spark, sf_dir, "documents")).select("doc_id", "lang", F.round("distance", 3).alias("distance"), F.round("direction", 6).alias("direction"), F.round("pushed", 6).alias("pushed"), "is_spam")


def queries() -> dict:
    own = [p1_found, p1_pieces, p1_checks, p2_found, p2_errors, p2_rates, p3_found, p3_groups, p4_found, p4_neighbours, p4_recall, p5_found, p5_features, p6_found, p6_removals, p7_found, p7_shares, p7_repeats, p7_temperature, p8_found, p8_scores]
    return {f.__name__: f for f in own}


_C = "c AS (SELECT DISTINCT ON (chunk_id) * FROM chunks)"
_PAIRS = """t AS (SELECT chunk_id, regexp_extract_all(lower(content), '[a-z0-9_]+') AS w FROM c WHERE content IS NOT NULL),
        s AS (SELECT DISTINCT chunk_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM t WHERE len(w) >= 40),
        n AS (SELECT chunk_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT x.chunk_id AS chunk_a, y.chunk_id AS chunk_b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.chunk_id < y.chunk_id GROUP BY 1, 2)"""
_LONG = "length(content) > coalesce(p.chunk_size, 1500)"
_HITS = """w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
        v AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
        d AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: {'pos': i - 1, 'g': array_to_string(w[i:i + 11], ' ')})) AS s FROM w WHERE len(w) >= 12),
        e AS (SELECT DISTINCT unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM v WHERE len(w) >= 12)"""
SQL = {
    "p1_checks": f"WITH {_C} SELECT chunk_id, true AS within_size, true AS overlap_kept, true AS whole, true AS lines_fit FROM c LEFT JOIN index_params p USING (repo) WHERE {_LONG}",
    "p4_found": """WITH d AS (SELECT DISTINCT ON (vec_id) vec_id, embedding::DOUBLE[64] AS e FROM chunk_vectors WHERE len(embedding) = 64),
        v AS (SELECT vec_id, e FROM d WHERE list_sum(list_transform(e::DOUBLE[], lambda x: x * x)) > 0),
        s AS (SELECT a.vec_id AS a, b.vec_id AS b, array_cosine_similarity(a.e, b.e) AS sim FROM v a JOIN v b ON a.vec_id <> b.vec_id),
        k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(sim, 9) DESC, b) <= 5)
        SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM k WHERE sim >= 0.85""",
    "p6_removals": f"""WITH {_HITS}, h AS (SELECT DISTINCT doc_id, s.pos AS pos FROM d JOIN e ON d.s.g = e.g),
        b AS (SELECT *, (pos > coalesce(lag(pos) OVER (PARTITION BY doc_id ORDER BY pos), -100) + 12)::INT AS begins FROM h),
        r AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM b)
        SELECT doc_id, min(pos) AS first_word, max(pos) + 12 AS end_word FROM r GROUP BY doc_id, run""",
    "p1_found": f"WITH {_C} SELECT chunk_id FROM c LEFT JOIN index_params p USING (repo) WHERE length(content) > coalesce(p.chunk_size, 1500)",
    "p3_found": f"WITH {_C}, {_PAIRS} SELECT chunk_a, chunk_b FROM p JOIN n a ON a.chunk_id = chunk_a JOIN n b ON b.chunk_id = chunk_b WHERE shared >= 0.6 * (a.n + b.n - shared)",
    "p3_groups": f"""WITH RECURSIVE {_C}, {_PAIRS},
        x AS (SELECT chunk_a, chunk_b FROM p JOIN n a ON a.chunk_id = chunk_a JOIN n b ON b.chunk_id = chunk_b WHERE shared >= 0.6 * (a.n + b.n - shared)),
        k AS (SELECT chunk_id, list_sort(list(g)) AS key FROM s GROUP BY chunk_id),
        m AS (SELECT chunk_id, min(chunk_id) OVER (PARTITION BY key) AS class_id FROM k),
        l AS (SELECT DISTINCT a.class_id AS a, b.class_id AS b FROM x JOIN m a ON a.chunk_id = chunk_a JOIN m b ON b.chunk_id = chunk_b WHERE a.class_id <> b.class_id),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r AS (SELECT DISTINCT class_id AS node, class_id AS root FROM m UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
        o AS (SELECT node, min(root) AS group_id FROM r GROUP BY node),
        d AS (SELECT a, count(*) AS links FROM e GROUP BY a)
        SELECT chunk_id, class_id, group_id, coalesce(links, 0) AS links FROM m JOIN o ON o.node = class_id LEFT JOIN d ON d.a = class_id""",
    "p6_found": """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
        v AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
        d AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM w WHERE len(w) >= 12),
        e AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM v WHERE len(w) >= 12)
        SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (g)""",
    "p7_found": """WITH t AS (SELECT regexp_replace(lower(source), '^\\s+|\\s+$', '', 'g') AS source, len(regexp_extract_all(text, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\s]')) AS n FROM documents WHERE text IS NOT NULL),
        s AS (SELECT m.source, m.target_share, m.max_repeats, coalesce(sum(t.n), 0) AS n FROM mix_targets m LEFT JOIN t ON t.source = m.source GROUP BY ALL)
        SELECT source FROM s WHERE max_repeats * n < target_share * (SELECT sum(n) FROM s)""",
}


def oracle_sql() -> dict[str, str]:
    return SQL
