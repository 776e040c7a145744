"""The registered queries of the library, each beside its DuckDB twin.

Doubles are rounded to six places, every tie is broken by a key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesela.functions import chunking, models, structured, text
from tesela.operators import chunks as chunk_ops
from tesela.operators import blocks, embedcache, evaluation, fusion, lexical, querylog, vectors, verify
from tesela.operators import sync as sync_ops
from tesela.operators.topfused import top_fused, top_fused_groups
from tesela.plans import assistant
from tesela.sources import files as file_ops
from tesela.sources import logstore, snapshots
from tesela.sources.stage import spread, staged
from tesela.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOP_K = 7
ALPHAS = (0.0, 0.3, 0.5, 0.7, 1.0)


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOPWORDS_ES) + "]"
_TOKENS = rf"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\pL\pN_]+'), lambda t: length(t) > 1 AND NOT list_contains({_STOP}, strip_accents(t)))"

# ---------------------------------------------------------------- text


@query(r"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  chr(9) || text || chr(9) || '  ' || repeat(chr(10), 4) || 'x ', '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', '') AS cleaned
FROM documents
""")
def clean_text(spark, sf_dir):
    dirty = F.concat(F.lit("\t"), "text", F.lit("\t  "), F.lit("\n\n\n\nx "))
    return documents(spark, sf_dir).select("doc_id", text.clean(dirty).alias("cleaned"))


@query(r"SELECT doc_id, regexp_replace(lower(strip_accents(text)), '\s+', ' ', 'g') AS norm FROM documents")
def strip_accents_norm(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.normalized(F.col("text")).alias("norm"))


@query(f"SELECT doc_id, len(toks) AS n_tokens, array_to_string(toks, ' ') AS tokens FROM (SELECT doc_id, {_TOKENS} AS toks FROM documents)")
def tokenize_es(spark, sf_dir):
    toks = text.tokens(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.size(toks).cast("long").alias("n_tokens"), F.array_join(toks, " ").alias("tokens"))


_SUFFIXES = "CASE doc_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.TXT' WHEN 2 THEN '.md' ELSE '.docx' END"


@query(f"""
WITH f AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Acta_' ELSE '' END || source || {_SUFFIXES} AS name FROM documents)
SELECT doc_id, name, contains(lower(name), 'acta') AS is_minutes FROM f WHERE regexp_extract(lower(name), '\\.([^.]*)$', 1) IN ('pdf', 'txt', 'md')
""")
def source_filter_acta(spark, sf_dir):
    suffix = F.when(F.col("doc_id") % 4 == 0, ".pdf").when(F.col("doc_id") % 4 == 1, ".TXT").when(F.col("doc_id") % 4 == 2, ".md").otherwise(".docx")
    named = documents(spark, sf_dir).select("doc_id", F.concat(F.when(F.col("doc_id") % 3 == 0, "Acta_").otherwise(""), "source", suffix).alias("name"))
    return named.filter(file_ops.is_supported(F.col("name"))).select("doc_id", "name", file_ops.is_minutes(F.col("name")).alias("is_minutes"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def file_hash(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@query("SELECT doc_id, source || '::p' || doc_id || '::c0' AS chunk_id FROM documents")
def chunk_ids(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.chunk_id(F.col("source"), F.col("doc_id"), F.lit(0)).alias("chunk_id"))


_WITH_TABLE = "text || chr(10) || chr(10) || '| key | value |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || doc_id || ' | x |' || chr(10) || chr(10) || 'fin ' || doc_id"


@query(rf"""
WITH cut AS (
  SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS place
  FROM (SELECT doc_id, string_split(regexp_replace({_WITH_TABLE}, '(?m)(?:^[ \t]*\|.*\|[ \t]*(?:\n|\z)){{2,}}', chr(1) || '\0' || chr(1), 'g'), chr(1)) AS parts FROM documents)
), trimmed AS (SELECT doc_id, place, place % 2 = 0 AS is_table, regexp_replace(regexp_replace(part, '^\s+', ''), '\s+$', '') AS s FROM cut)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS INTEGER) AS ord, is_table, CAST(length(s) AS INTEGER) AS n_chars, sha256(s) AS sha256 FROM trimmed WHERE s <> ''
""")
def table_segments(spark, sf_dir):
    """Each document with a pipe table after it."""
    table = F.concat(F.lit("\n\n| key | value |\n| --- | --- |\n| "), "doc_id", F.lit(" | x |\n\nfin "), "doc_id")
    parts = documents(spark, sf_dir).select("doc_id", F.posexplode(chunking.table_segments(F.concat("text", table))).alias("ord", "s"))
    return parts.select("doc_id", "ord", "s.is_table", F.length("s.text").alias("n_chars"), F.sha2("s.text", 256).alias("sha256"))


def _pages(spark, sf_dir):
    return documents(spark, sf_dir).select("source", F.col("doc_id").alias("page"), "text", F.lit("native").alias("extraction"))


@query()
def recursive_chunks(spark, sf_dir):
    return chunk_ops.chunk_pages(_pages(spark, sf_dir)).select("chunk_id", "source", "page", "chunk_index", "section_hint", "is_table", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("sha256"))


# RE2 reads the heading pattern with its own flags; white space and digits are ASCII in these tables
_HEAD_RE2 = text.HEADING.replace("(?dimU)", "(?im)")
_BEFORE_RE2 = "(?im)\\A((?s:.*?))(?:" + text.HEADING.removeprefix("(?dimU)") + ")"


@query(f"""
WITH h AS (
  SELECT doc_id, source, text, list_transform(regexp_extract_all(text, '{_HEAD_RE2}', 1), lambda x: substr(trim(x, ' ' || chr(9) || chr(10) || chr(13)), 1, 120)) AS heads, length(regexp_extract(text, '{_BEFORE_RE2}', 1)) AS begins FROM documents
), o AS (SELECT *, CASE WHEN len(heads) > 0 AND begins <= 0.33 * length(text) THEN heads[1] ELSE '' END AS own, CASE WHEN len(heads) > 0 THEN heads[-1] END AS lasth FROM h)
SELECT doc_id, source, CAST(len(heads) AS INTEGER) AS n_headings, own, coalesce(nullif(own, ''), last_value(lasth IGNORE NULLS) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS section_hint FROM o
""")
def section_hint_inherit(spark, sf_dir):
    """Documents as pages of their source."""
    heads = text.headings(F.col("text"))
    rows = documents(spark, sf_dir).select("doc_id", "source", F.size(heads).alias("n_headings"), text.section_hint(F.col("text")).alias("own"), F.try_element_at(heads, F.lit(-1)).alias("lasth"))
    hint = chunk_ops.inherited_hint(F.col("own"), F.col("lasth"), Window.partitionBy("source").orderBy("doc_id"))
    return rows.select("doc_id", "source", "n_headings", "own", hint.alias("section_hint"))


@query(r"""
WITH q AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations)
SELECT id, regexp_matches(text, '(?i)\s+y\s+(?:qu[eé]|c[oó]mo|cu[aá]ndo|cu[aá]nto|cu[aá]l(?:es)?|qui[eé]n(?:es)?|d[oó]nde|por qu[eé]|para qu[eé])(?:[^\pL\pN_]|$)|\?\s*[¿\pL\pN_].*\?|(?:^|[^\pL\pN_])adem[aá]s(?:[^\pL\pN_]|$)') AS compound,
  length(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')) >= 6 AND (regexp_matches(text, '\?\s*$') OR regexp_matches(text, '^\s*¿')) AS like_question
FROM q
""")
def compound_question(spark, sf_dir):
    docs = documents(spark, sf_dir).select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    turns = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), "text")
    return docs.unionByName(turns).select("id", text.is_compound(F.col("text")).alias("compound"), text.looks_like_question(F.col("text")).alias("like_question"))


@query(r"""
WITH t AS (SELECT r_regionkey, list(['| ' || n_nationkey || ' | ' || n_name || ' |', ''] ORDER BY n_nationkey) AS rows FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1)
SELECT r_regionkey, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || array_to_string(list_transform(rows, lambda r: r[1]), chr(10)) || chr(10) AS markdown FROM t
""")
def table_markdown(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cells = F.array_sort(F.collect_list(F.struct("n_nationkey", F.array(F.col("n_nationkey").cast("string"), "n_name").alias("cells"))))
    grid = rows.groupBy("r_regionkey").agg(F.transform(cells, lambda c: c.cells).alias("body"))
    return grid.select("r_regionkey", text.table_markdown(F.concat(F.array(F.array(F.lit("key"), F.lit("name"))), "body")).alias("markdown"))


# ---------------------------------------------------------------- retrieval

_BM25 = f"""
tok AS (SELECT doc_id AS chunk_id, {_TOKENS} AS toks FROM documents),
st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM tok),
post AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(toks) AS term FROM tok) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, st),
av AS (SELECT avg(raw) AS average_idf FROM raw),
terms AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * average_idf ELSE raw END AS idf FROM raw, av),
qt AS (SELECT query_id, term, count(*) AS qn FROM (SELECT item_id AS query_id, unnest({_TOKENS}) AS term FROM benchmark) GROUP BY ALL),
bm AS (
  SELECT query_id, p.chunk_id, sum(qn * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len(toks) / avgdl))) AS score
  FROM qt JOIN terms USING (term) JOIN post p USING (term) JOIN tok ON tok.chunk_id = p.chunk_id CROSS JOIN st GROUP BY ALL
)"""

_VEC = """
vec AS (
  SELECT item_id AS query_id, c.vec_id AS chunk_id, 1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS distance
  FROM benchmark JOIN embeddings q ON q.vec_id = item_id CROSS JOIN embeddings c WHERE c.vec_id IN (SELECT doc_id FROM documents)
)"""

_FUSED = f"""
{_BM25},
{_VEC},
every AS (SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark, documents),
lists AS (
  SELECT query_id, chunk_id, distance,
    row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(score, 0), 9) DESC, chunk_id) - 1 AS bm25_rank,
    row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9) ASC NULLS LAST, chunk_id) - 1 AS v
  FROM every LEFT JOIN bm USING (query_id, chunk_id) LEFT JOIN vec USING (query_id, chunk_id)
),
fused AS (
  SELECT query_id, chunk_id, rrf, coalesce(distance, 1.0) AS distance, bm25_rank,
    row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, bm25_rank) - 1 AS rank
  FROM (SELECT *, 1.0::DOUBLE / (60 + bm25_rank) + CASE WHEN distance IS NULL THEN 0 ELSE 1.0::DOUBLE / (60 + v) END AS rrf FROM lists)
)"""


def _corpus(spark, sf_dir):
    return documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text", "source")


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def _blocks(spark, sf_dir, index=None):
    """The corpus in blocks with its vectors, and the weighed questions with theirs."""
    questions = _questions(spark, sf_dir)
    index = index or lexical.bm25_index(_corpus(spark, sf_dir))
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    asked = questions.join(v, F.col("query_id") == F.col("vec_id")).select("query_id", "vector")
    weighed = blocks.weighted_questions(lexical.question_terms(questions, text="question"), index, asked, questions)
    return blocks.corpus_blocks(index, v.withColumnRenamed("vec_id", "chunk_id")), weighed


def _top(spark, sf_dir, k, index=None):
    """The first k fused chunks of each question, staged: their number is known before they meet the texts, which then stay where they
    are."""
    return staged(top_fused(*_blocks(spark, sf_dir, index), k))


@query(f"WITH {_BM25} SELECT term, df, round(idf, 6) AS idf, n, round(avgdl, 6) AS avgdl, round(average_idf, 6) AS average_idf FROM terms, st, av")
def bm25_stats(spark, sf_dir):
    index = lexical.bm25_index(_corpus(spark, sf_dir))
    rows = index.terms.crossJoin(F.broadcast(index.stats))
    return rows.select("term", "df", F.round("idf", 6).alias("idf"), "n", F.round("avgdl", 6).alias("avgdl"), F.round("average_idf", 6).alias("average_idf"))


@query(f"""
WITH {_BM25}
SELECT df, count(*) AS n_terms, CAST(sum(length(term)) AS BIGINT) AS n_chars, min(term) AS first_term, max(term) AS last_term, round(min(idf), 6) AS idf, any_value(n) AS n, round(any_value(avgdl), 6) AS avgdl, round(any_value(average_idf), 6) AS average_idf
FROM terms, st, av GROUP BY df
""")
def bm25_idf_levels(spark, sf_dir):
    """The weights of terms by the number of documents that hold them."""
    index = lexical.bm25_index(_corpus(spark, sf_dir))
    levels = index.terms.groupBy("df").agg(F.count(F.lit(1)).alias("n_terms"), F.sum(F.length("term")).alias("n_chars"), F.min("term").alias("first_term"), F.max("term").alias("last_term"), F.round(F.min("idf"), 6).alias("idf"))
    return levels.crossJoin(F.broadcast(index.stats.select("n", F.round("avgdl", 6).alias("avgdl"), F.round("average_idf", 6).alias("average_idf"))))  # one row


@query(f"""
WITH {_BM25} SELECT * FROM (
  SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) - 1 AS rank FROM bm
) WHERE rank < 10
""")
def bm25_scores_topk(spark, sf_dir):
    index = lexical.bm25_index(_corpus(spark, sf_dir))
    asked = blocks.weighted_questions(lexical.question_terms(_questions(spark, sf_dir), text="question"), index)
    return blocks.top_scored(blocks.corpus_blocks(index), asked, 10).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("""
SELECT * FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) + 0.0 AS distance,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 9), c.vec_id) - 1 AS rank
  FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0
) WHERE rank < 7
""")
def vector_knn(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    asked = v.filter(F.col("vec_id") % 50 == 0).withColumnRenamed("vec_id", "query_id")
    found = vectors.nearest(asked, v.withColumnRenamed("vec_id", "chunk_id"), TOP_K)
    return found.select("query_id", "chunk_id", (F.round("distance", 6) + 0.0).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_FUSED} SELECT query_id, chunk_id, round(rrf, 6) AS rrf, round(distance, 6) + 0.0 AS distance, rank FROM fused WHERE rank < {TOP_K}")
def hybrid_rrf_topk(spark, sf_dir):
    top = _top(spark, sf_dir, TOP_K)
    return top.select("query_id", "chunk_id", F.round("rrf", 6).alias("rrf"), (F.round("distance", 6) + 0.0).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(f"""
WITH {_FUSED},
multi AS (
  SELECT query_id // 3 AS group_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min_by(distance, query_id) AS distance, min_by(rank, query_id) AS first_rank FROM fused GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY round(rrf, 12) DESC, first_rank, chunk_id) - 1 AS rank FROM multi)
SELECT group_id, chunk_id, round(rrf, 6) AS rrf, round(distance, 6) + 0.0 AS distance, rank FROM ranked WHERE rank < {TOP_K}
""")
def hybrid_multi_rrf(spark, sf_dir):
    """Three consecutive questions form a group."""
    corpus, asked = _blocks(spark, sf_dir)
    grouped = asked.withColumns({"group_id": F.floor(F.col("query_id") / 3).cast("long"), "query_ord": F.col("query_id")})
    top = top_fused_groups(corpus, grouped, TOP_K)
    return top.select("group_id", "chunk_id", F.round("rrf", 6).alias("rrf"), (F.round("distance", 6) + 0.0).alias("distance"), F.col("rank").cast("long").alias("rank"))


POOL = 20
_WORDS = r"list_distinct(regexp_extract_all(lower({0}), '[\pL\pN_]+'))"
_RERANK = f"""
{_FUSED},
pool AS (SELECT f.*, b.text AS question, d.text AS body FROM fused f JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = chunk_id WHERE rank < {POOL}),
pairs AS (SELECT *, {_WORDS.format("question")} AS qs, {_WORDS.format("body")} AS cs FROM pool),
scored AS (SELECT query_id, chunk_id, rrf, rank, round(len(list_intersect(qs, cs))::DOUBLE / greatest(len(list_distinct(list_concat(qs, cs))), 1), 9) AS rr FROM pairs),
scaled AS (
  SELECT query_id, chunk_id, rank,
    CASE WHEN max(rr) OVER w = min(rr) OVER w THEN 0.5 ELSE (rr - min(rr) OVER w) / (max(rr) OVER w - min(rr) OVER w) END AS a,
    CASE WHEN max(rrf) OVER w = min(rrf) OVER w THEN 0.5 ELSE (rrf - min(rrf) OVER w) / (max(rrf) OVER w - min(rrf) OVER w) END AS b
  FROM scored WINDOW w AS (PARTITION BY query_id)
)"""


def _pool(spark, sf_dir):
    """The pool of each question with the Jaccard similarity of the words of question and chunk as pair score."""
    pool = _top(spark, sf_dir, POOL)
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(text.TOKEN), F.lit(0)))
    rows = pool.join(_questions(spark, sf_dir), "query_id").join(_corpus(spark, sf_dir).select("chunk_id", "text"), "chunk_id")
    a, b = words(F.col("question")), words(F.col("text"))
    common = F.size(F.array_intersect(a, b)).cast("double")
    score = F.round(common / F.greatest(F.size(F.array_union(a, b)), F.lit(1)), 9)
    covered = F.round(common / F.greatest(F.size(a), F.lit(1)), 9)
    holds = F.contains("text", F.col("question")).alias("holds")
    return rows.select("query_id", "chunk_id", "rrf", "rank", score.alias("rerank_score"), covered.alias("covered"), holds)


@query(f"""
WITH {_RERANK}
SELECT query_id, chunk_id, round(0.5 * a + 0.5 * b, 4) AS blended_score, place FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(0.5 * a + 0.5 * b, 9) DESC, rank) - 1 AS place FROM scaled
) WHERE place < {TOP_K}
""")
def rerank_blend(spark, sf_dir):
    out = fusion.blend(_pool(spark, sf_dir), 0.5, TOP_K)
    return out.select("query_id", "chunk_id", "blended_score", F.col("place").cast("long").alias("place"))


@query(f"""
WITH {_RERANK},
params AS (SELECT unnest([{", ".join(f"{a}::DOUBLE" for a in ALPHAS)}]) AS alpha),
placed AS (SELECT alpha, query_id, chunk_id, row_number() OVER (PARTITION BY alpha, query_id ORDER BY round(alpha * a + (1 - alpha) * b, 9) DESC, rank) - 1 AS place FROM scaled, params),
best AS (SELECT alpha, query_id, max(CASE WHEN contains(d.text, q.text) THEN 1 ELSE 0 END) AS hit FROM placed JOIN documents d ON d.doc_id = chunk_id JOIN benchmark q ON q.item_id = query_id WHERE place < {TOP_K} GROUP BY ALL)
SELECT alpha, count(*) AS n, round(avg(hit), 6) AS accuracy, coalesce(string_agg(CAST(query_id AS VARCHAR), ',' ORDER BY query_id) FILTER (hit = 0), '') AS fails FROM best GROUP BY alpha
""")
def alpha_sweep(spark, sf_dir):
    """Blending weights against whether a question's best chunks hold its passage; the failing questions are listed."""
    settings = _pool(spark, sf_dir).withColumn("alpha", F.explode(F.array(*map(F.lit, ALPHAS))))
    placed = fusion.blend(settings, F.col("alpha"), TOP_K, by=["alpha"])
    best = placed.groupBy("alpha", "query_id").agg(F.max(F.col("holds").cast("int")).alias("hit"))
    fails = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("hit") == 0, F.col("query_id")))), lambda x: x.cast("string")), ",")
    return best.groupBy("alpha").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hit"), 6).alias("accuracy"), fails.alias("fails"))


_TWO_MODELS = _RERANK.replace(
    """scored AS (SELECT query_id, chunk_id, rrf, rank, round(""",
    """scored AS (SELECT 'covered' AS model, query_id, chunk_id, rrf, rank, round(len(list_intersect(qs, cs))::DOUBLE / greatest(len(qs), 1), 9) AS rr FROM pairs UNION ALL SELECT 'jaccard' AS model, query_id, chunk_id, rrf, rank, round(""",
).replace("SELECT query_id, chunk_id, rank,\n    CASE", "SELECT model, query_id, chunk_id, rank,\n    CASE").replace("PARTITION BY query_id)\n)", "PARTITION BY model, query_id)\n)")


@query(f"""
WITH {_TWO_MODELS},
params AS (SELECT unnest([{", ".join(f"{a}::DOUBLE" for a in ALPHAS)}]) AS alpha),
placed AS (SELECT model, alpha, query_id, chunk_id, row_number() OVER (PARTITION BY model, alpha, query_id ORDER BY round(alpha * a + (1 - alpha) * b, 9) DESC, rank) - 1 AS place FROM scaled, params),
best AS (SELECT model, alpha, query_id, max(CASE WHEN contains(d.text, q.text) THEN 1.0 / (1 + place) ELSE 0 END) AS hit FROM placed JOIN documents d ON d.doc_id = chunk_id JOIN benchmark q ON q.item_id = query_id WHERE place < {TOP_K} GROUP BY ALL)
SELECT model, alpha, count(*) AS n, round(avg(CASE WHEN hit > 0 THEN 1 ELSE 0 END), 6) AS accuracy, round(avg(hit), 6) AS reciprocal_rank FROM best GROUP BY model, alpha
""")
def model_comparison(spark, sf_dir):
    """Two pair scorers with all weights: how often, and how far up, the first chunks hold the question's passage.  One plan, in which the
    pool is found once and every setting is a row of it."""
    settings = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(a).alias("alpha"), F.col(c).alias("rerank_score")) for m, c in (("covered", "covered"), ("jaccard", "rerank_score")) for a in ALPHAS])
    rows = _pool(spark, sf_dir).select("query_id", "chunk_id", "rrf", "rank", "holds", F.explode(settings).alias("s")).select("query_id", "chunk_id", "rrf", "rank", "holds", "s.*")
    placed = fusion.blend(rows, F.col("alpha"), TOP_K, by=["model", "alpha"])
    best = placed.groupBy("model", "alpha", "query_id").agg(F.max(F.when(F.col("holds"), 1.0 / (1 + F.col("place"))).otherwise(0.0)).alias("hit"))
    return best.groupBy("model", "alpha").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("hit") > 0).cast("double")), 6).alias("accuracy"), F.round(F.avg("hit"), 6).alias("reciprocal_rank"))


@query(f"""
WITH {_FUSED}
SELECT query_id, string_agg('[Fragmento ' || (rank + 1) || '] Fuente: ' || source || ' | Pagina: ' || chunk_id || ' | Seccion: ' || CASE WHEN chunk_id % 2 = 0 THEN '(sin titulo)' ELSE 'S' || chunk_id END || chr(10) || chr(10) || text,
  chr(10) || chr(10) || '============================' || chr(10) || chr(10) ORDER BY rank) AS context
FROM fused JOIN documents ON doc_id = chunk_id WHERE rank < {TOP_K} GROUP BY query_id
""")
def format_context(spark, sf_dir):
    top = _top(spark, sf_dir, TOP_K).join(_corpus(spark, sf_dir), "chunk_id")
    hint = F.when(F.col("chunk_id") % 2 == 0, "").otherwise(F.concat(F.lit("S"), "chunk_id"))
    hits = F.array_sort(F.collect_list(F.struct("rank", "source", F.col("chunk_id").alias("page"), hint.alias("section_hint"), "text")))
    return top.groupBy("query_id").agg(text.format_context(hits).alias("context"))


@query(f"WITH {_FUSED} SELECT source, count(*) AS n FROM fused JOIN documents ON doc_id = chunk_id WHERE rank < {TOP_K} GROUP BY source")
def source_frequencies(spark, sf_dir):
    top = _top(spark, sf_dir, TOP_K).join(_corpus(spark, sf_dir), "chunk_id")
    log = top.groupBy("query_id").agg(F.collect_list(F.struct("source")).alias("sources"))
    return querylog.source_frequencies(log)


# ---------------------------------------------------------------- verification

def _answers(spark, sf_dir):
    """Each document as an answer, the one before it in its source as its context.  Places in one order of all find the one before, so a
    source may be of any size."""
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    placed = logstore.dense_ids(docs.select("doc_id", "source"), ["source", "doc_id"])[0]
    before = placed.select((F.col("id") + 1).alias("id"), F.col("source").alias("_source"), F.col("doc_id").alias("_before"))
    pairs = placed.join(before, "id", "left").select("doc_id", F.when(F.col("_source") == F.col("source"), F.col("_before")).alias("_before"))
    contexts = docs.select(F.col("doc_id").alias("_before"), F.col("text").alias("context"))
    rows = docs.join(pairs, "doc_id").join(contexts, "_before", "left")
    return rows.select("doc_id", F.col("text").alias("answer"), F.coalesce("context", F.lit("")).alias("context"))


# Only numbers occur in these tables, beside ASCII letters and signs only, so RE2's \b serves.
_NUMBERS_SQL = r"""
WITH answers AS (SELECT doc_id, text AS answer, coalesce(lag(text) OVER (PARTITION BY source ORDER BY doc_id), '') AS context FROM documents),
found AS (SELECT doc_id, context, trim(unnest(regexp_extract_all(answer, '\b\d{1,3}(?:[.,]\d{3})*(?:[.,]\d+)?\s*%?\b')), chr(32) || chr(10)) AS claim FROM answers),
firsts AS (SELECT DISTINCT doc_id, context, claim FROM found WHERE NOT regexp_replace(claim, '[^0-9]', '', 'g') IN ('1','2','3','4','5','6','7','8','9','10','100'))
SELECT doc_id, 'numero' AS kind, claim FROM firsts WHERE NOT contains(context, claim) AND NOT contains(regexp_replace(context, '\s+', '', 'g'), claim)
"""


@query(_NUMBERS_SQL)
def faithfulness_claims(spark, sf_dir):
    return verify.unsupported_claims(_answers(spark, sf_dir), "doc_id").select("doc_id", "kind", "claim")


@query(_NUMBERS_SQL.replace("SELECT doc_id, 'numero' AS kind, claim FROM", "SELECT doc_id, substr(answer, 1, 80) AS question, 'numero' AS kind, claim FROM (SELECT firsts.*, documents.text AS answer FROM firsts JOIN documents USING (doc_id))"))
def warnings_explode(spark, sf_dir):
    log = verify.with_warnings(_answers(spark, sf_dir), "doc_id").select(F.col("doc_id").alias("ts"), F.col("answer").alias("question"), "warnings")
    return verify.explode_warnings(log).withColumnRenamed("ts", "doc_id")


_CLAIMED = r"""
said AS (
  SELECT doc_id, text || ' Segun el ARTÍCULO  ' || (doc_id % 40 + 11) || 'b y el articulo ' || (doc_id % 7 + 20) || ', el ' || (doc_id % 28 + 1) || ' de marzo de ' || (2000 + doc_id % 25) || ' fue el 28,5% de 1.234.567' AS answer,
    CASE doc_id % 3 WHEN 0 THEN 'Articulo ' || (doc_id % 40 + 11) || 'B: el 28,5 % y ' || (doc_id % 28 + 1) || ' de' || chr(10) || 'Marzo de ' || (2000 + doc_id % 25) WHEN 1 THEN 'art. ' || (doc_id % 7 + 20) ELSE text END AS context FROM documents
), found AS (
  SELECT doc_id, context, 'numero' AS kind, unnest(regexp_extract_all(answer, '\b\d{1,3}(?:[.,]\d{3})*(?:[.,]\d+)?\s*%?\b')) AS claim FROM said
  UNION ALL SELECT doc_id, context, 'articulo' AS kind, unnest(regexp_extract_all(answer, '(?i)art[íi]culo\s+\d+[a-z]?')) AS claim FROM said
  UNION ALL SELECT doc_id, context, 'fecha' AS kind, unnest(regexp_extract_all(answer, '(?i)\b\d{1,2}\s+de\s+[a-záéíóúñ]+\s+de\s+\d{4}\b')) AS claim FROM said
), named AS (
  SELECT DISTINCT doc_id, kind, trim(regexp_replace(lower(strip_accents(claim)), '\s+', ' ', 'g')) AS claim, regexp_replace(lower(strip_accents(context)), '\s+', ' ', 'g') AS context FROM found
)
SELECT doc_id, kind, claim FROM named WHERE NOT (kind = 'numero' AND regexp_replace(claim, '[^0-9]', '', 'g') IN ('1','2','3','4','5','6','7','8','9','10','100'))
  AND NOT contains(context, claim) AND NOT contains(replace(context, ' ', ''), replace(claim, ' ', ''))
"""


@query("WITH " + _CLAIMED)
def claim_kinds(spark, sf_dir):
    """Answers that name numbers, articles and dates, some of which their contexts hold in another spelling."""
    n = lambda by, plus: (F.col("doc_id") % by + plus).cast("string")
    day = F.concat(n(28, 1), F.lit(" de marzo de "), n(25, 2000))
    answer = F.concat("text", F.lit(" Segun el ARTÍCULO  "), n(40, 11), F.lit("b y el articulo "), n(7, 20), F.lit(", el "), day, F.lit(" fue el 28,5% de 1.234.567"))
    other = F.concat(F.lit("Articulo "), n(40, 11), F.lit("B: el 28,5 % y "), n(28, 1), F.lit(" de\nMarzo de "), n(25, 2000))
    context = F.when(F.col("doc_id") % 3 == 0, other).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("art. "), n(7, 20))).otherwise(F.col("text"))
    found = verify.unsupported_claims(documents(spark, sf_dir).select("doc_id", answer.alias("answer"), context.alias("context")), "doc_id")
    return found.select("doc_id", "kind", text.trim_all(text.normalized(F.col("claim"))).alias("claim"))


# ---------------------------------------------------------------- query log

_LOG = """
log AS (
  SELECT event_id AS id, ts, 'q' || user_id AS question, CAST(round(value * 10) AS BIGINT) AS latency_ms, event_type AS llm_model, event_type = 'error' AS no_match,
    CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS warnings_count FROM events
), now AS (SELECT max(ts) AS now FROM events)"""


def _log(spark, sf_dir):
    """events as a query log; errors are the answers without result."""
    none, one = F.array().cast("array<struct<kind:string,claim:string>>"), F.array(F.struct(F.lit("numero").alias("kind"), F.lit("28").alias("claim")))
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("q"), "user_id").alias("question"), F.round(F.col("value") * 10).cast("long").alias("latency_ms"),
        F.col("event_type").alias("llm_model"), F.lit("m").alias("embedding_model"), F.when(F.col("event_type") == "error", "No encuentro ESTA información aquí.").otherwise("ok").alias("answer"),
        F.array(F.struct(F.col("event_type").alias("source"))).alias("sources"), F.when(F.col("event_id") % 7 == 0, one).otherwise(none).alias("warnings"),
    )
    return querylog.derived(rows)


def _now(spark, sf_dir):
    """The newest time of the log stands for now."""
    return _log(spark, sf_dir).crossJoin(F.broadcast(table(spark, sf_dir, "events").agg(F.max(F.col("ts").cast("timestamp")).alias("now"))))


@query(f"""
WITH {_LOG}
SELECT count(*) AS total, count(*) FILTER (ts >= now - INTERVAL 7 DAY) AS last_7_days, CAST(floor(quantile_cont(latency_ms, 0.5)) AS BIGINT) AS p50_ms, CAST(floor(quantile_cont(latency_ms, 0.95)) AS BIGINT) AS p95_ms,
  round(avg(CAST(no_match AS INTEGER)), 6) AS no_match_rate, round(avg(CASE WHEN warnings_count > 0 THEN 1 ELSE 0 END), 6) AS warning_rate FROM log, now
""")
def log_kpis(spark, sf_dir):
    return querylog.kpis(_now(spark, sf_dir), F.col("now"))


@query(f"WITH {_LOG} SELECT CAST(ts AS DATE) AS date, count(*) AS n FROM log GROUP BY 1")
def log_daily(spark, sf_dir):
    return querylog.daily(_log(spark, sf_dir))


@query(f"WITH {_LOG} SELECT llm_model, count(latency_ms) AS n, CAST(floor(quantile_cont(latency_ms, 0.5)) AS BIGINT) AS p50_ms, CAST(floor(quantile_cont(latency_ms, 0.95)) AS BIGINT) AS p95_ms FROM log GROUP BY 1")
def log_by_model(spark, sf_dir):
    return querylog.by_model(_log(spark, sf_dir))


@query(f"""
WITH {_LOG}
SELECT question, count(*) AS veces, CAST(sum(CAST(no_match AS INTEGER)) AS BIGINT) AS no_match, CAST(floor(quantile_cont(latency_ms, 0.5)) AS BIGINT) AS p50_ms, round(sum(CAST(no_match AS INTEGER)) / count(*), 6) AS no_match_rate
FROM log GROUP BY question ORDER BY veces DESC, question LIMIT 10
""")
def log_top_questions(spark, sf_dir):
    return querylog.top_questions(_log(spark, sf_dir))


@query(f"WITH {_LOG} SELECT id, question, latency_ms, llm_model FROM log ORDER BY ts DESC, id DESC LIMIT 50")
def log_recent(spark, sf_dir):
    return querylog.recent(_log(spark, sf_dir)).select("id", "question", "latency_ms", "llm_model")


@query(f"WITH {_LOG} SELECT count(*) FILTER (ts >= now - INTERVAL 10 DAY) AS kept, count(*) FILTER (ts < now - INTERVAL 10 DAY) AS removed FROM log, now")
def log_purge(spark, sf_dir):
    rows = _now(spark, sf_dir)
    kept = querylog.purge(rows, F.col("now"), 10).agg(F.count(F.lit(1)).alias("kept"))
    return rows.agg(F.count(F.lit(1)).alias("all")).crossJoin(kept).select("kept", (F.col("all") - F.col("kept")).alias("removed"))


@query("SELECT event_id, 1000 + row_number() OVER (ORDER BY ts, event_id) AS id FROM events")
def log_append(spark, sf_dir):
    """The ids that a batch of rows gets behind a log of 1,000."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return logstore.dense_ids(rows, ["ts", "event_id"], 1000)[0].select("event_id", "id")


@query("""
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh, event_id FROM events),
g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT user_id, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS ended, count(*) AS n FROM g GROUP BY user_id, run
""")
def debounce_sessions(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    runs = querylog.bursts(events, ["user_id"], 3600)
    return runs.select("user_id", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "n")


_FILES = """
files AS (SELECT '/in/f' || doc_id || CASE doc_id % 4 WHEN 3 THEN '.docx' WHEN 2 THEN '.MD' ELSE '.txt' END AS path, doc_id, length(text) AS length FROM documents),
b AS (SELECT path, doc_id % 50 AS modified, length FROM files WHERE doc_id % 9 <> 0), a AS (
  SELECT CASE WHEN doc_id % 13 = 0 THEN path || '.txt' ELSE path END AS path, doc_id % 50 + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS modified, length FROM files WHERE doc_id % 8 <> 0
)"""


@query(f"""
WITH {_FILES}
SELECT * FROM (
  SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'created' WHEN a.path IS NULL THEN 'deleted' WHEN (a.modified, a.length) <> (b.modified, b.length) THEN 'modified' END AS kind
  FROM b FULL JOIN a ON a.path = b.path
) WHERE kind IS NOT NULL AND NOT ends_with(lower(path), '.docx')
""")
def folder_events(spark, sf_dir):
    """Documents as files of two listings: some are in one of them only, some were changed, some moved."""
    d = documents(spark, sf_dir)
    suffix = F.when(F.col("doc_id") % 4 == 3, ".docx").when(F.col("doc_id") % 4 == 2, ".MD").otherwise(".txt")
    files = d.select("doc_id", F.concat(F.lit("/in/f"), "doc_id", suffix).alias("path"), (F.col("doc_id") % 50).alias("modified"), F.length("text").alias("length"))
    moved = F.when(F.col("doc_id") % 13 == 0, F.concat("path", F.lit(".txt"))).otherwise(F.col("path"))
    after = files.filter(F.col("doc_id") % 8 != 0).select(moved.alias("path"), (F.col("modified") + (F.col("doc_id") % 5 == 0).cast("int")).alias("modified"), "length")
    events = watch.listing_events(files.filter(F.col("doc_id") % 9 != 0), after)
    return watch.relevant(events.withColumn("is_directory", F.lit(False))).select("path", "kind")


# ---------------------------------------------------------------- synchronisation

_OLD = "SELECT doc_id, 'f' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '-old' ELSE '' END AS source, sha256(text) AS sha256 FROM documents"
_NEW = "SELECT doc_id, 'f' || doc_id || CASE WHEN doc_id % 11 = 0 THEN '-new' ELSE '' END AS source, CASE WHEN doc_id % 7 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS sha256 FROM documents"
_STATE = """SELECT coalesce(o.source, n.source) AS source,
  CASE WHEN o.source IS NULL THEN 'new' WHEN n.source IS NULL THEN 'deleted' WHEN o.sha256 = n.sha256 THEN 'unchanged' ELSE 'modified' END AS status, n.sha256 FROM o FULL JOIN n ON o.source = n.source"""


def _versions(spark, sf_dir):
    """Two versions of a folder: some files bear a name that only one version knows, some changed."""
    d = documents(spark, sf_dir)
    named = lambda n, mark: F.concat(F.lit("f"), "doc_id", F.when(F.col("doc_id") % n == 0, mark).otherwise(""))
    old = d.select("doc_id", named(5, "-old").alias("source"), "text", F.sha2("text", 256).alias("sha256"))
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return old, d.select("doc_id", named(11, "-new").alias("source"), changed.alias("text"), F.sha2(changed, 256).alias("sha256"))


@query(f"WITH o AS ({_OLD}), n AS ({_NEW}) {_STATE}")
def sync_diff(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return sync_ops.sync_state(old, new)


@query(f"""
WITH o AS ({_OLD}), n AS ({_NEW}), s AS ({_STATE})
SELECT source || '::p1::c0' AS chunk_id, source, sha256 FROM s WHERE status <> 'deleted'
""")
def sync_apply(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    shaped = lambda v: v.select(text.chunk_id(F.col("source"), F.lit(1), F.lit(0)).alias("chunk_id"), "source", "sha256")
    return sync_ops.applied(shaped(old), sync_ops.sync_state(old, new), shaped(new))


@query("""
SELECT doc_id AS chunk_id, 'old' AS version, text FROM documents WHERE doc_id % 3 <> 0
UNION ALL SELECT CASE WHEN doc_id % 3 = 0 THEN doc_id ELSE -1 - doc_id END AS chunk_id, 'new' AS version, text || '!' AS text FROM documents
""")
def upsert_chunks(spark, sf_dir):
    """All documents, then all again: every third under its key, the rest under a new one."""
    old = documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.lit("old").alias("version"), "text")
    key = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).otherwise(-1 - F.col("doc_id"))
    new = documents(spark, sf_dir).select(key.alias("chunk_id"), F.lit("new").alias("version"), F.concat("text", F.lit("!")).alias("text"))
    return snapshots.upsert(snapshots.upsert(old, new), new)


@query("SELECT text, count(*) AS n FROM documents GROUP BY text".replace("text, count", "sha256(text) AS text_sha256, count"))
def embed_dedup(spark, sf_dir):
    """Each distinct text reaches the embedding model once; n: the rows that share its vector."""
    embedded = models.embed_distinct(documents(spark, sf_dir).select("text"), "text", "stand-in")
    one = embedded.groupBy(F.sha2("text", 256).alias("text_sha256")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("vector").alias("v"), F.min(F.size("vector")).alias("dim"))
    return one.filter("v = 1 AND dim = 64").select("text_sha256", "n")


@query("SELECT count(*) - count(DISTINCT text) AS hits, count(DISTINCT text) AS misses, count(DISTINCT text) AS size, round((count(*) - count(DISTINCT text)) / count(*), 6) AS hit_rate FROM documents")
def embed_cache_stats(spark, sf_dir):
    return models.cache_stats(documents(spark, sf_dir))


_REQUESTS = """
r AS (SELECT conv_id, turn, regexp_extract(text, '[\\pL\\pN_]+') AS word, row_number() OVER (ORDER BY conv_id, turn) AS pos FROM conversations),
p AS (SELECT *, lag(pos) OVER (PARTITION BY word ORDER BY pos) AS before FROM r),
d AS (SELECT p.pos, count(DISTINCT x.word) AS apart FROM p JOIN r x ON x.pos > p.before AND x.pos < p.pos GROUP BY p.pos),
h AS (SELECT conv_id, turn, pos, before IS NOT NULL AND coalesce(apart, 0) < 64 AS hit FROM p LEFT JOIN d USING (pos))"""


def _replayed(spark, sf_dir):
    """The first words of all turns as requests to a cache of 64 entries."""
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_extract("text", text.TOKEN, 0).alias("word"))
    return embedcache.replayed(words, "word", ["conv_id", "turn"], 64)


@query(f"WITH {_REQUESTS} SELECT conv_id, turn, hit FROM h")
def cache_replay(spark, sf_dir):
    return _replayed(spark, sf_dir).select("conv_id", "turn", "hit")


@query(f"""
WITH {_REQUESTS}
SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, least(64, (SELECT count(DISTINCT word) FROM r)) AS size, CAST(64 AS BIGINT) AS maxsize, round(count(*) FILTER (hit) / count(*), 6) AS hit_rate FROM h
""")
def cache_replay_stats(spark, sf_dir):
    return embedcache.bounded_stats(_replayed(spark, sf_dir), 64)


# ---------------------------------------------------------------- evaluation

_PREDICTED = "CASE WHEN length(text) > 900 THEN 1 ELSE 0 END"


@query(f"""
WITH c AS (SELECT doc_id, quality, toxic, {_PREDICTED} AS pq, CASE WHEN contains(text, 'worthless') THEN 1 ELSE 0 END AS pt FROM labels JOIN documents USING (doc_id)),
s AS (SELECT CAST(sum(quality * pq + toxic * pt) AS BIGINT) AS tp, CAST(sum((1 - quality) * pq + (1 - toxic) * pt) AS BIGINT) AS fp, CAST(sum(quality * (1 - pq) + toxic * (1 - pt)) AS BIGINT) AS fn FROM c),
r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r FROM s)
SELECT tp, fp, fn, round(p, 3) AS precision, round(r, 3) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 3) AS f1 FROM r
""")
def label_prf(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(documents(spark, sf_dir), "doc_id")
    pick = lambda *pairs: F.array_compact(F.array(*[F.when(c, name) for name, c in pairs]))
    cases = rows.select(pick(("quality", F.col("quality") == 1), ("toxic", F.col("toxic") == 1)).alias("expected"), pick(("quality", F.length("text") > 900), ("toxic", F.contains("text", F.lit("worthless")))).alias("predicted"))
    return evaluation.micro_scores(evaluation.case_scores(cases))


KEYWORDS = {"en": ["the", "Tion"], "fr": ["que", "Élle", "zzz"], "de": ["ung", "über"], "es": ["ción", "que"]}
_KW = "CASE lang WHEN 'en' THEN ['the', 'tion'] WHEN 'fr' THEN ['que', 'elle', 'zzz'] WHEN 'de' THEN ['ung', 'uber'] ELSE ['cion', 'que'] END"


@query(f"""
WITH c AS (SELECT source, lang, len(list_filter({_KW}, lambda k: contains(lower(strip_accents(text)), k))) / len({_KW}) AS cov FROM documents)
SELECT lang, round(avg(c), 3) AS coverage FROM (SELECT lang, source, avg(cov) AS c FROM c GROUP BY ALL) GROUP BY lang
""")
def keyword_coverage(spark, sf_dir):
    """Coverage of fixed keywords of the language, averaged over each source and then over sources."""
    words = F.when(F.col("lang") == "en", F.array(*map(F.lit, KEYWORDS["en"]))).when(F.col("lang") == "fr", F.array(*map(F.lit, KEYWORDS["fr"]))).when(F.col("lang") == "de", F.array(*map(F.lit, KEYWORDS["de"]))).otherwise(F.array(*map(F.lit, KEYWORDS["es"])))
    rows = documents(spark, sf_dir).select("lang", "source", evaluation.keyword_coverage(F.array("text"), words).alias("c"))
    return rows.groupBy("lang", "source").agg(F.avg("c").alias("c")).groupBy("lang").agg(F.round(F.avg("c"), 3).alias("coverage"))


@query(f"""
WITH {_FUSED},
holds AS (SELECT item_id AS query_id, list(DISTINCT source) AS expected FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1),
got AS (SELECT query_id, list(source) AS sources, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context FROM fused JOIN documents ON doc_id = chunk_id WHERE rank < {TOP_K} GROUP BY 1),
cases AS (
  SELECT g.query_id, (g.query_id * 37) % 101 AS latency_ms, CASE WHEN h.expected IS NULL THEN NULL WHEN list_has_any(h.expected, g.sources) THEN 1.0 ELSE 0.0 END AS recall, CAST(contains(lower(strip_accents(context)), lower(strip_accents(b.text))) AS INTEGER) AS faithfulness
  FROM got g LEFT JOIN holds h USING (query_id) JOIN benchmark b ON b.item_id = g.query_id
)
SELECT count(*) AS n, round(avg(coalesce(recall, 0)), 6) AS recall_rate, 1.0::DOUBLE AS accuracy, round(avg(faithfulness), 6) AS faithfulness, CAST(count(*) FILTER (query_id % 4 = 0) AS BIGINT) AS warnings, count(*) FILTER (query_id % 4 = 0) AS with_warnings,
  CAST(floor(quantile_cont(latency_ms, 0.5)) AS BIGINT) AS p50_ms, list_sort(list(latency_ms))[greatest(1, CAST(floor(0.95 * count(*)) AS BIGINT))] AS p95_ms FROM cases
""")
def eval_aggregate(spark, sf_dir):
    """Questions are passages: a source is expected if a document of it holds the passage, and the passage itself stands for the answer."""
    questions, corpus = _questions(spark, sf_dir), _corpus(spark, sf_dir)
    index = lexical.bm25_index(corpus)
    holds = evaluation.passage_holders(corpus, questions, index).join(corpus.select("chunk_id", "source"), "chunk_id").groupBy("query_id").agg(F.collect_set("source").alias("expected_sources"))
    top = _top(spark, sf_dir, TOP_K, index).join(corpus, "chunk_id")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text")))
    got = top.groupBy("query_id").agg(F.collect_list("source").alias("sources"), F.array_join(F.transform(ordered, lambda x: x.text), "\n\n").alias("context"))
    cases = got.join(holds, "query_id", "left").join(questions, "query_id")
    cases = cases.select("query_id", F.coalesce("expected_sources", F.array().cast("array<string>")).alias("expected_sources"), "sources", F.array("question").alias("must_contain"), F.col("question").alias("answer"), "context")
    scored = evaluation.answer_scores(cases).withColumns({"n_warnings": F.when(F.col("query_id") % 4 == 0, 1).otherwise(0), "latency_ms": (F.col("query_id") * 37) % 101})
    return evaluation.evaluation_report(scored)


# ---------------------------------------------------------------- structured output


@query(r"""
WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[\pL\pN_]+')) AS item, generate_subscripts(regexp_extract_all(text, '[\pL\pN_]+'), 1) AS pos FROM conversations),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(item) ORDER BY turn, pos) AS n FROM w)
SELECT conv_id, count(*) AS n_items, sha256(string_agg(item, '|' ORDER BY turn, pos)) AS items_sha256 FROM f WHERE n = 1 GROUP BY conv_id
""")
def merge_items_dedup(spark, sf_dir):
    words = F.regexp_extract_all("text", F.lit(text.TOKEN), F.lit(0))
    items = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(words).alias("at", "item"))
    merged = assistant.merged_items(items, ["conv_id"], ["turn", "at"])
    return merged.select("conv_id", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", "|"), 256).alias("items_sha256"))


@query("""
WITH i AS (
  SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'riesgo_credito' WHEN 'click' THEN 'riesgo_mercado' WHEN 'error' THEN 'riesgo_operacional' WHEN 'signup' THEN 'riesgo_liquidez' ELSE 'otro' END AS label, least(value / 100, 1.0) AS weight FROM events
), f AS (SELECT *, row_number() OVER (PARTITION BY user_id, label ORDER BY event_id) AS n FROM i WHERE label <> 'otro' AND weight > 0),
t AS (SELECT *, sum(weight) OVER (PARTITION BY user_id) AS total FROM f WHERE n = 1)
SELECT user_id, label, round(weight / greatest(total, 1.0), 4) AS weight FROM t
""")
def weights_normalize(spark, sf_dir):
    label = F.when(F.col("event_type") == "view", "Riesgo_Credito ").when(F.col("event_type") == "click", "riesgo_mercado").when(F.col("event_type") == "error", "riesgo_operacional").when(F.col("event_type") == "signup", "riesgo_liquidez").otherwise("otro")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", label.alias("label"), (F.col("value") / 100).alias("weight"))
    items = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "label", "weight"))).alias("items"))
    return items.select("user_id", F.explode(structured.normalized_weights(F.col("items"))).alias("x")).select("user_id", "x.label", "x.weight")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_tolerant(spark, sf_dir):
    """props as a model might hand them over: prose around, a comma too many, or as they are."""
    e = table(spark, sf_dir, "events")
    spoiled = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Aqui tienes: "), "props", F.lit(" {fin")))
    spoiled = spoiled.when(F.col("event_id") % 3 == 1, F.replace("props", F.lit("}"), F.lit(" ,\n}"))).otherwise(F.col("props"))
    parsed = e.select("event_id", structured.parse_json(spoiled).alias("json"))
    return parsed.select("event_id", F.get_json_object("json", "$.k").cast("long").alias("k"))


@query("""
WITH o AS (SELECT l_orderkey, l_linenumber, l_quantity AS x0, l_discount AS top, l_quantity + 1 AS x1, l_discount + 0.01 AS bottom FROM lineitem),
b AS (SELECT l_orderkey, l_linenumber, l_quantity - 3 AS x0, l_discount - 0.03 AS top, l_quantity + 9 AS x1, l_discount + 0.04 AS bottom FROM lineitem WHERE l_linenumber = 1)
SELECT l_orderkey, l_linenumber FROM o WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.l_orderkey = o.l_orderkey AND o.x0 > b.x0 AND o.top > b.top AND o.x1 < b.x1 AND o.bottom < b.bottom)
""")
def bbox_anti_join(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    objects = li.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x0"), F.col("l_discount").alias("top"), (F.col("l_quantity") + 1).alias("x1"), (F.col("l_discount") + 0.01).alias("bottom"))
    boxes = li.filter("l_linenumber = 1").select("l_orderkey", (F.col("l_quantity") - 3).alias("x0"), (F.col("l_discount") - 0.03).alias("top"), (F.col("l_quantity") + 9).alias("x1"), (F.col("l_discount") + 0.04).alias("bottom"))
    return chunk_ops.outside_boxes(objects, boxes, ["l_orderkey"]).select("l_orderkey", "l_linenumber")


# ---------------------------------------------------------------- plans around a model

# The stand-in model repeats the start of its prompt, so a prompt that holds JSON gets it back as its answer.


@query("""
SELECT doc_id AS query_id, array_to_string(CASE doc_id % 3 WHEN 0 THEN ['¿Que es ' || source || '?', 'Como va ' || doc_id || '?'] WHEN 1 THEN ['Que es ' || source || ' y como va ' || doc_id || '? []'] ELSE ['¿Que es ' || source || '?'] END, '|') AS subs FROM documents
""")
def decompose_questions(spark, sf_dir):
    """A compound question with good parts, one without, and a simple one, by turns."""
    from tesela.plans.retrieval import sub_questions

    d = documents(spark, sf_dir)
    listed = F.concat(F.lit("Que es y como va? [\"¿Que es "), "source", F.lit("?\", \"corta\", \"Como va "), "doc_id", F.lit("?\", \"\"]"))
    bare = F.concat(F.lit("Que es "), "source", F.lit(" y como va "), "doc_id", F.lit("? []"))
    asked = F.when(F.col("doc_id") % 3 == 0, listed).when(F.col("doc_id") % 3 == 1, bare).otherwise(F.concat(F.lit("¿Que es "), "source", F.lit("?")))
    return sub_questions(d.select(F.col("doc_id").alias("query_id"), asked.alias("question")), models.echo_completer).select("query_id", F.array_join("subs", "|").alias("subs"))


@query("""
WITH e AS (SELECT event_id, value / 100 AS w FROM events), c AS (SELECT event_id, least(w, 1.0) AS a, 0.25::DOUBLE AS b FROM e)
SELECT event_id, 'riesgo_mercado' AS label, round(b / greatest(a + b, 1.0), 4) AS weight FROM c
UNION ALL SELECT event_id, 'riesgo_credito' AS label, round(a / greatest(a + b, 1.0), 4) AS weight FROM c WHERE a > 0
""")
def classify_texts(spark, sf_dir):
    """Texts whose answers name two known labels, one of them twice, and an unknown one."""
    value = F.col("value") / 100
    answer = F.concat(F.lit('[{"label": "riesgo_credito", "weight": '), F.format_string("%.6f", value), F.lit('}, {"label": "otra", "weight": 1}, {"label": "Riesgo_Mercado", "weight": 0.25}, {"label": "riesgo_mercado", "weight": 0.9}]'))
    out = assistant.classify(table(spark, sf_dir, "events").select("event_id", answer.alias("text")), "zero_shot", models.echo_completer)
    return out.select("event_id", F.explode("labels").alias("x")).select("event_id", "x.label", "x.weight")


@query("SELECT doc_id AS query_id, '¿Que es ' || source || '?|¿Como va ' || doc_id || '?|¿Quien es ' || lang || '?' AS subs FROM documents")
def decompose_first_three(spark, sf_dir):
    """Of five good parts the first three stay."""
    from tesela.plans.retrieval import sub_questions

    parts = [("¿Que es ", "source"), ("¿Como va ", "doc_id"), ("¿Quien es ", "lang"), ("¿Donde esta ", "source"), ("¿Por que ", "doc_id")]
    listed = F.array_join(F.array(*[F.concat(F.lit(f'"{a}'), F.col(c).cast("string"), F.lit('?"')) for a, c in parts]), ", ")
    asked = F.concat(F.lit("Que es y como va? ["), listed, F.lit("]"))
    divided = sub_questions(documents(spark, sf_dir).select(F.col("doc_id").alias("query_id"), asked.alias("question")), models.echo_completer)
    return divided.select("query_id", F.array_join("subs", "|").alias("subs"))


@query(ORACLES["classify_texts"])
def classify_objects(spark, sf_dir):
    """As classify_texts, with answers that are objects whose list comes after other values."""
    value = F.col("value") / 100
    answer = F.concat(
        F.lit('PASO 4: {"nota": "x", "vacias": [], "cifras": [1], "etiquetas": [{"label": "riesgo_credito", "weight": '), F.format_string("%.6f", value),
        F.lit('}, {"label": "otra", "weight": 1}, {"label": "Riesgo_Mercado", "weight": 0.25}]}'),
    )
    out = assistant.classify(table(spark, sf_dir, "events").select("event_id", answer.alias("text")), "cot", models.echo_completer)
    return out.select("event_id", F.explode("labels").alias("x")).select("event_id", "x.label", "x.weight")


_ITEMS = """
WITH said AS (SELECT conv_id AS source, turn AS page, {0} AS item FROM conversations WHERE text IS NOT NULL),
f AS (SELECT *, row_number() OVER (PARTITION BY source, lower(item) ORDER BY page) AS n FROM said WHERE item <> '')
SELECT source, field, items FROM (
  SELECT CAST(source AS VARCHAR) AS source, '{1}' AS field, string_agg(item, '|' ORDER BY page) AS items FROM f WHERE n = 1 GROUP BY source
)
"""
_FIRST_WORD = r"regexp_extract(text, '[\pL\pN_]+')"


def _model_chunks(spark, sf_dir, field):
    """Turns as chunks whose answer lists the turn's first word in one field; the reducing prompt starts with no JSON object of its own."""
    word = F.regexp_extract("text", text.TOKEN, 0)
    body = F.to_json(F.create_map(F.lit(field), F.array(word)))
    return table(spark, sf_dir, "conversations").filter("text IS NOT NULL").select(F.col("conv_id").cast("string").alias("source"), F.col("turn").alias("page"), F.lit(0).alias("chunk_index"), body.alias("text"))


def _reduces_to_nothing(system: str, user: str, temperature: float = 0.1, most: int = 1024) -> str:
    """Repeats a chunk's prompt; has no answer to a reducing one, so the parts are merged."""
    return "" if "Parciales:" in user else user[:most]


def _reduces_to_a_count(system: str, user: str, temperature: float = 0.1, most: int = 1024) -> str:
    """Repeats a chunk's prompt; answers the reduction of three parts and more with their number."""
    if "Parciales:" not in user:
        return user[:most]
    n = user.count("\n", user.index("Parciales:"))
    return f'{{"limites_regulatorios": ["{n} partes", "{n} PARTES"]}}' if n > 2 else "sin respuesta"


@query(r"""
WITH said AS (SELECT conv_id, turn, regexp_extract_all(text, '[\pL\pN_]+') AS w FROM conversations WHERE text IS NOT NULL),
items AS (SELECT conv_id, turn, w[1] || coalesce(' - ' || w[2], '') AS item FROM said WHERE len(w) > 0),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(item) ORDER BY turn) AS n FROM items),
merged AS (SELECT conv_id, string_agg(item, '|' ORDER BY turn) AS items FROM f WHERE n = 1 GROUP BY conv_id),
parts AS (SELECT conv_id, count(*) AS n FROM said GROUP BY conv_id)
SELECT CAST(conv_id AS VARCHAR) AS source, 'limites_regulatorios' AS field, CASE WHEN n > 2 THEN n || ' partes' ELSE items END AS items FROM parts LEFT JOIN merged USING (conv_id) WHERE n > 2 OR items IS NOT NULL
""")
def extract_reduced(spark, sf_dir):
    """Answers whose items are objects, which are flattened, and a model that reduces the longer conversations."""
    words = F.regexp_extract_all("text", F.lit(text.TOKEN), F.lit(0))
    item = F.struct(F.get(words, 0).alias("accion"), F.get(words, 1).alias("detalle"))
    body = F.to_json(F.create_map(F.lit("limites_regulatorios"), F.array(item)))
    chunks = table(spark, sf_dir, "conversations").filter("text IS NOT NULL").select(F.col("conv_id").cast("string").alias("source"), F.col("turn").alias("page"), F.lit(0).alias("chunk_index"), body.alias("text"))
    return _listed(assistant.extract(chunks, "cot", _reduces_to_a_count))


def _listed(results: DataFrame) -> DataFrame:
    return results.filter(F.size("items") > 0).select("source", "field", F.array_join("items", "|").alias("items"))


@query(_ITEMS.format(_FIRST_WORD, "limites_regulatorios"))
def extract_items(spark, sf_dir):
    out = assistant.extract(_model_chunks(spark, sf_dir, "limites_regulatorios"), "zero_shot", _reduces_to_nothing)
    return _listed(out)


@query(_ITEMS.format(_FIRST_WORD, "decisiones"))
def summarize_items(spark, sf_dir):
    out = assistant.summarize(_model_chunks(spark, sf_dir, "decisiones"), "cot", _reduces_to_nothing)
    return _listed(out)


@query(r"""
SELECT doc_id AS query_id, sha256(CASE WHEN doc_id % 2 = 0 THEN regexp_replace(substr('Contexto:' || chr(10) || '[Fragmento 1] Fuente: ' || source || ' | Pagina: ' || doc_id || ' | Seccion: (sin titulo)' || chr(10) || chr(10) || text
  || chr(10) || chr(10) || 'Pregunta: Que dice ' || source || '?', 1, 1024), '\s+$', '') ELSE 'No encuentro esta informacion en los documentos indexados.' END) AS answer_sha256, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS n_sources FROM documents
""")
def answer_questions(spark, sf_dir):
    """A question for each document; the document is its hit for every other one, the rest find nothing."""
    from tesela.plans import retrieval

    d = documents(spark, sf_dir)
    questions = d.select(F.col("doc_id").alias("query_id"), F.concat(F.lit("Que dice "), "source", F.lit("?")).alias("question"))
    found = d.filter(F.col("doc_id") % 2 == 0)
    hits = found.select(F.col("doc_id").alias("group_id"), F.lit(0).alias("place"), "source", F.col("doc_id").alias("page"), F.lit("").alias("section_hint"), "text", F.lit(0.5).alias("distance"))
    out = retrieval.answer(questions, hits, models.echo_completer)
    return out.select("query_id", F.sha2("answer", 256).alias("answer_sha256"), F.coalesce(F.array_size("sources"), F.lit(0)).alias("n_sources"))
