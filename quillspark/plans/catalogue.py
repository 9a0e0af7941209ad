"""The registered retrieval queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.functions import vectors as vx
from quillspark.operators import chunking, dialogue, quality_of_search as quality, relational, rewriting, routing, search, tables
from quillspark.plans import retrieval
from quillspark.shared import lookup, spread
from quillspark.sources import parsing

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


#: Tables whose rows take long: in a single file they would keep one core busy.
_WIDE = {"documents", "pages", "embeddings"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in _WIDE else rows


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "chunk_id")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# --- scoring -------------------------------------------------------------------------------

_TOKENS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\r\f]+'), lambda x: x <> '')"
_INDEX = f"""
d AS (SELECT doc_id AS chunk_id, source, lang, {_TOKENS} AS tokens FROM documents),
t AS (SELECT chunk_id, source, lang, len(tokens) AS dl, unnest(tokens) AS term FROM d),
stats AS (SELECT count(*) AS n_docs, avg(len(tokens)) AS avgdl FROM d),
tf AS (SELECT chunk_id, source, lang, dl, term, count(*) AS tf FROM t GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM df, stats),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN (SELECT avg(raw) * 0.25 FROM raw) ELSE raw END AS idf FROM raw)"""
_BM25 = f"""{_INDEX},
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({_TOKENS}) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT query_id, chunk_id, any_value(lang) AS lang, any_value(source) AS source, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM q JOIN tf USING (term) JOIN idf USING (term), stats GROUP BY query_id, chunk_id),
bm25 AS (SELECT * FROM scored WHERE round(score, 6) <> 0)"""


def _ranked(source: str, k: int, where: str = "true", extra: str = "") -> str:
    return f"""SELECT query_id, chunk_id, round(score, 4) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM {source} WHERE {where}) WHERE rank <= {k}{extra}"""


def _out(df: DataFrame) -> DataFrame:
    return df.select("query_id", "chunk_id", F.round("score", 4).alias("score"), "rank")


@query("bm25_topk", f"WITH {_BM25} {_ranked('bm25', 10)}")
def bm25_topk(spark, sf_dir):
    return _out(search.bm25_search(search.bm25_index(_chunks(spark, sf_dir)), _questions(spark, sf_dir), 10))


@query("bm25_filtered", f"WITH {_BM25} {_ranked('bm25', 10, where=chr(39).join(['lang = ', 'en', '']))}")
def bm25_filtered(spark, sf_dir):
    return _out(search.bm25_search(search.bm25_index(_chunks(spark, sf_dir)), _questions(spark, sf_dir), 10, F.col("lang") == "en"))


@query("bm25_idf_stats", f"WITH {_INDEX} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_idf_stats(spark, sf_dir):
    return search.bm25_index(_chunks(spark, sf_dir)).idf.select("term", "df", F.round("idf", 6).alias("idf"))


_DOT = "list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[])"
#: The stated query set of vector searches: ids divisible by 100, against all rows.
_VECTOR = f"""vec AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, c.label, q.label AS query_label, {_DOT} AS score
  FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0)"""


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "chunk_id")


def _query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query("vector_topk", f"WITH {_VECTOR} {_ranked('vec', 10)}")
def vector_topk(spark, sf_dir):
    return _out(search.vector_search(_corpus(spark, sf_dir), _query_vectors(spark, sf_dir), 10))


@query("vector_topk_filtered", f"WITH {_VECTOR} {_ranked('vec', 10, 'label <= 4')}")
def vector_topk_filtered(spark, sf_dir):
    return _out(search.vector_search(_corpus(spark, sf_dir).where("label <= 4"), _query_vectors(spark, sf_dir), 10))


@query("vector_norms", "SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS norm, label FROM embeddings")
def vector_norms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vx.norm(F.col("embedding")), 4).alias("norm"), "label")


# A benchmark item's vector is the one with its id, a document's likewise: ids are the only link of these tables.
_HYBRID = f"""{_BM25},
vecq AS (SELECT item_id AS query_id, c.vec_id AS chunk_id, {_DOT} AS score FROM benchmark JOIN embeddings q ON q.vec_id = item_id, embeddings c),
v30 AS (SELECT query_id, chunk_id, round(score, 6) AS v, 0.0::DOUBLE AS b FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM vecq) WHERE rank <= 30),
b30 AS (SELECT query_id, chunk_id, 0.0::DOUBLE AS v, round(score, 6) AS b FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM bm25) WHERE rank <= 30),
merged AS (SELECT query_id, chunk_id, greatest(max(v), 0) AS v, greatest(max(b), 0) AS b FROM (FROM v30 UNION ALL FROM b30) GROUP BY ALL),
fused AS (SELECT query_id, chunk_id, v AS vector_score, b AS bm25_score,
  round(0.6 * CASE WHEN max(v) OVER w = min(v) OVER w THEN 1.0 ELSE (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) END
      + 0.4 * CASE WHEN max(b) OVER w = min(b) OVER w THEN 1.0 ELSE (b - min(b) OVER w) / (max(b) OVER w - min(b) OVER w) END, 4) AS score
  FROM merged WINDOW w AS (PARTITION BY query_id))"""


def _item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return items.join(table(spark, sf_dir, "embeddings"), F.col("query_id") == F.col("vec_id")).select("query_id", "embedding")


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, questions = search.bm25_index(_chunks(spark, sf_dir)), _questions(spark, sf_dir)
    six = lambda df: df.select("query_id", "chunk_id", F.round("score", 6).alias("score"))
    merged = search.merge_channels(six(search.vector_search(_corpus(spark, sf_dir), _item_vectors(spark, sf_dir), 30)), six(search.bm25_search(index, questions, 30)))
    return search.minmax_fuse(merged)


@query("hybrid_search", f"WITH {_HYBRID} {_ranked('fused', 10)}")
def hybrid_search(spark, sf_dir):
    index = search.bm25_index(_chunks(spark, sf_dir))
    return _out(search.hybrid_search(index, _corpus(spark, sf_dir), _questions(spark, sf_dir), _item_vectors(spark, sf_dir)))


@query("minmax_fusion", f"WITH {_HYBRID} SELECT query_id, chunk_id, vector_score, bm25_score, score FROM fused")
def minmax_fusion(spark, sf_dir):
    return _fused(spark, sf_dir).select("query_id", "chunk_id", "vector_score", "bm25_score", "score")


@query(
    "multi_query_max",
    f"""WITH {_INDEX}, q AS (SELECT query_id, v, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest([0, 1]) AS v, text FROM benchmark) x,
  LATERAL (SELECT unnest(list_filter(string_split_regex(lower(CASE WHEN v = 0 THEN x.text ELSE 'Experiments and Results ' || x.text END), '[ \t\n\r\f]+'), lambda y: y <> '')) AS term) GROUP BY ALL),
scored AS (SELECT query_id, v, chunk_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s FROM q JOIN tf USING (term) JOIN idf USING (term), stats GROUP BY ALL),
best AS (SELECT query_id, chunk_id, max(s) AS score FROM scored WHERE round(s, 6) <> 0 GROUP BY ALL) {_ranked('best', 10)}""",
)
def multi_query_max(spark, sf_dir):
    """Rewrites of a question (here itself and an expansion) search on their own; the best score of a chunk counts.

    A chunk among the ten best by its greatest score is among the ten best of the rewrite that gave it.
    """
    q = _questions(spark, sf_dir)
    both = F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("t")), F.struct(F.lit(1).alias("v"), F.concat(F.lit("Experiments and Results "), "text").alias("t"))))
    rewrites = q.select("query_id", both.alias("x")).select((F.col("query_id") * 2 + F.col("x.v")).alias("query_id"), F.col("x.t").alias("text"))
    found = search.bm25_search(search.bm25_index(_chunks(spark, sf_dir)), rewrites, 10)
    best = found.groupBy(F.floor(F.col("query_id") / 2).cast("long").alias("query_id"), "chunk_id").agg(F.max("score").alias("score"))
    return _out(search.top_k(best, 10))


# --- what a question asks for ----------------------------------------------------------------


def _any(col: str, words: list[str]) -> str:
    return f"regexp_matches(lower({col}), '{'|'.join(words)}')"


def _intent_sql(col: str) -> str:
    return "CASE " + " ".join(f"WHEN {_any(col, words)} THEN '{name}'" for name, words in routing.INTENTS.items()) + " ELSE 'general' END"


@query("intent_detect", f"SELECT conv_id, turn, {_intent_sql('text')} AS intent FROM conversations")
def intent_detect(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", routing.intent(F.col("text")).alias("intent"))


_BOOST_SQL = "CASE " + " ".join(f"WHEN intent = '{n}' AND {_any('title', w)} THEN {1.3 if n == 'architecture' else 1.8}" for n, w in routing.SECTION_WORDS.items())


@query(
    "section_boost",
    f"""WITH a AS (SELECT item_id, text, {_intent_sql('text')} AS intent, p_type AS title FROM benchmark JOIN part ON p_partkey = item_id)
SELECT item_id, title, round(({_BOOST_SQL} WHEN intent = 'general' AND len(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '' AND contains(lower(title), w))) > 0 THEN 1.3 ELSE 1.0 END)::DOUBLE, 2) AS boost FROM a""",
)
def section_boost(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").withColumn("intent", routing.intent(F.col("text")))
    titled = items.join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("title")), F.col("p_partkey") == F.col("item_id"))
    return titled.select("item_id", "title", F.round(routing.section_boost(F.col("text"), F.col("intent"), F.col("title")), 2).alias("boost"))


# Questions with references, made of table values, as no table holds any.
_ASKED = """SELECT p_partkey AS query_id, CASE p_partkey % 9 WHEN 0 THEN 'what does section ' || p_size || '.' || (p_partkey % 7) || ' say'
  WHEN 1 THEN 'show Table ' || p_size || ' of the SamNet paper' WHEN 2 THEN 'the 2507.' || (10000 + p_partkey % 90000) || 'v2 results'
  WHEN 3 THEN p_size || '.3 attention blocks' WHEN 4 THEN '第' || p_size || '节 ' || p_brand WHEN 5 THEN 'Related Work of ' || p_brand
  WHEN 6 THEN '表 ' || p_size || ' in ' || p_name WHEN 7 THEN 'Table_' || p_size || ' as it is' ELSE p_name END AS text FROM part"""
_ASKED_SPARK = _ASKED.replace("p_size || '.'", "cast(p_size as string) || '.'")
_NAMES_SQL = "CASE " + " ".join(f"WHEN contains(lower(text), '{n}') THEN '{n.title()}'" for n in routing.SECTION_NAMES) + " END"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_ASKED.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))


_REFS = f"""refs AS (SELECT query_id, text,
  coalesce(nullif(regexp_extract(text, '\\b([0-9]{{4}}\\.[0-9]{{4,5}}v?[0-9]*)\\b', 1), ''),
    CASE WHEN length(nullif(trim(regexp_extract(text, '(?:论文|论[文著])\\s*["'']?([^"'']{{2,30}}?)["'']?\\s*(?:的|中|里|第)', 1)), '')) >= 2 THEN trim(regexp_extract(text, '(?:论文|论[文著])\\s*["'']?([^"'']{{2,30}}?)["'']?\\s*(?:的|中|里|第)', 1)) END,
    CASE WHEN length(regexp_extract(text, '(?:the\\s+)?([A-Z][A-Za-z0-9-]+)\\s+(?:paper|论文|model)', 1)) >= 3 THEN regexp_extract(text, '(?:the\\s+)?([A-Z][A-Za-z0-9-]+)\\s+(?:paper|论文|model)', 1) END) AS paper_ref,
  coalesce(nullif(regexp_extract(text, '(?:第\\s*)?([0-9]+(?:\\.[0-9]+)*)\\s*[节章]', 1), ''), nullif(regexp_extract(text, '(?:Section|section|CHAPTER|Chapter)\\s+([0-9]+(?:\\.[0-9]+)*)', 1), ''),
    nullif(regexp_extract(text, '^([0-9]+(?:\\.[0-9]+)*)\\s', 1), ''), {_NAMES_SQL}) AS section_ref,
  CASE WHEN regexp_extract(text, '(?:(?:[Tt]able|[Tt]ab)\\b|表)\\s*[-_.]?\\s*([0-9]+)', 1) <> '' THEN 'Table_' || regexp_extract(text, '(?:(?:[Tt]able|[Tt]ab)\\b|表)\\s*[-_.]?\\s*([0-9]+)', 1) END AS table_ref
  FROM ({_ASKED}))"""


@query("extract_refs", f"WITH {_REFS} SELECT query_id, paper_ref, section_ref, table_ref FROM refs")
def extract_refs(spark, sf_dir):
    return _asked(spark, sf_dir).select("query_id", *[c.alias(n) for n, c in routing.references(F.col("text")).items()])


_STOPS = ", ".join(f"'{w}'" for w in routing.STOP_WORDS)
_GOOD = f"length(x) >= 2 AND NOT list_contains([{_STOPS}], x)"


@query("filename_router", f"""WITH f AS (SELECT stem || '.pdf' AS source, lower(replace(stem, '_', ' ')) AS norm, string_split(lower(stem), '_') AS p FROM (SELECT DISTINCT replace(p_type, ' ', '_') || '_' || p_size AS stem FROM part)),
ft AS (SELECT source, norm, list_distinct(list_filter(p, lambda x: length(x) >= 2 OR regexp_full_match(x, '[0-9]+')) || list_transform(list_filter(range(1, len(p)), lambda i: length(p[i]) >= 2), lambda i: p[i] || '_' || p[i + 1])) AS tokens FROM f),
q AS (SELECT p_partkey AS query_id, string_split(lower('what about ' || p_type || ' ' || p_size), ' ') AS p FROM part),
near AS (SELECT query_id, p, list_filter(range(1, len(p)), lambda i: len(list_filter([p[i]], lambda x: {_GOOD})) > 0) AS places FROM q),
qt AS (SELECT query_id, unnest(list_distinct(list_filter(p, lambda x: {_GOOD}) || list_transform(places, lambda i: p[i] || '_' || p[i + 1]) || list_transform(list_filter(places, lambda i: regexp_full_match(p[i + 1], '[0-9]+')), lambda i: p[i] || p[i + 1]))) AS token FROM near),
own AS (SELECT source, unnest(tokens) AS token FROM ft), df AS (SELECT token, count(*) AS df FROM own GROUP BY token),
words AS (SELECT DISTINCT token, 1 + ln(((SELECT count(*) FROM ft) + 1) / (coalesce(df, 0) + 1)::DOUBLE) AS idf FROM qt LEFT JOIN df USING (token)),
hit AS (SELECT token, source, max(part) AS part FROM (SELECT token, source, 2.0 * idf AS part FROM words JOIN own USING (token) UNION ALL
  SELECT token, source, 1.2 * idf FROM words, ft WHERE length(token) >= 3 AND (contains(norm, token) OR contains(replace(norm, ' ', ''), token))) GROUP BY ALL),
scored AS (SELECT query_id, source, round(sum(part) * CASE WHEN count(*) >= 2 THEN 1.15 ELSE 1 END, 6) AS score FROM qt JOIN hit USING (token) GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS rn, coalesce(lead(score) OVER w, 0) AS second FROM scored WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, source))
SELECT query_id, source, round(score, 4) AS score FROM r WHERE rn = 1 AND score >= 2.8 AND NOT (second > 0 AND score - second < 1.2 AND second >= 0.8 * 2.8)""")
def filename_router(spark, sf_dir):
    """Files named by part types and sizes; questions are the same words in prose."""
    part = table(spark, sf_dir, "part")
    sources = part.select(F.concat(F.replace("p_type", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_size").cast("string"), F.lit(".pdf")).alias("source")).distinct()
    questions = part.select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("what about "), "p_type", F.lit(" "), F.col("p_size").cast("string")).alias("text"))
    return routing.filename_router(questions, sources)


_CAND = """cand AS (SELECT r.query_id, l.l_orderkey * 10 + l.l_linenumber AS chunk_id, r.paper_ref, r.section_ref, r.table_ref, l.l_quantity AS score,
  'samnet_' || l.l_suppkey || '.pdf' AS source, (l.l_linenumber || '.' || (l.l_orderkey % 7)) AS section_id, 'Table_' || (l.l_quantity::BIGINT) AS table_id FROM refs r JOIN lineitem l ON l.l_partkey = r.query_id)"""
_TIERED = """tiered AS (SELECT *, CASE
  WHEN table_ref IS NOT NULL THEN CASE WHEN table_id = table_ref AND (paper_ref IS NULL OR contains(lower(source), lower(paper_ref))) THEN 0 WHEN table_id = table_ref THEN 1 END
  WHEN paper_ref IS NOT NULL AND section_ref IS NOT NULL AND contains(lower(source), lower(paper_ref)) AND starts_with(section_id, section_ref) THEN 2
  WHEN paper_ref IS NOT NULL AND contains(lower(source), lower(paper_ref)) THEN 3
  WHEN paper_ref IS NULL AND section_ref IS NOT NULL AND starts_with(section_id, section_ref) THEN 4
  WHEN paper_ref IS NULL THEN 5 END::BIGINT AS tier FROM cand)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _asked(spark, sf_dir).select("query_id", *[c.alias(n) for n, c in routing.references(F.col("text")).items()])
    line = table(spark, sf_dir, "lineitem")
    return line.join(refs, line["l_partkey"] == refs["query_id"]).select(
        "query_id",
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"),
        "paper_ref", "section_ref", "table_ref",
        F.col("l_quantity").alias("score"),
        F.concat(F.lit("samnet_"), F.col("l_suppkey").cast("string"), F.lit(".pdf")).alias("source"),
        F.concat(F.col("l_linenumber").cast("string"), F.lit("."), (F.col("l_orderkey") % 7).cast("string")).alias("section_id"),
        F.concat(F.lit("Table_"), F.col("l_quantity").cast("bigint").cast("string")).alias("table_id"),
    )


@query("cascade_tiers", f"WITH {_REFS}, {_CAND}, {_TIERED} SELECT query_id, chunk_id, tier FROM (SELECT *, min(tier) OVER (PARTITION BY query_id) AS best FROM tiered WHERE tier IS NOT NULL) WHERE tier = best")
def cascade_tiers(spark, sf_dir):
    return routing.tiers(_candidates(spark, sf_dir)).select("query_id", "chunk_id", "tier")


@query("exact_table_lock", f"""WITH {_REFS}, {_CAND} SELECT query_id, chunk_id, table_ref FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rn
  FROM cand WHERE table_ref IS NULL OR table_id = table_ref) WHERE table_ref IS NULL OR rn = 1""")
def exact_table_lock(spark, sf_dir):
    return routing.table_lock(_candidates(spark, sf_dir)).select("query_id", "chunk_id", "table_ref")


@query("keyword_source", "SELECT n_name AS keyword, min_by(p_brand, p_partkey) AS source FROM (SELECT DISTINCT 'Brand#' || (n_nationkey % 5 + 1) AS n_name FROM nation), part WHERE contains(lower(p_brand), lower(n_name)) GROUP BY n_name")
def keyword_source(spark, sf_dir):
    """The first source, by index, whose name has the keyword."""
    keys = table(spark, sf_dir, "nation").select(F.concat(F.lit("Brand#"), (F.col("n_nationkey") % 5 + 1).cast("string")).alias("keyword")).distinct()
    sources = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("source")).agg(F.min("p_partkey").alias("idx")).withColumns({"title": F.lit(""), "archive_id": F.lit("")})
    return relational.keyword_source(keys, sources)


# --- ingest ----------------------------------------------------------------------------------


@query("incremental_anti_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 0)")
def incremental_anti_join(spark, sf_dir):
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source"), "c_name")
    indexed = table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").select(F.col("o_custkey").alias("source"))
    return relational.not_indexed(files, indexed).select(F.col("source").alias("c_custkey"), "c_name")


_FILES = "SELECT CASE WHEN doc_id % 3 = 0 THEN (2000 + doc_id % 100) || '.' || (10000 + doc_id % 80000) || '.pdf' ELSE source || '_' || lang || '_' || doc_id || '.pdf' END AS file, doc_id FROM documents"
_MANIFEST = "SELECT file, '2401.' || (10000 + doc_id % 80000) AS archive_id, 'Paper ' || doc_id AS title FROM ({files}) WHERE doc_id % 4 = 1"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_FILES.replace("FROM documents", "FROM {docs}"), docs=table(spark, sf_dir, "documents"))


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_MANIFEST.replace("({files})", "{files}"), files=_files(spark, sf_dir))


@query("manifest_enrich", f"""WITH f AS ({_FILES}), m AS ({_MANIFEST.format(files=_FILES)}) SELECT f.file,
  CASE WHEN m.file IS NOT NULL THEN m.archive_id WHEN regexp_matches(replace(f.file, '.pdf', ''), '^[0-9]{{4}}\\.[0-9]{{4,5}}([vV][0-9]+)?$') THEN replace(f.file, '.pdf', '') ELSE '' END AS archive_id,
  CASE WHEN m.file IS NOT NULL THEN m.title WHEN regexp_matches(replace(f.file, '.pdf', ''), '^[0-9]{{4}}\\.[0-9]{{4,5}}([vV][0-9]+)?$') THEN '' ELSE replace(replace(f.file, '.pdf', ''), '_', ' ') END AS title FROM f LEFT JOIN m USING (file)""")
def manifest_enrich(spark, sf_dir):
    return relational.enrich(_files(spark, sf_dir).select("file"), _manifest(spark, sf_dir))


@query("manifest_merge", """WITH a AS (SELECT c_custkey AS key, c_name AS val FROM customer WHERE c_acctbal > 0), b AS (SELECT c_custkey AS key, c_mktsegment AS val FROM customer)
SELECT key, val FROM a UNION ALL SELECT key, val FROM b WHERE key NOT IN (SELECT key FROM a)""")
def manifest_merge(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    existing = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("val"))
    return relational.first_wins(existing, c.select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("val")), "key")


@query("resolve_priority", f"""WITH w AS (SELECT (2000 + doc_id % 100) || '.' || (10000 + doc_id % 80000) AS archive_id, source || '_' || lang AS stem, doc_id FROM documents),
f AS (SELECT file FROM ({_FILES})), m AS (SELECT (2000 + doc_id % 100) || '.' || (10000 + doc_id % 80000) AS archive_id, 'kept_' || doc_id || '.pdf' AS file FROM documents WHERE doc_id % 5 = 0),
s AS (SELECT regexp_replace(file, '_[^_]*\\.pdf$', '') AS base, min(file) AS file FROM f WHERE regexp_matches(file, '_[^_]*\\.pdf$') GROUP BY ALL)
SELECT w.archive_id, w.stem, coalesce(m.file, i.file, t.file, s.file) AS file FROM w LEFT JOIN m USING (archive_id) LEFT JOIN (SELECT DISTINCT file FROM f) i ON i.file = w.archive_id || '.pdf'
LEFT JOIN (SELECT DISTINCT file FROM f) t ON t.file = w.stem || '.pdf' LEFT JOIN s ON s.base = w.stem""")
def resolve_priority(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    archive = F.expr("(2000 + doc_id % 100) || '.' || (10000 + doc_id % 80000)")
    wanted = docs.select(archive.alias("archive_id"), F.concat("source", F.lit("_"), "lang").alias("stem"))
    manifest = docs.where("doc_id % 5 = 0").select(archive.alias("archive_id"), F.expr("'kept_' || doc_id || '.pdf'").alias("file"))
    return relational.resolve(wanted, _files(spark, sf_dir).select("file"), manifest)


@query("section_bundle", f"""WITH {_BM25}, hits AS (SELECT query_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM bm25) WHERE rank <= 3),
listed AS (SELECT doc_id AS chunk_id, source, lang FROM (SELECT *, count(*) OVER (PARTITION BY source, lang) AS n FROM documents) WHERE n >= 3),
sib AS (SELECT DISTINCT query_id, l.chunk_id, 0.0::DOUBLE AS score FROM hits h JOIN documents d ON d.doc_id = h.chunk_id JOIN listed l ON l.source = d.source AND l.lang = d.lang)
SELECT query_id, chunk_id, round(max(score), 4) AS score FROM (FROM sib UNION ALL FROM hits) GROUP BY ALL""")
def section_bundle(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    hits = search.bm25_search(search.bm25_index(chunks), _questions(spark, sf_dir), 3).select("query_id", "chunk_id", "score")
    placed = chunks.select("chunk_id", "source", "lang", F.lit("").alias("section_title"), F.col("chunk_id").alias("idx"))
    return relational.bundle_sections(hits, placed, ["source", "lang"]).withColumn("score", F.round("score", 4))


@query("text_backfill", """WITH r AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN '' ELSE text END AS text FROM documents)
SELECT doc_id, coalesce(nullif(r.text, ''), nullif(a.text, ''), nullif(b.text, '')) AS text FROM r LEFT JOIN benchmark a ON a.item_id = doc_id LEFT JOIN benchmark b ON b.item_id + 50 = doc_id""")
def text_backfill(spark, sf_dir):
    """Missing texts by id, else by place; an item's place is 50 more than its id."""
    text = F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 1, "").otherwise(F.col("text"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("idx"), text.alias("text"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("chunk_id"), (F.col("item_id") + 50).alias("idx"), "text")
    return relational.backfill(rows, items).select(F.col("chunk_id").alias("doc_id"), "text")


_FIGURES = "SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS paper, (l_quantity::INT) AS page_no, CASE l_linenumber % 3 WHEN 0 THEN 'page' WHEN 1 THEN 'figure' ELSE 'table' END AS kind FROM lineitem"


@query("page_neighbourhood", f"""WITH f AS ({_FIGURES}), t AS (SELECT s_suppkey AS target_id, s_suppkey AS paper, 1 + s_suppkey % 50 AS page_no, 'figure' AS kind FROM supplier)
SELECT target_id, id, f.page_no::BIGINT AS page_no, f.kind FROM t JOIN f ON f.paper = t.paper AND f.page_no BETWEEN greatest(1, t.page_no - 3) AND t.page_no + 3 AND (f.kind = t.kind OR f.kind = 'page')""")
def page_neighbourhood(spark, sf_dir):
    figures = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("paper"), F.col("l_quantity").cast("int").alias("page_no"), F.expr("case l_linenumber % 3 when 0 then 'page' when 1 then 'figure' else 'table' end").alias("kind"))
    targets = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("target_id"), F.col("s_suppkey").alias("paper"), (1 + F.col("s_suppkey") % 50).cast("int").alias("page_no"), F.lit("figure").alias("kind"))
    return relational.page_neighbourhood(figures, targets).select("target_id", "id", F.col("page_no").cast("long").alias("page_no"), "kind")


@query("lag_context", """SELECT conv_id, turn, left('[Talk ' || conv_id || '] | Section: ' || role || CASE WHEN lag(text) OVER w <> '' THEN ' | Prev: ' || left(string_split(lag(text) OVER w, '. ')[1], 150) ELSE '' END || ' | ' || text, 4096) AS embed_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def lag_context(spark, sf_dir):
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    told = tx.embed_text(F.concat(F.lit("Talk "), F.col("conv_id").cast("string")), F.col("role"), before, F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", told.alias("embed_text"))


@query("heading_spans", """WITH l AS (SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS line FROM documents),
h AS (SELECT doc_id, n - 1 AS line_no FROM l WHERE length(line) BETWEEN 1 AND 40) SELECT doc_id, line_no::BIGINT AS line_no, lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no)::BIGINT AS next_no FROM h""")
def heading_spans(spark, sf_dir):
    """Each short line and where the next one starts."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line")).where("char_length(line) between 1 and 40")
    line_no = F.col("n").cast("long")
    return lines.select("doc_id", line_no.alias("line_no"), F.lead(line_no).over(Window.partitionBy("doc_id").orderBy("n")).alias("next_no"))


@query("stem_match", """WITH n AS (SELECT item_id AS query_id, text, item_id || '_' || regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '_', 'g') || '.pdf' AS source FROM benchmark),
w AS (SELECT query_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: length(t) > 3))) AS word FROM n),
s AS (SELECT source, unnest(list_distinct(list_filter(string_split_regex(lower(left(source, length(source) - 4)), '[^\\p{L}\\p{N}]+'), lambda t: length(t) > 3))) AS word FROM n),
h AS (SELECT query_id, source, count(*) AS hits FROM w JOIN s USING (word) GROUP BY ALL HAVING count(*) >= 3) SELECT query_id, source, hits FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, source) AS rn FROM h) WHERE rn = 1""")
def stem_match(spark, sf_dir):
    """Files named by the words of whole items."""
    q = _questions(spark, sf_dir)
    name = F.concat(F.col("query_id").cast("string"), F.lit("_"), F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", "_"), F.lit(".pdf"))
    return relational.stem_matches(q, q.select(name.alias("source")))


@query("dedup_prefix500", "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY left(text, 500) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def dedup_prefix500(spark, sf_dir):
    return relational.dedup_text(table(spark, sf_dir, "documents"), [F.col("doc_id")]).select("doc_id", "source")


@query("dedup_idx", """WITH r AS (SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey END AS idx FROM orders)
SELECT o_orderkey, idx FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY o_orderkey) AS rn FROM r) WHERE rn = 1 OR idx IS NULL""")
def dedup_idx(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")).alias("idx"))
    return relational.dedup_index(rows, "idx", [F.col("o_orderkey")])


@query("chunk_ids", "SELECT doc_id, source, row_number() OVER (ORDER BY source, doc_id) - 1 AS idx FROM documents")
def chunk_ids(spark, sf_dir):
    return relational.numbered(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source", "doc_id"])


@query("abstract_union", """SELECT doc_id, 0::BIGINT AS ordinal, 'abstract' AS chunk_type, source || ' in ' || lang || ': ' || text AS text FROM documents UNION ALL SELECT doc_id, 1::BIGINT, 'body', text FROM documents""")
def abstract_union(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    part = lambda n, kind, text: d.select("doc_id", F.lit(n).cast("long").alias("ordinal"), F.lit(kind).alias("chunk_type"), text.alias("text"))
    return part(0, "abstract", F.concat("source", F.lit(" in "), "lang", F.lit(": "), "text")).unionByName(part(1, "body", F.col("text")))


# --- filters, projections, scalar functions ------------------------------------------------------


@query("date_range_filter", "SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day FROM orders WHERE o_orderdate::DATE BETWEEN '1995-03-01' AND '1996-06-30' OR o_orderdate IS NULL")
def date_range_filter(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(tx.in_date_range(F.col("o_orderdate"), "1995-03-01", "1996-06-30")).select("o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("day"))


@query("date_clause", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'lastUpdatedDate' ELSE 'submittedDate' END || ':[' || CASE WHEN o_orderkey % 3 = 0 THEN '*' ELSE strftime(o_orderdate, '%Y%m%d') || '0000' END || ' TO ' || strftime(o_orderdate + INTERVAL 30 DAY, '%Y%m%d') || '2359]' AS clause FROM orders""")
def date_clause(spark, sf_dir):
    low = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate").cast("date"))
    high = F.date_add(F.col("o_orderdate").cast("date"), 30)
    field = F.when(F.col("o_orderstatus") == "O", "updated").otherwise("submitted")
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.date_clause(low, high, field).alias("clause"))


@query("category_overlap", "SELECT p_partkey, p_type FROM part WHERE list_has_any(string_split(p_type, ' '), ['BRASS', 'SMALL', 'PROMO'])")
def category_overlap(spark, sf_dir):
    wanted = F.array(F.lit("BRASS"), F.lit("SMALL"), F.lit("PROMO"))
    return table(spark, sf_dir, "part").where(F.arrays_overlap(F.split("p_type", " "), wanted)).select("p_partkey", "p_type")


@query("prefix_filter", "SELECT p_partkey, p_brand, p_size FROM part WHERE starts_with(p_brand, 'Brand#2') AND starts_with(p_size::VARCHAR, '1')")
def prefix_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_brand").startswith("Brand#2") & F.col("p_size").cast("string").startswith("1")).select("p_partkey", "p_brand", "p_size")


@query("metadata_filter", "SELECT doc_id, n_chars FROM documents WHERE lang = 'fr' AND source = 'src3'")
def metadata_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where((F.col("lang") == "fr") & (F.col("source") == "src3")).select("doc_id", "n_chars")


@query("nonempty_filter", "SELECT doc_id FROM documents WHERE trim(text) <> ''")
def nonempty_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.trim("text") != "").select("doc_id")


@query("like_search", "SELECT doc_id, source FROM documents WHERE text ILIKE '%license%' OR source ILIKE '%license%' ORDER BY doc_id LIMIT 20")
def like_search(spark, sf_dir):
    figures = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("paper_source"), F.col("source").alias("caption"), F.col("text").alias("page_text"))
    return relational.search_captions(figures, "license").select(F.col("id").alias("doc_id"), F.col("paper_source").alias("source"))


@query("figure_lookup", f"SELECT id, page_no::BIGINT AS page_no, kind FROM ({_FIGURES}) WHERE paper = 1 AND kind <> 'page' ORDER BY page_no, id LIMIT 20")
def figure_lookup(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").where("l_suppkey = 1 and l_linenumber % 3 <> 0")
    rows = line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").cast("int").cast("long").alias("page_no"), F.expr("case l_linenumber % 3 when 1 then 'figure' else 'table' end").alias("kind"))
    return rows.orderBy("page_no", "id").limit(20)


@query("point_lookup", "SELECT doc_id, source, lang, n_chars FROM documents WHERE doc_id = 42")
def point_lookup(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("doc_id = 42").select("doc_id", "source", "lang", "n_chars").limit(1)


@query("remote_sort", "SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def remote_sort(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(20).select("o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("day"))


@query("result_projection", """SELECT doc_id, left(text, 1500) AS text, round(coalesce(quality::DOUBLE, n_chars / 1000.0), 4) AS score, CASE WHEN source = 'src1' THEN 'Table_' || (doc_id % 9) END AS table_id,
  array_to_string(list_slice(string_split(text, ' '), 1, 3), ' ') AS authors, left(text, 200) AS abstract FROM documents LEFT JOIN labels USING (doc_id)""")
def result_projection(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    score = F.round(F.coalesce(F.col("quality").cast("double"), F.col("n_chars") / 1000.0), 4)
    return d.select("doc_id", F.substring("text", 1, 1500).alias("text"), score.alias("score"), F.when(F.col("source") == "src1", F.concat(F.lit("Table_"), (F.col("doc_id") % 9).cast("string"))).alias("table_id"), F.array_join(F.slice(F.split("text", " ", -1), 1, 3), " ").alias("authors"), F.substring("text", 1, 200).alias("abstract"))


@query("section_distribution", "SELECT source, lang, count(*) AS n, min_by(text, doc_id) AS first_title FROM documents GROUP BY ALL")
def section_distribution(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.min_by("text", "doc_id").alias("first_title"))


@query("duplicate_ids", "SELECT p_brand, p_type, count(*) AS n, count(DISTINCT p_size) AS n_sizes FROM part GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.countDistinct("p_size").alias("n_sizes")).where("n > 1")


@query("table_stats", "SELECT source, count(*) AS n, count(DISTINCT lang) AS n_langs, sum((length(text) > 2000)::BIGINT)::BIGINT AS n_long FROM documents GROUP BY source HAVING count(*) >= 5")
def table_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("lang").alias("n_langs"), F.count_if(F.char_length("text") > 2000).alias("n_long")).where("n >= 5")


@query("markup_counts", "SELECT count_if(contains(html, 'href='))::BIGINT AS n_href, count_if(contains(html, 'colspan='))::BIGINT AS n_colspan, count_if(contains(html, 'rowspan='))::BIGINT AS n_rowspan FROM pages")
def markup_counts(spark, sf_dir):
    has = lambda s: F.count_if(F.contains("html", F.lit(s)))
    return table(spark, sf_dir, "pages").agg(has("href=").alias("n_href"), has("colspan=").alias("n_colspan"), has("rowspan=").alias("n_rowspan"))


@query("first_seen_sources", "SELECT source, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY source")
def first_seen_sources(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


@query("kwic_audit", "SELECT doc_id, (length(text) - length(replace(text, 'License', ''))) // 7 AS n, substr(text, greatest(1, instr(text, 'License') - 20), 47) AS kwic FROM documents WHERE contains(text, 'License')")
def kwic_audit(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("License")))
    return d.select("doc_id", F.regexp_count("text", F.lit("License")).cast("long").alias("n"), F.substring("text", F.greatest(F.lit(1), F.instr("text", "License") - 20), F.lit(47)).alias("kwic"))


@query("token_estimate", "SELECT doc_id, floor(length(regexp_replace(text, '[^一-鿿]', '', 'g')) / 1.5 + (length(text) - length(regexp_replace(text, '[^一-鿿]', '', 'g'))) / 4.0)::BIGINT AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


@query("paragraph_split", "SELECT doc_id, generate_subscripts(p, 1) - 1 AS ordinal, unnest(p) AS paragraph FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 20) AS p FROM documents)")
def paragraph_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.paragraphs(F.col("text"), "\n")).alias("n", "paragraph"))
    return d.select("doc_id", F.col("n").cast("long").alias("ordinal"), "paragraph")


@query("title_extract", "SELECT doc_id, coalesce(list_filter(list_transform(list_slice(string_split(text, chr(10)), 1, 10), lambda x: trim(x)), lambda x: length(x) > 10 AND NOT starts_with(x, 'arXiv'))[1], '') AS title FROM documents")
def title_extract(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.title_of(F.col("text")).alias("title"))


@query("table_id_from_caption", """SELECT p_partkey, 'Table_' || coalesce(nullif(regexp_extract(c, '(?i)table\\s*([0-9]+)', 1), ''), CASE upper(regexp_extract(c, '(?i)table\\s+(x|ix|iv|v?i{1,3}|v)(?:[^a-z0-9]|$)', 1))
  WHEN 'I' THEN '1' WHEN 'II' THEN '2' WHEN 'III' THEN '3' WHEN 'IV' THEN '4' WHEN 'V' THEN '5' WHEN 'VI' THEN '6' WHEN 'VII' THEN '7' WHEN 'VIII' THEN '8' WHEN 'IX' THEN '9' WHEN 'X' THEN '10' END, (p_partkey % 50)::VARCHAR) AS table_id
FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Table ' || p_size || ': ' || p_name WHEN 1 THEN 'TABLE ' || ['I','II','III','IV','V','VI','VII','VIII','IX','X'][1 + p_size % 10] || '. ' || p_name ELSE p_name END AS c FROM part)""")
def table_id_from_caption(spark, sf_dir):
    names = F.array(*map(F.lit, ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X"]))
    size = F.col("p_size").cast("string")
    caption = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Table "), size, F.lit(": "), "p_name")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("TABLE "), F.element_at(names, (1 + F.col("p_size") % 10).cast("int")), F.lit(". "), "p_name")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.table_id(caption, F.col("p_partkey") % 50).alias("table_id"))


@query("figure_captions", """SELECT p_partkey, CASE WHEN contains(lower(left(c, 10)), 'table') THEN 'table' ELSE 'figure' END AS kind, regexp_extract(c, '(?i)^(?:figure|fig\\.?|table)\\s+([0-9]+)', 1)::BIGINT AS num
FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Fig. ' || p_size || ': ' || p_name WHEN 1 THEN 'TABLE ' || p_size || '. ' || p_name WHEN 2 THEN 'Figure ' || p_size || ' shows ' || p_name ELSE p_name END AS c FROM part) WHERE regexp_matches(c, '(?i)^(?:figure|fig\\.?|table)\\s+[0-9]+[.:]\\s')""")
def figure_captions(spark, sf_dir):
    size = F.col("p_size").cast("string")
    k = F.col("p_partkey") % 4
    caption = F.when(k == 0, F.concat(F.lit("Fig. "), size, F.lit(": "), "p_name")).when(k == 1, F.concat(F.lit("TABLE "), size, F.lit(". "), "p_name")).when(k == 2, F.concat(F.lit("Figure "), size, F.lit(" shows "), "p_name")).otherwise(F.col("p_name"))
    rows = table(spark, sf_dir, "part").withColumn("c", caption).where(F.col("c").rlike(r"(?i)^(?:figure|fig\.?|table|图|表)\s+[0-9]+[.:]\s"))
    return rows.select("p_partkey", F.when(F.contains(F.lower(F.substring("c", 1, 10)), F.lit("table")) | F.col("c").startswith("表"), "table").otherwise("figure").alias("kind"), F.regexp_extract("c", r"(?i)^(?:figure|fig\.?|table|图|表)\s+([0-9]+)", 1).cast("long").alias("num"))


@query("slugify", "SELECT p_partkey, left(replace(replace(p_name || ' ' || p_type || '.pdf', '.pdf', ''), ' ', '_'), 80) AS slug FROM part")
def slugify(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.slug(F.concat("p_name", F.lit(" "), "p_type", F.lit(".pdf"))).alias("slug"))


@query("archive_id_test", f"SELECT doc_id, regexp_matches(replace(file, '.pdf', ''), '^[0-9]{{4}}\\.[0-9]{{4,5}}([vV][0-9]+)?$') AS is_id FROM ({_FILES})")
def archive_id_test(spark, sf_dir):
    return _files(spark, sf_dir).select("doc_id", tx.is_archive_id(F.replace("file", F.lit(".pdf"), F.lit(""))).alias("is_id"))


@query("html_links", "SELECT page_id, link, CASE WHEN regexp_matches(link, '(?i)github\\.com|gitlab\\.com') THEN 'code' ELSE 'link' END AS label FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS link FROM pages)")
def html_links(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(tx.links(F.col("html"))).alias("link"))
    return found.select("page_id", "link", tx.link_label(F.col("link")).alias("label"))


@query("html_strip", """SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '[ \t\n\r\f]+', ' ', 'g')) AS text FROM pages""")
def html_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.strip_html(F.col("html")).alias("text"))


@query("props_json", "SELECT event_id, json_extract_string(props, '$.' || k) AS v, k FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def props_json(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("k", "v"))
    return rows.select("event_id", "v", "k")


@query("glued_text_clean")
def glued_text_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.unglue(F.col("text")).alias("text"))


@query("hash_embedding")
def hash_embedding(spark, sf_dir):
    """The offline embedder over the benchmark items."""
    return table(spark, sf_dir, "benchmark").select("item_id", vx.hashed_embedding(tx.tokenize(F.col("text"))).alias("embedding"))


@query("greedy_chunk")
def greedy_chunk(spark, sf_dir):
    return chunking.chunk(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], "text", separator="\n")


# Papers made of documents, as no table has headings: keyword, Roman with torn capitals, letter and Arabic headings, weak ones (the second too
# near the first), a table block, blank lines, a reference list; each tenth has its text alone.
_PAPERS = """SELECT 'p' || doc_id AS source, CASE WHEN doc_id % 10 = 9 THEN body ELSE 'A study numbered ' || doc_id || nl || 'Abstract' || nl || coalesce(text, '') || nl
  || CASE doc_id % 3 WHEN 0 THEN 'I. I NTRODUCTION AND SCOPE' WHEN 1 THEN '## 1. Introduction' ELSE 'Introduction' END || nl || body || nl || 'A. Dataset used here' || nl || body || nl || '2.1 Training loss' || nl
  || '[TABLE_HTML: Table_' || (doc_id % 12) || ' | Page 2]' || nl || nl || '<table><tr><th>Method</th></tr></table>' || nl || '[/TABLE_HTML]' || nl || body || nl || 'Model Overview' || nl || 'Training Setup' || nl || body || nl
  || 'Reference' || nl || body END AS full_text FROM (SELECT doc_id, text, replace(coalesce(text, ''), chr(10), chr(10) || chr(10)) AS body, chr(10) AS nl FROM documents)"""


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_PAPERS.replace("FROM documents", "FROM {docs}"), docs=table(spark, sf_dir, "documents"))


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _capitals_sql(text: str) -> str:
    text = f"regexp_replace(trim({text}, {_WS}), '\\s+', ' ', 'g')"
    for _ in range(5):
        text = f"regexp_replace({text}, '([A-Z])\\s+([A-Z])', '\\1\\2', 'g')"
    return text


_WORDS_N = "len(list_filter(string_split_regex({}, '\\s+'), lambda w: w <> ''))"
_TITLE_WORD = "regexp_matches(lower({}), '" + "|".join(chunking.TITLE_WORDS) + "')"
_SECTIONS_SQL = f"""papers AS ({_PAPERS}),
lines AS (SELECT source, string_split(full_text, chr(10)) AS lines FROM papers),
each AS (SELECT source, generate_subscripts(lines, 1) - 1 AS i, trim(unnest(lines), {_WS}) AS line FROM lines),
short AS (SELECT source, i, line, regexp_extract(line, '{chunking.KEYWORD}', 1) AS word, upper(regexp_extract(line, '{chunking.ROMAN}', 1)) AS roman, {_capitals_sql(f"regexp_extract(line, '{chunking.ROMAN}', 2)")} AS roman_title,
  regexp_extract(line, '{chunking.LETTER}', 1) AS letter, trim(regexp_extract(line, '{chunking.LETTER}', 2), {_WS}) AS letter_raw, regexp_extract(line, '{chunking.ARABIC}', 1) AS arabic, {_capitals_sql(f"regexp_extract(line, '{chunking.ARABIC}', 2)")} AS arabic_title
  FROM each WHERE length(line) BETWEEN 1 AND 100),
kinds AS (SELECT *, CASE WHEN word <> '' THEN 'keyword'
  WHEN roman <> '' AND length(roman_title) <= 80 AND len(regexp_extract_all(roman_title, '[A-Za-z]')) > 0 AND len(regexp_extract_all(roman_title, '[A-Z]')) >= 0.7 * len(regexp_extract_all(roman_title, '[A-Za-z]')) THEN 'roman'
  WHEN letter <> '' AND length(letter_raw) <= 70 AND NOT regexp_matches(line, '[0-9]{{4}}') AND NOT (contains(line, ',') AND (regexp_matches(lower(line), ' and |et al') OR regexp_matches(line, ',.*,'))) AND ({_TITLE_WORD.format('letter_raw')} OR {_WORDS_N.format('letter_raw')} <= 8) THEN 'letter'
  WHEN arabic <> '' AND regexp_matches(arabic_title, '^[A-Z]') AND try_cast(split_part(arabic, '.', 1) AS BIGINT) <= 10000 AND try_cast(split_part(arabic, '.', 1) AS BIGINT) NOT BETWEEN 1900 AND 2099 THEN 'arabic'
  WHEN length(line) BETWEEN 5 AND 60 AND {_WORDS_N.format('line')} BETWEEN 2 AND 8 AND NOT regexp_matches(line, '%|[0-9]+/[0-9]+') AND NOT regexp_matches(line, '(?i)(?:Fig|Table|Figure)\\s*[0-9]')
    AND ((line = upper(line) AND line <> lower(line)) OR (line[1] = upper(line[1]) AND line[1] <> lower(line[1]) AND NOT regexp_matches(line, '[.:;,)\\]]$'))) AND {_TITLE_WORD.format('line')} THEN 'weak' END AS kind FROM short),
cands AS (SELECT source, i, kind, row_number() OVER (PARTITION BY source ORDER BY i) AS n,
  CASE kind WHEN 'keyword' THEN word WHEN 'roman' THEN roman WHEN 'letter' THEN letter WHEN 'arabic' THEN arabic ELSE line[1:30] END AS mark,
  CASE kind WHEN 'keyword' THEN word WHEN 'roman' THEN roman || '. ' || roman_title WHEN 'letter' THEN letter || '. ' || {_capitals_sql('letter_raw')} WHEN 'arabic' THEN arabic || ' ' || arabic_title ELSE line END AS title,
  CASE kind WHEN 'keyword' THEN CASE WHEN lower(word) = 'abstract' THEN 0 ELSE 1 END WHEN 'letter' THEN 2 WHEN 'arabic' THEN len(string_split(arabic, '.')) ELSE 1 END AS level,
  CASE kind WHEN 'keyword' THEN CASE WHEN lower(word) = 'abstract' THEN 0 ELSE 1 END WHEN 'roman' THEN list_position(['I','II','III','IV','V','VI','VII','VIII','IX','X'], roman) WHEN 'letter' THEN ascii(letter) - 64 WHEN 'arabic' THEN try_cast(split_part(arabic, '.', 1) AS BIGINT) END AS number FROM kinds WHERE kind IS NOT NULL),
fold AS (SELECT source, 0::BIGINT AS n, 0::BIGINT AS i, false AS taken, []::BIGINT[] AS seen, 0 AS level, 0::BIGINT AS number, '' AS id, '' AS title, NULL::VARCHAR AS parent, NULL::VARCHAR AS parent_id FROM lines
  UNION ALL SELECT source, n, i, taken, CASE WHEN taken THEN list_append(seen, i) ELSE seen END, level, CASE WHEN kind = 'weak' THEN len(seen) + 1 ELSE number END, CASE WHEN level >= 2 AND parent IS NOT NULL THEN parent_id || '.' || mark ELSE mark END,
    CASE WHEN level >= 2 AND parent IS NOT NULL THEN parent || ' - ' || title ELSE title END, CASE WHEN taken AND level = 1 THEN title ELSE parent END, CASE WHEN taken AND level = 1 THEN mark ELSE parent_id END
  FROM (SELECT c.*, f.seen, f.parent, f.parent_id, c.kind <> 'weak' OR len(list_filter(list_slice(f.seen, -3, -1), lambda x: c.i - x < 5)) = 0 AS taken FROM fold f JOIN cands c ON c.source = f.source AND c.n = f.n + 1)),
heads AS (SELECT *, lead(i) OVER (PARTITION BY source ORDER BY i) AS next_i FROM fold WHERE taken),
found AS (SELECT h.source, h.id AS section_id, h.title, h.level, h.number, h.i AS start, trim(array_to_string(list_slice(lines, h.i + 2, coalesce(h.next_i, len(lines))), chr(10)), {_WS}) AS content FROM heads h JOIN lines USING (source)),
sections AS (SELECT * FROM found WHERE length(content) >= 100 OR lower(title) = 'abstract')"""


@query("section_detect", f"WITH RECURSIVE {_SECTIONS_SQL} SELECT source, section_id, title, level::BIGINT AS level, number::BIGINT AS number, start::BIGINT AS start, content FROM sections")
def section_detect(spark, sf_dir):
    found = chunking.sections(_papers(spark, sf_dir))
    return found.select("source", "section_id", "title", *[F.col(c).cast("long").alias(c) for c in ("level", "number", "start")], "content")


def _tokens_sql(text: str) -> str:
    cjk = f"length(regexp_replace({text}, '[^一-鿿]', '', 'g'))"
    return f"floor({cjk} / 1.5 + (length({text}) - {cjk}) / 4.0)::BIGINT"


_BLOCK_SQL = "'(?s)\\[TABLE_HTML:.*?\\[/TABLE_HTML\\]'"
_PARAGRAPHS_SQL = f"list_filter(list_transform(string_split_regex(coalesce(x, ''), '\\n\\s*\\n'), lambda y: {{'t': trim(y, {_WS}), 'tab': false}}), lambda y: length(y.t) > 20)"
_CHUNKS_SQL = f"""{_SECTIONS_SQL},
texts AS (SELECT source, start, section_id, title, level, number, content, true AS cut FROM sections WHERE lower(title) NOT IN ('reference', 'references', 'bibliography', 'appendix')
  UNION ALL SELECT source, NULL, NULL, NULL, NULL, NULL, full_text, false FROM papers WHERE source NOT IN (SELECT source FROM sections)),
split AS (SELECT *, string_split_regex(content, {_BLOCK_SQL}) AS parts, regexp_extract_all(content, {_BLOCK_SQL}) AS blocks FROM texts),
lists AS (SELECT source, start, cut, flatten(list_transform(parts, lambda x, i: {_PARAGRAPHS_SQL} || CASE WHEN i <= len(blocks) THEN [{{'t': blocks[i], 'tab': true}}] ELSE [] END)) AS ps FROM split),
pack AS (SELECT source, start, cut, ps, 0::BIGINT AS n, '' AS held, 0::BIGINT AS tokens, []::STRUCT(t VARCHAR, k BIGINT)[] AS made FROM lists
  UNION ALL SELECT source, start, cut, ps, n + 1, CASE WHEN tab AND cut THEN '' WHEN held = '' THEN p WHEN NOT over THEN held || nl || p WHEN cut THEN carried || nl || p ELSE p END,
    CASE WHEN tab AND cut THEN 0 WHEN held = '' THEN k WHEN NOT over THEN tokens + k WHEN cut THEN {_tokens_sql("(carried || nl || p)")} ELSE k END,
    made || CASE WHEN held <> '' AND (over OR tab AND cut) THEN [{{'t': held, 'k': CASE WHEN cut THEN {_tokens_sql("held")} ELSE tokens END}}] ELSE [] END || CASE WHEN tab AND cut THEN [{{'t': p, 'k': k}}] ELSE [] END
  FROM (SELECT *, array_to_string(CASE WHEN len(ws) <= 3 THEN ws ELSE list_slice(ws, -least(floor(0.3::DOUBLE * len(ws))::BIGINT, 128), -1) END, ' ') AS carried FROM (
    SELECT *, tokens + k > 512 AS over, list_filter(string_split_regex(held, '\\s+'), lambda w: w <> '') AS ws, chr(10) || chr(10) AS nl FROM (SELECT *, ps[n + 1].t AS p, ps[n + 1].tab AS tab, {_tokens_sql("ps[n + 1].t")} AS k FROM pack WHERE n < len(ps))))),
ended AS (SELECT source, start, made || CASE WHEN held <> '' THEN [{{'t': held, 'k': CASE WHEN cut THEN {_tokens_sql("held")} ELSE tokens END}}] ELSE [] END AS made FROM pack WHERE n = len(ps)),
chunks AS (SELECT source, start, generate_subscripts(made, 1) - 1 AS ordinal, unnest(made) AS m FROM ended)"""


@query("paper_chunks", f"""WITH RECURSIVE {_CHUNKS_SQL} SELECT c.source, c.start::BIGINT AS start, c.ordinal::BIGINT AS ordinal, m.t AS text, m.k AS tokens, s.title AS section_title, s.section_id, s.level::BIGINT AS section_level,
  CASE WHEN s.title IS NOT NULL AND contains(split_part(m.t, chr(10), 1), '[TABLE_HTML:') THEN 'table' WHEN lower(s.title) = 'abstract' THEN 'abstract' ELSE 'body' END AS chunk_type,
  s.title IS NOT NULL AND contains(split_part(m.t, chr(10), 1), '[TABLE_HTML:') AS is_table,
  CASE WHEN s.title IS NOT NULL AND contains(split_part(m.t, chr(10), 1), '[TABLE_HTML:') AND regexp_matches(split_part(m.t, chr(10), 1), '(?i)Table_[0-9]+') THEN 'Table_' || regexp_extract(split_part(m.t, chr(10), 1), '(?i)Table_([0-9]+)', 1) ELSE '' END AS table_id
  FROM chunks c LEFT JOIN sections s ON s.source = c.source AND s.start = c.start""")
def paper_chunks(spark, sf_dir):
    """From text to chunks with their metadata."""
    found = chunking.chunk_papers(_papers(spark, sf_dir))
    return found.select("source", F.col("start").cast("long").alias("start"), "ordinal", "text", "tokens", "section_title", "section_id", F.col("section_level").cast("long").alias("section_level"), "chunk_type", "is_table", "table_id")


# --- rewriting, memory -----------------------------------------------------------------------------


@query("strategy_dispatch", "SELECT item_id, CASE WHEN regexp_matches(text, '[一-鿿]') THEN 'chinese_academic' WHEN length(text) > 100 THEN 'multi' ELSE 'academic' END AS strategy FROM benchmark")
def strategy_dispatch(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", dialogue.strategy(F.col("text")).alias("strategy"))


_EXP_SQL = " || ".join(f"CASE WHEN {_any('text', routing.INTENTS[n])} THEN [{', '.join(repr(p) + ' || text' for p in prefixes)}] ELSE [] END" for n, prefixes in dialogue.EXPANSIONS.items())


@query("intent_expansion", f"SELECT conv_id, turn, generate_subscripts(e, 1) - 1 AS place, unnest(e) AS expanded FROM (SELECT conv_id, turn, list_slice({_EXP_SQL}, 1, 4) AS e FROM conversations)")
def intent_expansion(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(dialogue.expansions(F.col("text"))).alias("n", "expanded"))
    return rows.select("conv_id", "turn", F.col("n").cast("long").alias("place"), "expanded")


@query("ordered_distinct_rewrites", """WITH g AS (SELECT conv_id AS query_id, turn AS pos, trim(text) AS text FROM conversations),
ok AS (SELECT * FROM g WHERE pos = 0 OR len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) >= 3),
f AS (SELECT query_id, pos, text FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lower(text) ORDER BY pos) AS n FROM ok) WHERE n = 1)
SELECT query_id, place, text FROM (SELECT query_id, text, row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS place FROM f) WHERE place < 6""")
def ordered_distinct_rewrites(spark, sf_dir):
    """Whole turns stand in for rewrites."""
    return dialogue.distinct_rewrites(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("pos"), "text"))


@query("history_window", "SELECT conv_id, turn, coalesce(string_agg(role || ': ' || left(text, 300), chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), '') AS history FROM conversations")
def history_window(spark, sf_dir):
    return dialogue.history(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "history")


@query("last_messages", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 10")
def last_messages(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return table(spark, sf_dir, "conversations").withColumn("rn", F.row_number().over(w)).where("rn <= 10").select("conv_id", "turn", "role")


_MENTIONS = "SELECT o_custkey AS conv_id, o_orderkey AS turn, 'ResNet' || (o_orderkey % 4) || 'Net at ' || (o_orderkey % 90) || '.5% accuracy, see Table ' || (o_orderkey % 12) AS text FROM orders"


@query("entity_memory", f"""WITH m AS ({_MENTIONS}), e AS (
  SELECT conv_id, turn, 'method' AS kind, unnest(regexp_extract_all(text, '([A-Z][A-Za-z0-9/-]*(?:Net|Former|Model|GNN|CNN|RNN|GAN|VAE|SAM|DETR|YOLO|BERT|GPT|LoRA|Caps))', 1)) AS entity, 10 AS most FROM m UNION ALL
  SELECT conv_id, turn, 'metric', trim(unnest(regexp_extract_all(text, '(?i)([0-9]+\\.?[0-9]*\\s*%?\\s*(?:F1|sensitivity|specificity|accuracy|precision|recall|mIoU|AUC|NDCG|MRR))', 1))), 10 FROM m UNION ALL
  SELECT conv_id, turn, 'table', 'Table_' || unnest(regexp_extract_all(text, '(?i)Table[_\\s]([0-9]+)', 1)), 5 FROM m),
f AS (SELECT conv_id, kind, entity, most, min(turn) AS first_seen FROM e WHERE entity <> '' GROUP BY ALL)
SELECT conv_id, kind, entity, first_seen FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, kind ORDER BY first_seen DESC) AS rn FROM f) WHERE rn <= most""")
def entity_memory(spark, sf_dir):
    return dialogue.entities(spark.sql(_MENTIONS.replace("FROM orders", "FROM {o}"), o=table(spark, sf_dir, "orders")))


# --- evaluation ------------------------------------------------------------------------------------


def _ndcg_sql(k: int) -> str:
    return f"""round(sum(CASE WHEN rank <= {k} THEN rel ELSE 0 END) / max(n_rel)::DOUBLE, 4) AS recall_raw_{k}, round(count(DISTINCT CASE WHEN rank <= {k} AND rel = 1 THEN key END) / max(n_rel)::DOUBLE, 4) AS recall_{k},
  round(coalesce(max(CASE WHEN rank <= {k} AND rel = 1 THEN 1.0::DOUBLE / rank END), 0), 4) AS mrr_{k},
  round(sum(CASE WHEN rank <= {k} THEN rel / log2(rank + 1) ELSE 0 END) / max((SELECT sum(1 / log2(i + 1)) FROM range(1, least(n_rel, {k}) + 1) t(i))), 4) AS ndcg_{k}"""


@query("recall_mrr_ndcg", f"""WITH {_VECTOR}, r AS (SELECT query_id, chunk_id AS key, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM vec),
rel AS (SELECT q.vec_id AS query_id, c.vec_id AS key FROM embeddings q JOIN embeddings c ON q.label = c.label WHERE q.vec_id % 100 = 0), tot AS (SELECT query_id, count(*) AS n_rel FROM rel GROUP BY ALL),
j AS (SELECT r.query_id, r.key, r.rank, (rel.key IS NOT NULL)::INT AS rel, n_rel FROM r LEFT JOIN rel USING (query_id, key) JOIN tot USING (query_id) WHERE rank <= 10)
SELECT query_id, {_ndcg_sql(5)}, {_ndcg_sql(10)} FROM j GROUP BY query_id""")
def recall_mrr_ndcg(spark, sf_dir):
    found = search.vector_search(_corpus(spark, sf_dir), _query_vectors(spark, sf_dir), 10).select("query_id", F.col("chunk_id").alias("key"), "rank")
    e = table(spark, sf_dir, "embeddings")
    qrels = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label").join(e.select(F.col("vec_id").alias("key"), "label"), "label")
    return quality.metrics(found, qrels.select("query_id", "key"))


@query("trace_summary_p95", "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean_latency, round(quantile_cont(value, 0.95), 4) AS p95_latency FROM events GROUP BY ALL")
def trace_summary_p95(spark, sf_dir):
    return quality.trace_summary(table(spark, sf_dir, "events"), "value", ["event_type"])


@query("rank_pool15", f"""WITH {_VECTOR}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, chunk_id) AS rn FROM vec), c AS (SELECT * FROM r WHERE rn <= 30)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rn <= 15 THEN 16 - rn ELSE 15 + rn END, rn) AS final_rank FROM c""")
def rank_pool15(spark, sf_dir):
    """A ranker that turns the pool round."""
    found = search.vector_search(_corpus(spark, sf_dir), _query_vectors(spark, sf_dir), 30, digits=4)
    ranked = found.select("query_id", "chunk_id", F.round("score", 4).alias("score"), F.col("rank").alias("rn"))
    order = ranked.where("rn <= 15").select("query_id", "chunk_id", (16 - F.col("rn")).alias("place"))
    return quality.rerank_pool(ranked.select("query_id", "chunk_id", "score"), order).select("query_id", "chunk_id", "final_rank")


# Values have six decimals at most; with 1e-9 both engines round halves up.
@query("pointwise_blend", "SELECT doc_id, round(0.7 * coalesce(quality::DOUBLE, 0.5) + 0.3 * coalesce(n_chars / 100000.0, 0) + 1e-9, 4) AS blended FROM documents LEFT JOIN labels USING (doc_id)")
def pointwise_blend(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select("doc_id", quality.blend(F.col("quality").cast("double"), F.col("n_chars") / 100000.0).alias("blended"))


@query("listwise_rerank_stub")
def listwise_rerank_stub(spark, sf_dir):
    chunks, questions = _chunks(spark, sf_dir), _questions(spark, sf_dir)
    found = search.bm25_search(search.bm25_index(chunks), questions, 30)
    full = found.join(chunks.select("chunk_id", "text"), "chunk_id").join(questions.withColumnRenamed("text", "question"), "query_id")
    return quality.listwise_rerank(full.select("query_id", "question", "chunk_id", "score", "text"), quality.overlap_ranker)


@query("context_assembly", f"""WITH {_BM25}, r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM bm25)
SELECT query_id, string_agg('[' || rank || '] ' || d.source || ': ' || left(d.text, 1500), chr(10) || chr(10) ORDER BY rank) AS context FROM r JOIN documents d ON d.doc_id = r.chunk_id WHERE rank <= 5 GROUP BY query_id""")
def context_assembly(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    top = search.bm25_search(search.bm25_index(chunks), _questions(spark, sf_dir), 5).join(chunks.select("chunk_id", "source", "text"), "chunk_id")
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "source", F.lit(": "), F.substring("text", 1, 1500))
    return top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines")).select("query_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n").alias("context"))


# The whole path from question to sources. Documents stand in for chunks with sections, titles and tables of their own, benchmark items for
# questions; each item's vector is the one with its id.
_RAG_CHUNKS = """SELECT doc_id AS chunk_id, doc_id AS idx, text, source || '_' || lang || '.pdf' AS source, 'About ' || source AS title, '2507.' || (10000 + length(source) * 7) AS archive_id,
  (1 + doc_id % 4) || '.' || (doc_id % 7) AS section_id, CASE doc_id % 5 WHEN 0 THEN 'Method' WHEN 1 THEN 'Dataset setup' WHEN 2 THEN 'Experiments and results' WHEN 3 THEN 'Training details' ELSE '' END AS section_title,
  CASE WHEN doc_id % 6 = 0 THEN 'Table_' || (doc_id % 9) ELSE '' END AS table_id, doc_id % 6 = 0 AS is_table FROM documents"""
_RAG_ASKED = """SELECT item_id AS query_id, CASE item_id % 8 WHEN 0 THEN 'Table ' || (item_id % 9) || ' of it, ' WHEN 1 THEN 'Section ' || (1 + item_id % 4) || '.' || (item_id % 7) || ' on ' WHEN 2 THEN 'the Src' || (item_id % 5) || ' paper on '
  WHEN 3 THEN 'Chapter ' || (1 + item_id % 4) || ' in the Src' || (item_id % 5) || ' paper, ' WHEN 4 THEN 'which datasets and results for ' WHEN 5 THEN 'parameters of ' WHEN 6 THEN 'src' || (item_id % 5) || ' en and ' ELSE '' END || text AS text FROM benchmark"""


def _rag(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chunks = spark.sql(_RAG_CHUNKS.replace("FROM documents", "FROM {docs}"), docs=table(spark, sf_dir, "documents"))
    return chunks, spark.sql(_RAG_ASKED.replace("FROM benchmark", "FROM {items}"), items=table(spark, sf_dir, "benchmark"))


def _retrieved(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    chunks, asked = _rag(spark, sf_dir)
    # The corpus is tokenised once: index and scores read the written tokens.
    index = search.bm25_index(chunks).stored()
    vectors = _corpus(spark, sf_dir).join(chunks.select("chunk_id"), "chunk_id", "left_semi")  # a vector has its chunk
    return retrieval.retrieve(index, vectors, asked, _item_vectors(spark, sf_dir), **how)


_BOOST_OF = "CASE WHEN title = '' THEN 1.0 " + " ".join(f"WHEN intent = '{n}' AND {_any('title', w)} THEN {1.3 if n == 'architecture' else 1.8}" for n, w in routing.SECTION_WORDS.items())
_BOOST_OF += " WHEN intent = 'general' AND len(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '' AND contains(lower(title), w))) > 0 THEN 1.3 ELSE 1.0 END::DOUBLE"
_MATCH_OF = "trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '\\bsam\\s*[-_]?\\s*2\\b', 'sam_2', 'g'), '[^\\w\\s一-鿿]', ' ', 'g'), '\\s+', ' ', 'g'))"
_RAG_SQL = f"""c AS ({_RAG_CHUNKS}), q0 AS ({_RAG_ASKED}),
refs AS (SELECT query_id, text, {_intent_sql('text')} AS intent,
  coalesce(nullif(regexp_extract(text, '\\b([0-9]{{4}}\\.[0-9]{{4,5}}v?[0-9]*)\\b', 1), ''), CASE WHEN length(regexp_extract(text, '(?:the\\s+)?([A-Z][A-Za-z0-9-]+)\\s+(?:paper|论文|model)', 1)) >= 3 THEN regexp_extract(text, '(?:the\\s+)?([A-Z][A-Za-z0-9-]+)\\s+(?:paper|论文|model)', 1) END) AS paper_ref,
  coalesce(nullif(regexp_extract(text, '(?:Section|section|CHAPTER|Chapter)\\s+([0-9]+(?:\\.[0-9]+)*)', 1), ''), nullif(regexp_extract(text, '^([0-9]+(?:\\.[0-9]+)*)\\s', 1), ''), {_NAMES_SQL}) AS section_ref,
  CASE WHEN regexp_extract(text, '(?:(?:[Tt]able|[Tt]ab)\\b|表)\\s*[-_.]?\\s*([0-9]+)', 1) <> '' THEN 'Table_' || regexp_extract(text, '(?:(?:[Tt]able|[Tt]ab)\\b|表)\\s*[-_.]?\\s*([0-9]+)', 1) END AS table_ref FROM q0),
files AS (SELECT source, min(idx) AS idx, min_by(title, idx) AS title, min_by(archive_id, idx) AS archive_id FROM c GROUP BY source),
ft AS (SELECT source, {_MATCH_OF.format("replace(regexp_replace(source, '\\.[A-Za-z0-9]+$', ''), '_', ' ')")} AS norm, list_filter(string_split(lower(regexp_replace(source, '\\.[A-Za-z0-9]+$', '')), '_'), lambda x: x <> '') AS p FROM files),
fk AS (SELECT source, norm, list_distinct(list_filter(p, lambda x: length(x) >= 2 OR regexp_full_match(x, '[0-9]+')) || list_transform(list_filter(range(1, len(p)), lambda i: length(p[i]) >= 2), lambda i: p[i] || '_' || p[i + 1])) AS tokens FROM ft),
qp AS (SELECT query_id, list_filter(string_split_regex(replace({_MATCH_OF.format('text')}, '_', ' '), '\\s+'), lambda x: x <> '') AS p FROM q0),
qn AS (SELECT query_id, p, list_filter(range(1, len(p)), lambda i: len(list_filter([p[i]], lambda x: {_GOOD})) > 0) AS places FROM qp),
qt AS (SELECT query_id, unnest(list_distinct(list_filter(p, lambda x: {_GOOD}) || list_transform(places, lambda i: p[i] || '_' || p[i + 1]) || list_transform(list_filter(places, lambda i: regexp_full_match(p[i + 1], '[0-9]+')), lambda i: p[i] || p[i + 1]))) AS token FROM qn),
own AS (SELECT source, unnest(tokens) AS token FROM fk), fdf AS (SELECT token, count(*) AS df FROM own GROUP BY token),
words AS (SELECT DISTINCT token, 1 + ln(((SELECT count(*) FROM fk) + 1) / (coalesce(df, 0) + 1)::DOUBLE) AS idf FROM qt LEFT JOIN fdf USING (token)),
fhit AS (SELECT token, source, max(part) AS part FROM (SELECT token, source, 2.0 * idf AS part FROM words JOIN own USING (token) UNION ALL
  SELECT token, source, 1.2 * idf FROM words, fk WHERE length(token) >= 3 AND (contains(norm, token) OR contains(replace(norm, ' ', ''), token))) GROUP BY ALL),
fscore AS (SELECT query_id, source, round(sum(part) * CASE WHEN count(*) >= 2 THEN 1.15 ELSE 1 END, 6) AS score FROM qt JOIN fhit USING (token) GROUP BY ALL),
fr AS (SELECT *, row_number() OVER w AS rn, coalesce(lead(score) OVER w, 0) AS second FROM fscore WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, source)),
routed AS (SELECT query_id, source AS routed FROM fr WHERE rn = 1 AND score >= 2.8 AND NOT (second > 0 AND score - second < 1.2 AND second >= 0.8 * 2.8)),
named AS (SELECT paper_ref, coalesce(min_by(source, idx) FILTER (contains(lower(source), lower(paper_ref)) OR contains(lower(title), lower(paper_ref))), min_by(source, idx) FILTER (contains(archive_id, lower(paper_ref)))) AS named FROM (SELECT DISTINCT paper_ref FROM refs WHERE paper_ref IS NOT NULL), files GROUP BY paper_ref),
asked AS (SELECT r.*, coalesce(routed, named) AS want, paper_ref IS NOT NULL OR section_ref IS NOT NULL AS narrowed FROM refs r LEFT JOIN routed USING (query_id) LEFT JOIN named USING (paper_ref)),
tiered AS (SELECT query_id, chunk_id, CASE WHEN table_ref IS NOT NULL THEN CASE WHEN is_table AND table_id = table_ref THEN CASE WHEN want IS NULL OR want = source THEN 0 ELSE 1 END END
  WHEN want IS NOT NULL THEN CASE WHEN want = source THEN CASE WHEN starts_with(section_id, section_ref) THEN 2 ELSE 3 END END WHEN section_ref IS NOT NULL AND starts_with(section_id, section_ref) THEN 4 END AS tier FROM asked, c),
pairs AS (SELECT query_id, chunk_id, tier FROM (SELECT *, min(tier) OVER (PARTITION BY query_id) AS best FROM tiered WHERE tier IS NOT NULL) WHERE tier = best),
allowed AS (FROM pairs UNION ALL SELECT query_id, chunk_id, 5 FROM asked, c WHERE table_ref IS NULL AND want IS NULL AND query_id NOT IN (SELECT query_id FROM pairs)),
ex AS (SELECT query_id, text, narrowed, list_slice({_EXP_SQL}, 1, 4) AS e FROM asked),
vall AS (SELECT query_id, 0 AS pos, trim(text) AS text FROM asked UNION ALL SELECT query_id, pos, trim(text) FROM (SELECT query_id, generate_subscripts(e, 1) AS pos, unnest(e) AS text FROM ex WHERE NOT narrowed) WHERE len(list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> '')) >= 3),
v AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS pos, text FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lower(text) ORDER BY pos) AS n FROM vall) WHERE n = 1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos) <= 5),
d AS (SELECT chunk_id, {_TOKENS} AS tokens FROM c),
t AS (SELECT chunk_id, len(tokens) AS dl, unnest(tokens) AS term FROM d),
stats AS (SELECT count(*) AS n_docs, avg(len(tokens)) AS avgdl FROM d),
tf AS (SELECT chunk_id, dl, term, count(*) AS tf FROM t GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM df, stats),
idf AS (SELECT term, CASE WHEN raw < 0 THEN (SELECT avg(raw) * 0.25 FROM raw) ELSE raw END AS idf FROM raw),
qterm AS (SELECT query_id, pos, term, count(*) AS qtf FROM (SELECT query_id, pos, unnest({_TOKENS}) AS term FROM v) GROUP BY ALL),
lex AS (SELECT query_id, pos, chunk_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qterm JOIN tf USING (term) JOIN idf USING (term), stats GROUP BY ALL),
near AS (SELECT item_id AS query_id, e.vec_id AS chunk_id, list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM benchmark JOIN embeddings q ON q.vec_id = item_id, embeddings e),
chan AS (SELECT query_id, pos, chunk_id, score, 'b' AS ch FROM lex JOIN allowed USING (query_id, chunk_id) WHERE round(score, 6) <> 0 UNION ALL SELECT query_id, pos, chunk_id, score, 'v' FROM near JOIN allowed USING (query_id, chunk_id) JOIN v USING (query_id)),
top AS (SELECT * FROM chan QUALIFY row_number() OVER (PARTITION BY ch, query_id, pos ORDER BY round(score, 6) DESC, chunk_id) <= 30),
best AS (SELECT query_id, chunk_id, ch, max(round(score * ({_BOOST_OF}), 6)) AS score FROM (SELECT top.*, coalesce(section_title, '') AS title, v.text, intent FROM top JOIN c USING (chunk_id) JOIN v USING (query_id, pos) JOIN asked USING (query_id)) GROUP BY ALL),
merged AS (SELECT query_id, chunk_id, greatest(coalesce(max(score) FILTER (ch = 'v'), 0), 0) AS v, greatest(coalesce(max(score) FILTER (ch = 'b'), 0), 0) AS b FROM best GROUP BY ALL),
fused AS (SELECT query_id, chunk_id, round(0.6 * CASE WHEN max(v) OVER w = min(v) OVER w THEN 1.0 ELSE (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) END + 0.4 * CASE WHEN max(b) OVER w = min(b) OVER w THEN 1.0 ELSE (b - min(b) OVER w) / (max(b) OVER w - min(b) OVER w) END, 4) AS score FROM merged WINDOW w AS (PARTITION BY query_id)),
listed AS (SELECT source, section_id FROM c WHERE section_id <> '' GROUP BY ALL HAVING count(*) >= 3 OR {_any("coalesce(min_by(section_title, idx), '')", routing.LIST_WORDS)}),
sib AS (SELECT DISTINCT f.query_id, s.chunk_id, 0.0 AS score FROM fused f JOIN asked a USING (query_id) JOIN c h USING (chunk_id) JOIN listed l ON l.source = h.source AND l.section_id = h.section_id JOIN c s ON s.source = h.source AND s.section_id = h.section_id WHERE a.intent IN ('dataset', 'experiment', 'config') AND a.table_ref IS NULL),
told AS (SELECT query_id, chunk_id, max(score) AS score, any_value(text) AS text, any_value(idx) AS idx FROM (FROM fused UNION ALL FROM sib) JOIN c USING (chunk_id) WHERE trim(text) <> '' GROUP BY query_id, chunk_id),
once AS (SELECT * FROM told QUALIFY row_number() OVER (PARTITION BY query_id, left(text, 500) ORDER BY score DESC, idx) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM once)"""


@query("rag_retrieval", f"""WITH {_RAG_SQL} SELECT query_id, chunk_id, score::DOUBLE AS score, rank, coalesce(tier, 5)::BIGINT AS tier FROM ranked JOIN asked USING (query_id) LEFT JOIN (SELECT DISTINCT query_id, tier FROM pairs) USING (query_id) WHERE rank <= CASE WHEN table_ref IS NULL THEN 10 ELSE 1 END""")
def rag_retrieval(spark, sf_dir):
    """References, routing, tiers, rewrites, boost before the maximum, fusion, bundling: ten sources a question."""
    return _retrieved(spark, sf_dir)


@query("rag_reranked")
def rag_reranked(spark, sf_dir):
    """The same with the offline listwise ranker over each pool."""
    return _retrieved(spark, sf_dir, ranker=quality.overlap_ranker)


@query("vector_fallback", f"""WITH {_VECTOR}, ok AS (SELECT * FROM vec WHERE chunk_id IN (SELECT doc_id FROM documents WHERE trim(text) <> ''))
SELECT query_id, chunk_id, round(score, 4) AS score, round(score, 4) AS vector_score, 0.0::DOUBLE AS bm25_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM ok) WHERE rank <= 10""")
def vector_fallback(spark, sf_dir):
    return retrieval.vector_fallback(_corpus(spark, sf_dir), _chunks(spark, sf_dir), _query_vectors(spark, sf_dir))



# --- tables, figures, positions ---------------------------------------------------------------------


@query("positional_join", """WITH e AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS idx FROM embeddings), d AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents)
SELECT idx, doc_id, source, vec_id, label FROM d JOIN e USING (idx)""")
def positional_join(spark, sf_dir):
    """The n-th chunk belongs to the n-th vector."""
    d = relational.numbered(table(spark, sf_dir, "documents").select("doc_id", "source"), ["doc_id"])
    e = relational.numbered(table(spark, sf_dir, "embeddings").select("vec_id", "label"), ["vec_id"])
    return d.join(e, "idx").select("idx", "doc_id", "source", "vec_id", "label")


@query("source_lists", "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS nth FROM documents")
def source_lists(spark, sf_dir):
    """Rows by source: each with its place in its source, so that a list of any length stays rows."""
    placed = relational.numbered(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source", "doc_id"])
    first = placed.groupBy("source").agg(F.min("idx").alias("first"), F.count("*").alias("n"))
    return lookup(placed, first, ["source"], "n", "doc_id").select("source", "doc_id", (F.col("idx") - F.col("first")).alias("nth"))


_GRID = "list(CASE WHEN l_linenumber = 1 THEN ['Method', l_returnflag, ''] ELSE [l_returnflag, l_linenumber::VARCHAR, ''] END ORDER BY l_linenumber, l_returnflag)"


@query("table_grid_score", f"""WITH g AS (SELECT l_orderkey, {_GRID} AS grid FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey,
  (len(grid) * 3 * 2 + len(list_filter(flatten(grid), lambda c: c <> '')) + CASE WHEN list_contains(grid[1], 'Method') THEN 80 ELSE 0 END + 3 * len(list_filter(flatten(grid), lambda c: regexp_matches(c, '^[0-9]+$'))))::BIGINT AS score FROM g""")
def table_grid_score(spark, sf_dir):
    return _grids(spark, sf_dir).select("l_orderkey", tables.grid_score(F.col("grid")).alias("score"))


@query("table_html", f"""WITH g AS (SELECT l_orderkey, {_GRID} AS grid FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, '<table><tr>' || array_to_string(list_transform(grid[1][1:2], lambda c: '<th>' || c || '</th>'), '') || '</tr>' ||
  array_to_string(list_transform(grid[2:], lambda r: '<tr><td>' || r[1] || '</td><td>' || r[2] || '</td></tr>'), '') || '</table>' AS html FROM g""")
def table_html(spark, sf_dir):
    return _grids(spark, sf_dir).select("l_orderkey", tables.grid_html(F.col("grid")).alias("html"))


def _grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.when(F.col("l_linenumber") == 1, F.array(F.lit("Method"), F.col("l_returnflag"), F.lit(""))).otherwise(F.array(F.col("l_returnflag"), F.col("l_linenumber").cast("string"), F.lit("")))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", row.alias("r")))).alias("rows"))
    return lines.select("l_orderkey", F.transform("rows", lambda x: x["r"]).alias("grid"))


_BOXES = "SELECT l_orderkey AS page, l_linenumber::BIGINT AS id, l_extendedprice AS score, l_quantity AS x0, l_quantity / 2 AS y0, l_quantity + 30.0 AS x1, l_quantity / 2 + 40.0 AS y1 FROM lineitem"


@query("box_overlap", f"""WITH b AS ({_BOXES}), p AS (SELECT a.page, a.id AS a, b.id AS b, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i FROM b a JOIN b ON a.page = b.page AND a.id < b.id)
SELECT page, a, b, round(i / (2400.0 - i), 4) AS iou FROM p""")
def box_overlap(spark, sf_dir):
    """Pairs of a page's boxes; a page has at most seven."""
    boxes = _boxes(spark, sf_dir)
    other = boxes.select("page", F.col("id").alias("b"), F.col("box").alias("box_b"))
    pairs = boxes.join(other, "page").where("id < b")
    return pairs.select("page", F.col("id").alias("a"), "b", F.round(tables.overlap(F.col("box"), F.col("box_b")), 4).alias("iou"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    box = F.struct(q.alias("x0"), (q / 2).alias("y0"), (q + 30.0).alias("x1"), (q / 2 + 40.0).alias("y1"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("long").alias("id"), F.col("l_extendedprice").alias("score"), box.alias("box"))


@query("best_boxes")
def best_boxes(spark, sf_dir):
    return tables.best_boxes(_boxes(spark, sf_dir), ["page"])


@query("figure_crop", f"""WITH b AS ({_BOXES}) SELECT page, id, greatest(0, x0 - 20)::DOUBLE AS x0, (CASE WHEN id % 2 = 0 THEN y1 ELSE greatest(0, y0 - 60) END)::DOUBLE AS y0, least(90, x1 + 20)::DOUBLE AS x1, (CASE WHEN id % 2 = 0 THEN least(100, y0 + 60) ELSE least(100, y1 + 20) END)::DOUBLE AS y1 FROM b""")
def figure_crop(spark, sf_dir):
    kind = F.when(F.col("id") % 2 == 0, "table").otherwise("figure")
    return _boxes(spark, sf_dir).select("page", "id", tables.crop(kind, F.col("box"), F.lit(100.0), F.lit(90.0)).alias("c")).select("page", "id", "c.x0", "c.y0", "c.x1", "c.y1")


@query("reference_split", """SELECT l_orderkey, generate_subscripts(r, 1) - 1 AS ordinal, unnest(r) AS item FROM (SELECT l_orderkey, list_filter(list_transform(string_split_regex(t, '\\[[0-9]+\\]'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: length(x) > 20) AS r
  FROM (SELECT l_orderkey, string_agg('[' || l_linenumber || '] Author ' || l_partkey || ', a title of ' || l_shipdate::DATE::VARCHAR || '  ' || l_returnflag, ' ' ORDER BY l_linenumber, '[' || l_linenumber || '] Author ' || l_partkey || ', a title of ' || l_shipdate::DATE::VARCHAR || '  ' || l_returnflag) AS t FROM lineitem GROUP BY l_orderkey))""")
def reference_split(spark, sf_dir):
    item = F.concat(F.lit("["), F.col("l_linenumber").cast("string"), F.lit("] Author "), F.col("l_partkey").cast("string"), F.lit(", a title of "), F.col("l_shipdate").cast("date").cast("string"), F.lit("  "), F.col("l_returnflag"))
    texts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", item.alias("t")))).alias("rows"))
    text = F.concat(F.lit("body\nReferences\n"), F.array_join(F.transform("rows", lambda x: x["t"]), " "))
    items = texts.select("l_orderkey", F.posexplode(tables.reference_items(text)).alias("n", "item"))
    return items.select("l_orderkey", F.col("n").cast("long").alias("ordinal"), "item")


@query("table_block", f"""WITH g AS (SELECT l_orderkey, {_GRID} AS grid FROM lineitem GROUP BY l_orderkey), h AS (SELECT l_orderkey, CASE WHEN len(grid) < 2 OR length(regexp_replace(grid[2][1] || grid[2][2], '[^0-9]', '', 'g')) > 9 THEN grid
  ELSE [[CASE WHEN grid[1][1] = grid[2][1] THEN grid[1][1] ELSE grid[1][1] || '/' || grid[2][1] END, CASE WHEN grid[1][2] = grid[2][2] THEN grid[1][2] ELSE grid[1][2] || '/' || grid[2][2] END, '']] || grid[3:] END AS grid FROM g)
SELECT l_orderkey, '[TABLE_HTML: Table_' || (l_orderkey % 9) || ' | Page 3]' || chr(10) || '<table><tr>' || array_to_string(list_transform(grid[1][1:2], lambda c: '<th>' || c || '</th>'), '') || '</tr>' ||
  array_to_string(list_transform(grid[2:], lambda r: '<tr><td>' || r[1] || '</td><td>' || r[2] || '</td></tr>'), '') || '</table>' || chr(10) || '[/TABLE_HTML]' AS block FROM h""")
def table_block(spark, sf_dir):
    """Grids as marked blocks, stacked header rows joined."""
    block = tables.table_block(F.col("grid"), F.concat(F.lit("Table_"), (F.col("l_orderkey") % 9).cast("string")), F.lit(3))
    return _grids(spark, sf_dir).select("l_orderkey", block.alias("block"))


@query("table_embed_text")
def table_embed_text(spark, sf_dir):
    """What the embedder reads of a table."""
    html = tables.grid_html(F.col("grid"), F.concat(F.lit("Table of order "), F.col("l_orderkey").cast("string")))
    return _grids(spark, sf_dir).select("l_orderkey", tables.table_text(html).alias("text"), tables.grid_markdown(F.col("grid")).alias("markdown"))


@query("stamp_residue", """SELECT p_partkey, len(regexp_extract_all(t, '(?i)ar\\s*Xiv:')) AS n_stamps, t AS around FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'x ar Xiv:' || p_size WHEN 1 THEN 'arXiv: 1 arxiv:' || p_size ELSE p_name END AS t FROM part) WHERE regexp_matches(t, '(?i)ar\\s*Xiv:')""")
def stamp_residue(spark, sf_dir):
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    text = F.when(k == 0, F.concat(F.lit("x ar Xiv:"), size)).when(k == 1, F.concat(F.lit("arXiv: 1 arxiv:"), size)).otherwise(F.col("p_name"))
    return relational.residue(table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))).select("p_partkey", "n_stamps", "around")


@query("memory_prompt", f"""WITH m AS ({_MENTIONS}), e AS (
  SELECT conv_id, turn, 'method' AS kind, unnest(regexp_extract_all(text, '([A-Z][A-Za-z0-9/-]*(?:Net|Former|Model|GNN|CNN|RNN|GAN|VAE|SAM|DETR|YOLO|BERT|GPT|LoRA|Caps))', 1)) AS entity, 10 AS most FROM m UNION ALL
  SELECT conv_id, turn, 'metric', trim(unnest(regexp_extract_all(text, '(?i)([0-9]+\\.?[0-9]*\\s*%?\\s*(?:F1|sensitivity|specificity|accuracy|precision|recall|mIoU|AUC|NDCG|MRR))', 1))), 10 FROM m UNION ALL
  SELECT conv_id, turn, 'table', 'Table_' || unnest(regexp_extract_all(text, '(?i)Table[_\\s]([0-9]+)', 1)), 5 FROM m),
f AS (SELECT conv_id, kind, entity, most, min(turn) AS first_seen FROM e WHERE entity <> '' GROUP BY ALL),
k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY conv_id, kind ORDER BY first_seen DESC) <= most),
l AS (SELECT conv_id, list(entity ORDER BY first_seen, entity) FILTER (kind = 'method') AS me, list(entity ORDER BY first_seen, entity) FILTER (kind = 'metric') AS mt, list(entity ORDER BY first_seen, entity) FILTER (kind = 'table') AS ta FROM k GROUP BY conv_id)
SELECT conv_id, concat_ws(' | ', '讨论过的方法: ' || array_to_string(me[greatest(len(me) - 4, 1):], '、'), '提及的指标: ' || array_to_string(mt[greatest(len(mt) - 4, 1):], '、'), '引用过的表格: ' || array_to_string(ta[greatest(len(ta) - 2, 1):], '、')) AS prompt,
  replace('这张表 again', '这张表', ta[len(ta)]) AS resolved FROM l""")
def memory_prompt(spark, sf_dir):
    """What each conversation's memory tells a model, and a question that points back."""
    told = dialogue.entities(spark.sql(_MENTIONS.replace("FROM orders", "FROM {o}"), o=table(spark, sf_dir, "orders")))
    return dialogue.memory(told).select("conv_id", dialogue.context_prompt().alias("prompt"), dialogue.resolved(F.lit("这张表 again")).alias("resolved"))


@query("file_stems", "SELECT p_partkey, left(regexp_replace(p_name || ' ' || p_type, '\\s+', '_', 'g'), 120) AS stem, 'alpha<=' || p_name AS plain FROM part")
def file_stems(spark, sf_dir):
    name = F.concat("p_name", F.lit(" "), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", tx.file_stem(name).alias("stem"), tx.plain_symbols(F.concat(F.lit("α≤"), "p_name")).alias("plain"))


@query("rewrites")
def rewrites(spark, sf_dir):
    """Each item's rewrites by its strategy, from the offline generator."""
    return rewriting.rewrites(_questions(spark, sf_dir))


@query("contextual_rewrites")
def contextual_rewrites(spark, sf_dir):
    return rewriting.contextual(table(spark, sf_dir, "conversations"))


@query("parsed_pages", "SELECT page_id || '.html' AS source, 'html' AS engine FROM pages")
def parsed_pages(spark, sf_dir):
    """Web pages through the parser plugs; the PDF engine is tried first and finds nothing."""
    files = table(spark, sf_dir, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    return parsing.parsed(files, ["pdf", "html"]).select("source", "engine")


# --- extensions: batch twins of the streams -----------------------------------------------------------


@query("window_metrics", "SELECT time_bucket(INTERVAL 1 HOUR, ts)::VARCHAR AS hour, event_type, count(*) AS n, round(avg(value), 4) AS mean_value FROM events GROUP BY ALL")
def window_metrics(spark, sf_dir):
    from quillspark.streaming.traces import rolling_metrics

    rows = rolling_metrics(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), watermark=None)
    return rows.select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", "mean_value")


@query("session_queries", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, session""")
def session_queries(spark, sf_dir):
    from quillspark.streaming.traces import sessions

    rows = sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), watermark=None)
    return rows.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
