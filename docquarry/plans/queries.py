"""Queries over the standard tables, each with its SQL where SQL expresses it.

Every query runs over whole tables; limits are there only where a top-k, a page or a budget is the feature.
Each states a fixed projection of the tables onto the operator's input, the same in Spark and in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry import ports
from docquarry.functions import ids, text as T
from docquarry.operators import answers, concepts, evidence, metrics, records, search, segment, state
from docquarry.plans import flows
from docquarry.session import new_path, table
from docquarry.sources.store import Store
from docquarry.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


# ---- search

_DIST = "1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"])


@query(f"SELECT e.vec_id, e.label, round({_DIST}, 6) AS distance FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY {_DIST}, e.vec_id LIMIT 20")
def vector_topk(spark, sf_dir):
    top = search.vector_topk(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 20)
    return top.select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query(f"SELECT e.vec_id, round({_DIST}, 6) AS distance FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.label = 3 ORDER BY {_DIST}, e.vec_id LIMIT 10")
def filtered_topk(spark, sf_dir):
    top = search.vector_topk(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 10, filters={"label": 3})
    return top.select("vec_id", F.round("distance", 6).alias("distance"))


@query("SELECT e.vec_id, round(list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) ** 2, 6) AS distance FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), e.vec_id LIMIT 15")
def l2_topk(spark, sf_dir):
    top = search.vector_topk(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 15, metric="l2sq")
    return top.select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"""WITH d AS (SELECT q.vec_id AS query_id, e.vec_id, {_DIST} AS d FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM d)
SELECT query_id, vec_id, round(d, 6) AS distance, rank FROM r WHERE rank <= 5""")
def batch_topk(spark, sf_dir):
    index = table(spark, sf_dir, "embeddings")
    queries = index.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return search.batch_topk(index, queries, 5, exclude_self=True).select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


LEXICAL = "Licensed under the Apache src3"
_TERMS = ("licensed", "under", "the", "apache", "src3")
_LEX_SCORE = "(" + " + ".join(f"contains(lower(concat_ws(' ', text, lang, source)), '{t}')::INT" for t in _TERMS) + f") / {len(_TERMS)}.0"


def _lexical(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "chunk_ref")
    return search.lexical_search(docs, LEXICAL, search.metadata_text(F.col("text"), F.col("lang"), F.col("source")), k)


@query(f"SELECT doc_id AS chunk_ref, round({_LEX_SCORE}, 6) AS keyword_score, row_number() OVER (ORDER BY {_LEX_SCORE} DESC, doc_id) AS rank FROM documents WHERE {_LEX_SCORE} > 0 ORDER BY {_LEX_SCORE} DESC, doc_id LIMIT 40")
def lexical_search(spark, sf_dir):
    return _lexical(spark, sf_dir, 40).select("chunk_ref", F.round("keyword_score", 6).alias("keyword_score"), "rank")


@query(f"""WITH s AS (SELECT e.vec_id AS chunk_ref, {_DIST} AS d, row_number() OVER (ORDER BY {_DIST}, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY 2, 1 LIMIT 40),
l AS (SELECT doc_id AS chunk_ref, {_LEX_SCORE} AS k, row_number() OVER (ORDER BY {_LEX_SCORE} DESC, doc_id) AS rank FROM documents WHERE {_LEX_SCORE} > 0 ORDER BY 2 DESC, 1 LIMIT 40),
u AS (SELECT chunk_ref, rank, 1 - d AS s, NULL::DOUBLE AS k FROM s UNION ALL SELECT chunk_ref, rank, NULL, k FROM l),
f AS (SELECT chunk_ref, sum(1.0 / (60 + rank)) AS fused, max(s) AS s, max(k) AS k FROM u GROUP BY 1)
SELECT chunk_ref, round(fused, 6) AS fused_score, round(s, 6) AS semantic_score, round(k, 6) AS keyword_score, row_number() OVER (ORDER BY round(fused, 12) DESC, chunk_ref) AS rank FROM f ORDER BY round(fused, 12) DESC, chunk_ref LIMIT 30""")
def rrf_hybrid(spark, sf_dir):
    top = search.vector_topk(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 40)
    fused = search.fuse(search.semantic_hits(top, "vec_id", F.lit("embeddings")), _lexical(spark, sf_dir, 40), 30)
    return fused.select("chunk_ref", *[F.round(c, 6).alias(c) for c in ("fused_score", "semantic_score", "keyword_score")], "rank")


@query("""WITH r AS (SELECT doc_id, source, count(*) OVER () AS total FROM documents WHERE lang = 'en' AND contains(text, 'ing the '))
SELECT doc_id, source, total, total > 30 AS has_more FROM r ORDER BY doc_id LIMIT 10 OFFSET 20""")
def page_of_records(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return search.browse(docs, "doc_id", 20, 10, {"lang": "en"}, "text", "ing the ").select("doc_id", "source", "total", "has_more")


@query("SELECT source AS collection, count(*) AS n FROM documents GROUP BY 1")
def collection_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("collection")).agg(F.count("*").alias("n"))


@query(f"WITH s AS (SELECT label, {_DIST} AS d FROM embeddings e, embeddings q WHERE q.vec_id = 0) SELECT label, round(greatest(0, least(1, max(1 - d))), 6) AS confidence FROM (SELECT * FROM s) GROUP BY 1".replace("label, {", "e.label, {").replace("SELECT label, 1", "SELECT e.label AS label, 1"))
def retrieval_confidence(spark, sf_dir):
    near = search.distances(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir))
    return near.groupBy("label").agg(F.round(search.confidence(1 - F.col("distance")), 6).alias("confidence"))


# ---- segmentation


def conversation_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as Markdown: for each turn a page marker, the role as heading, the text."""
    turn = F.concat(F.lit("## Page "), (F.col("turn") + 1).cast("string"), F.lit("\n## "), F.col("role"), F.lit("\n\n"), F.col("text"), F.lit("\n\n\n---\n"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", turn.alias("part"))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "part"))), lambda x: x["part"]), "\n").alias("markdown"))


_CHUNKS = r"""WITH c AS (SELECT conv_id, turn, role AS heading, regexp_replace(regexp_replace(text, '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', E'\n\n', 'g') AS t, turn + 1 AS page_start,
    coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn), turn) + 1 AS page_end FROM conversations),
k AS (SELECT *, trim(t, E' \n\t') AS content FROM c WHERE trim(t, E' \n\t') <> ''),
chunks AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, heading, content, page_start, page_end FROM k)"""


@query(_CHUNKS + """ SELECT conv_id, idx AS index, heading, md5(content) AS content_md5, page_start, page_end,
'conv-' || conv_id || ':v1:' || idx || ':' || substr(sha256(heading || chr(10) || content), 1, 16) AS chunk_id FROM chunks""")
def header_chunks(spark, sf_dir):
    chunks = segment.header_chunks(conversation_markdown(spark, sf_dir), ["conv_id"])
    chunks = segment.with_chunk_ids(chunks, F.concat(F.lit("conv-"), F.col("conv_id").cast("string")), F.lit("v1"))
    return chunks.select("conv_id", "index", "heading", F.md5("content").alias("content_md5"), "page_start", "page_end", "chunk_id")


def document_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a document as a paragraph of its chunk."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")).alias("search_text"))
    return segment.paragraphs(docs, ["doc_id"])


_PARAS = r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
p AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS ordinal FROM l WHERE trim(text) <> ''),
k AS (SELECT *, replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ß', 'ss') AS identity FROM p)"""


@query(_PARAS + """ SELECT doc_id, ordinal, md5(text) AS text_md5, row_number() OVER (PARTITION BY doc_id, identity ORDER BY ordinal) AS occurrence,
doc_id || ':' || substr(sha256(identity), 1, 12) || ':' || row_number() OVER (PARTITION BY doc_id, identity ORDER BY ordinal) AS paragraph_id, sha256(text) AS exact_content_hash, sha256(identity) AS normalized_identity_hash FROM k""")
def paragraph_split(spark, sf_dir):
    p = segment.with_paragraph_ids(document_paragraphs(spark, sf_dir), "doc_id")
    return p.select("doc_id", "ordinal", F.md5("text").alias("text_md5"), "occurrence", "paragraph_id", "exact_content_hash", "normalized_identity_hash")


@query(_PARAS + """ SELECT doc_id, ordinal, md5(lag(text, 1, '') OVER w) AS previous_md5, md5(lead(text, 1, '') OVER w) AS next_md5 FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)""")
def tag_request_context(spark, sf_dir):
    p = segment.with_context(document_paragraphs(spark, sf_dir), "doc_id")
    return p.select("doc_id", "ordinal", F.md5("previous_context").alias("previous_md5"), F.md5("next_context").alias("next_md5"))


@query()
def oversized_split(spark, sf_dir):
    rows = segment.split_oversized(table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("content")), limit=300, target=250)
    return rows.select("doc_id", "part", "parts", T.word_count(F.col("content")).alias("words"), F.sha2("content", 256).alias("content_sha256"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'images/' || doc_id || '.png,' || source || '.jpg' WHEN 1 THEN lang || '/a_b-c.' || doc_id WHEN 2 THEN 'x.y.png,' || lang || '.gif' ELSE '' END AS refs, doc_id % 4 IN (1, 2) AS image_only,
CASE doc_id % 4 WHEN 0 THEN doc_id || '' WHEN 1 THEN 'a b c' WHEN 2 THEN 'x.y' END AS caption FROM documents""")
def image_refs(spark, sf_dir):
    k = F.col("doc_id") % 4
    both = F.format_string('![cap %s](images/%s.png "t") see <img src="%s.jpg" alt=x> ![again](images/%s.png)', "lang", "doc_id", "source", "doc_id")
    line = F.when(k == 0, both).when(k == 1, F.format_string(" ![](%s/a_b-c.%s)\t", "lang", "doc_id")).when(k == 2, F.format_string("<IMG class=c src='%s.gif'>  ![t](x.y.png)", "lang")).otherwise(F.concat(F.lit("[no image](a.png) ! ["), "source", F.lit("](b.png) <img>")))
    refs = T.image_refs(F.col("line"))
    return table(spark, sf_dir, "documents").withColumn("line", line).select("doc_id", F.array_join(refs, ",").alias("refs"), T.is_image_only(F.col("line")).alias("image_only"), F.when(F.size(refs) > 0, T.caption_fallback(F.get(refs, F.lit(0)))).alias("caption"))


# ---- identity and reuse


@query("SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, strlen(text) AS byte_length FROM documents")
def content_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ids.fingerprint(F.col("text")).alias("f")).select("doc_id", "f.*")


@query("SELECT sha256(lang) AS sha256, count(DISTINCT md5(text) || strlen(text)) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT md5(text) || strlen(text)) > 1")
def fingerprint_collisions(spark, sf_dir):
    """As if texts of one language had one digest: a true collision is not at hand."""
    d = table(spark, sf_dir, "documents")
    return state.collisions(d.select(F.sha2("lang", 256).alias("sha256"), F.md5("text").alias("md5"), F.octet_length("text").alias("byte_length")))


@query(r"SELECT sha256(replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ß', 'ss')) AS identity_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", ids.identity_hash(F.col("text")).alias("identity_hash"))
    return d.groupBy("identity_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("WITH k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS representative FROM documents) SELECT doc_id, representative, doc_id <> representative AS reused FROM k")
def embedding_representatives(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return state.representatives(d, ["sha"], "doc_id").select("doc_id", "representative", "reused")


@query("WITH k AS (SELECT source, doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS r FROM documents) SELECT source, count(*) AS chunks, count(*) FILTER (doc_id = r) AS embedded, count(*) FILTER (doc_id <> r) AS reused FROM k GROUP BY 1")
def index_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha"))
    return metrics.index_report(state.representatives(d, ["sha"], "doc_id"), ["source"])


@query("""WITH c AS (SELECT DISTINCT sha256(text) AS sha, max(l.quality) OVER (PARTITION BY sha256(text)) AS quality FROM documents JOIN labels l USING (doc_id))
SELECT doc_id, quality AS value, quality IS NOT NULL AS hit FROM documents d LEFT JOIN c ON c.sha = sha256(d.text)""")
def embedding_cache_lookup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    cache = d.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("sha").agg(F.max("quality").alias("value"))
    return state.cached(d, cache, ["sha"], "value").select("doc_id", "value", "hit")


# ---- concepts


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types as concepts of order lines: document = supplier, chunk = order, paragraph = line."""
    li = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("doc-"), F.col("l_suppkey").cast("string")).alias("document_ref"), F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").alias("ordinal"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("paragraph_id"), "l_partkey", F.col("l_returnflag").alias("role"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_size") % 2 == 0, F.initcap("p_type")).otherwise(F.col("p_type")).alias("concept"), F.col("p_brand").alias("header"), F.col("p_name").alias("excerpt"))
    return li.join(p, "l_partkey").drop("l_partkey")


_FACTS = """facts AS (SELECT 'doc-' || l_suppkey AS document_ref, l_orderkey AS chunk_id, l_linenumber AS ordinal, l_orderkey || '-' || l_linenumber AS paragraph_id, l_returnflag AS role,
  CASE WHEN p_size % 2 = 0 THEN p_type[1] || lower(p_type[2:]) ELSE p_type END AS concept, p_brand AS header, p_name AS excerpt FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_CATALOG = f"""WITH {_FACTS}, d AS (SELECT document_ref, lower(concept) AS normalized_label, chunk_id, ordinal, paragraph_id, min(header) AS header, min(excerpt) AS excerpt FROM facts GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY document_ref, normalized_label ORDER BY chunk_id, ordinal, paragraph_id) AS r FROM d),
u AS (SELECT document_ref, normalized_label, count(DISTINCT paragraph_id) AS usage_count, string_agg(header || '|' || excerpt, ';' ORDER BY r) FILTER (r <= 3) AS examples FROM r GROUP BY ALL),
n AS (SELECT document_ref, lower(concept) AS normalized_label, min(concept) AS canonical_label FROM facts GROUP BY ALL),
catalog AS (SELECT * FROM n JOIN u USING (document_ref, normalized_label))"""


def _shown(examples):
    return F.array_join(F.transform(examples, lambda e: F.concat_ws("|", e["header"], e["excerpt"])), ";")


@query(_CATALOG + " SELECT document_ref, normalized_label, canonical_label, usage_count, examples FROM catalog")
def document_catalog(spark, sf_dir):
    c = concepts.document_catalog(facts(spark, sf_dir), ["document_ref"])
    return c.select("document_ref", "normalized_label", "canonical_label", "usage_count", _shown(F.col("examples")).alias("examples"))


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.document_catalog(facts(spark, sf_dir), ["document_ref"]).withColumn("source_version", F.lit("v1"))


@query(_CATALOG + """, e AS (SELECT DISTINCT normalized_label, header, excerpt FROM r WHERE r <= 3),
x AS (SELECT *, row_number() OVER (PARTITION BY normalized_label ORDER BY header, excerpt) AS k FROM e),
s AS (SELECT normalized_label, string_agg(header || '|' || excerpt, ';' ORDER BY k) AS examples FROM x WHERE k <= 3 GROUP BY 1)
SELECT normalized_label, min(canonical_label) AS canonical_label, sum(usage_count)::BIGINT AS usage_count, min(document_ref) AS first_document, any_value(s.examples) AS examples FROM catalog JOIN s USING (normalized_label) GROUP BY 1""")
def global_catalog(spark, sf_dir):
    g = concepts.global_catalog(_observations(spark, sf_dir))
    return g.select("normalized_label", "canonical_label", "usage_count", F.col("first_seen.document_ref").alias("first_document"), _shown(F.col("examples")).alias("examples"))


@query(_CATALOG + """, g AS (SELECT normalized_label, min(canonical_label) AS c, sum(usage_count)::BIGINT AS u FROM catalog GROUP BY 1)
SELECT sha256('[' || string_agg('{"canonical_label":"' || c || '","normalized_label":"' || normalized_label || '","usage_count":' || u || '}', ',' ORDER BY normalized_label) || ']') AS catalog_version FROM g""")
def catalog_version(spark, sf_dir):
    return concepts.catalog_version(concepts.global_catalog(_observations(spark, sf_dir)))


@query(f"""WITH {_FACTS}, r AS (SELECT document_ref, concept, role, count(DISTINCT paragraph_id) AS n FROM facts GROUP BY ALL), k AS (SELECT document_ref, concept, string_agg(role || ':' || n, ',' ORDER BY role) AS roles FROM r GROUP BY ALL),
p AS (SELECT document_ref, concept, count(DISTINCT chunk_id) AS n_parents, min(chunk_id * 10 + ordinal) AS first_seq FROM facts GROUP BY ALL) SELECT document_ref, concept, roles, n_parents, first_seq FROM k JOIN p USING (document_ref, concept)""")
def concept_inventory(spark, sf_dir):
    f = facts(spark, sf_dir).withColumns({"seq": F.col("chunk_id") * 10 + F.col("ordinal"), "chunk_rank": F.col("chunk_id")})
    i = concepts.inventory(f, ["document_ref"])
    return i.select("document_ref", "concept", F.array_join(F.transform("roles", lambda r: F.concat_ws(":", r["role"], r["n"].cast("string"))), ",").alias("roles"), F.size("parents").alias("n_parents"), "first_seq")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.concat(F.lit("  "), F.initcap("p_name"), F.lit(" ")).alias("label"), F.col("p_size").alias("rank"), F.col("p_retailprice").alias("score"))


_CAND = """c AS (SELECT p_brand AS brand, p_name AS key, p_size AS rank, p_retailprice AS score, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_size, p_retailprice DESC) AS r FROM part), b AS (SELECT * FROM c WHERE r = 1)"""


@query(f"WITH {_CAND} SELECT brand, key, rank, score FROM b")
def candidate_dedup(spark, sf_dir):
    return concepts.deduplicated_candidates(_candidates(spark, sf_dir), ["brand"]).select("brand", "key", "rank", "score")


@query(f"""WITH {_CAND}, s AS (SELECT *, key = 'red widget' AS exact, (list_contains(string_split(key, ' '), 'red')::INT + list_contains(string_split(key, ' '), 'widget')::INT) AS shared FROM b),
p AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY exact DESC, shared DESC, rank, key) AS place FROM s)
SELECT brand, place, key, exact, shared FROM p WHERE place <= 5""")
def candidate_ranking(spark, sf_dir):
    return concepts.ranked_candidates(_candidates(spark, sf_dir), F.lit(" RED  Widget"), 5, ["brand"]).select("brand", "place", "key", "exact", "shared")


@query(f"""WITH {_FACTS}, s AS (SELECT lower(concept) AS selection, lower(concept) AS key, role, list(DISTINCT chunk_id) AS parents FROM facts GROUP BY ALL)
SELECT s.selection || '/' || s.role AS selection, string_agg(DISTINCT paragraph_id, ',' ORDER BY paragraph_id) AS paragraph_refs FROM s JOIN facts f ON lower(f.concept) = s.key AND f.role = s.role AND list_contains(s.parents, f.chunk_id) GROUP BY 1""")
def paragraph_traversal(spark, sf_dir):
    f = facts(spark, sf_dir)
    parents = f.select(F.concat_ws("/", F.lower("concept"), "role").alias("selection"), F.lower("concept").alias("concept"), "role", "chunk_id").distinct()
    return concepts.joined_refs(concepts.traversal_rows(parents, f))


@query(f"WITH {_FACTS} SELECT DISTINCT concept, lower(concept) AS folded FROM facts")
def distinct_concepts(spark, sf_dir):
    return concepts.distinct_concepts(facts(spark, sf_dir))


@query(f"""WITH {_FACTS}, p AS (SELECT chunk_id, paragraph_id, max(CASE role WHEN 'N' THEN 'completed' WHEN 'R' THEN 'failed' ELSE 'skipped' END) AS status FROM facts GROUP BY ALL)
SELECT count(DISTINCT chunk_id) AS chunks, count(*) AS paragraphs, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, (SELECT count(*) FROM facts) AS relations FROM p""")
def tagging_summary(spark, sf_dir):
    f = facts(spark, sf_dir)
    status = F.max(F.when(F.col("role") == "N", "completed").when(F.col("role") == "R", "failed").otherwise("skipped"))
    return concepts.run_summary(f.groupBy("chunk_id", "paragraph_id").agg(status.alias("status")), f)


@query("""WITH l AS (SELECT l_orderkey AS chunk_id, l_linenumber AS ordinal, l_orderkey || '-' || l_linenumber AS paragraph_id FROM lineitem)
SELECT chunk_id, count(*) AS n, md5(string_agg(paragraph_id, ',' ORDER BY ordinal, paragraph_id)) AS ids_md5, md5(string_agg('line ' || paragraph_id, ',' ORDER BY ordinal, paragraph_id)) AS texts_md5 FROM l GROUP BY 1""")
def chunk_payload(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").alias("ordinal"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("paragraph_id"))
    c = concepts.chunk_payload(p.withColumn("text", F.concat(F.lit("line "), "paragraph_id")))
    return c.select("chunk_id", F.size("paragraphs").alias("n"), F.md5(F.array_join(F.transform("paragraphs", lambda x: x["paragraph_id"]), ",")).alias("ids_md5"), F.md5(F.array_join(F.transform("paragraphs", lambda x: x["text"]), ",")).alias("texts_md5"))


@query(f"""WITH {_FACTS}, t AS (SELECT chunk_id, paragraph_id, concept, dense_rank() OVER (PARTITION BY chunk_id ORDER BY paragraph_id, concept) AS o FROM facts),
m AS (SELECT chunk_id, concept, min(o) AS o FROM t GROUP BY ALL)
SELECT chunk_id, string_agg(concept, ',' ORDER BY o) AS tags, (SELECT count(DISTINCT paragraph_id) FROM t WHERE t.chunk_id = m.chunk_id) AS n_tagged FROM m GROUP BY 1""")
def index_tags(spark, sf_dir):
    f = facts(spark, sf_dir)
    t = concepts.index_tags(f.select("chunk_id", "paragraph_id").distinct(), f)
    return t.select("chunk_id", F.array_join("tags", ",").alias("tags"), F.size("tagged_paragraphs").alias("n_tagged"))


@query(f"""WITH {_FACTS} SELECT chunk_id, paragraph_id, concept, role FROM facts""")
def tagging_relations(spark, sf_dir):
    f = facts(spark, sf_dir)
    labels = f.groupBy("chunk_id", "paragraph_id", "concept").agg(F.collect_list("role").alias("roles"))
    paras = labels.groupBy("chunk_id", "paragraph_id").agg(F.collect_list(F.struct(F.col("concept").alias("label"), "roles")).alias("labels"))
    return concepts.relations(paras.groupBy("chunk_id").agg(F.collect_list(F.struct("paragraph_id", "labels")).alias("paragraphs")))


# ---- state

NOW = "2024-02-01 00:00:00"


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Existing: labelled documents (of low quality: another hash; toxic: not synced) and pages. Desired: all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    columns = [F.lit("chunk").alias("entity_type"), F.lit("document_chunks").alias("collection"), F.lit("profile-1").alias("model"), F.lit(64).alias("dimensions"), F.lit("v1").alias("index_version")]
    key = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    desired = docs.select(key.alias("entity_key"), key.alias("record_id"), F.sha2("text", 256).alias("input_hash"), F.col("source").alias("document_ref"), F.lit("s1").alias("source_version"), *columns)
    labelled = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    old = labelled.select(key.alias("entity_key"), key.alias("record_id"), F.when(F.col("quality") == 1, F.sha2("text", 256)).otherwise(F.md5("text")).alias("input_hash"), F.col("source").alias("document_ref"), F.lit("s1").alias("source_version"), F.when(F.col("toxic") == 1, "stale").otherwise("synced").alias("sync_status"), *columns)
    page_key = F.concat(F.lit("p"), F.col("page_id").cast("string"))
    pages = table(spark, sf_dir, "pages").select(page_key.alias("entity_key"), page_key.alias("record_id"), F.md5("url").alias("input_hash"), F.lit(None).cast("string").alias("document_ref"), F.lit(None).cast("string").alias("source_version"), F.lit("synced").alias("sync_status"), *columns)
    return old.unionByName(pages), desired


@query("""WITH e AS (SELECT 'd' || doc_id AS k, CASE WHEN quality = 1 THEN sha256(text) ELSE md5(text) END AS h, toxic = 0 AS synced FROM documents JOIN labels USING (doc_id) UNION ALL SELECT 'p' || page_id, md5(url), true FROM pages),
d AS (SELECT 'd' || doc_id AS k, sha256(text) AS h FROM documents)
SELECT coalesce(d.k, e.k) AS entity_key, CASE WHEN e.k IS NULL THEN 'new' WHEN d.k IS NULL THEN 'stale' WHEN e.h = d.h AND e.synced THEN 'unchanged' ELSE 'changed' END AS change, coalesce(d.h, e.h) AS input_hash FROM e FULL JOIN d ON e.k = d.k""")
def vector_state_diff(spark, sf_dir):
    return state.reconcile(*_states(spark, sf_dir)).select("entity_key", "change", "input_hash")


@query("""SELECT 'stale-delete-' || sha256(concat_ws(chr(31), 'run-1', 'chunk', 'p' || page_id, 'document_chunks', 'p' || page_id, 'v1')) AS event_id, 'p' || page_id AS record_id, 'doc-0' AS document_ref, 'delete' AS operation FROM pages""")
def stale_delete_events(spark, sf_dir):
    return state.stale_events(state.reconcile(*_states(spark, sf_dir)), "run-1", "doc-0", "s1").select("event_id", "record_id", "document_ref", "operation")


@query(f"""WITH q AS (SELECT doc_id AS request_id, sha256(text) AS sha FROM documents),
l AS (SELECT sha256(text) AS sha, max_by(quality, doc_id) AS q, max_by(toxic, doc_id) AS t, TIMESTAMP '{NOW}' - to_minutes((max(doc_id) % 121)::INT) AS t_at FROM documents JOIN labels USING (doc_id) GROUP BY 1),
x AS (SELECT request_id, CASE WHEN q = 0 THEN 'processing' WHEN t = 1 THEN 'failed' WHEN q = 1 THEN 'ready' END AS status, TIMESTAMP '{NOW}' - t_at >= INTERVAL 60 MINUTE AS old, row_number() OVER (PARTITION BY q.sha ORDER BY request_id) = 1 AS first FROM q LEFT JOIN l ON l.sha = q.sha)
SELECT request_id, CASE WHEN status = 'ready' THEN 'ready' WHEN status = 'processing' AND NOT old THEN 'busy' WHEN first THEN 'reserved' ELSE 'shared' END AS outcome, coalesce(status = 'processing' AND old, false) AND first AS recovered FROM x""")
def ledger_reserve(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    known = docs.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("sha").agg(F.max_by("quality", "doc_id").alias("q"), F.max_by("toxic", "doc_id").alias("t"), F.max("doc_id").alias("d"))
    status = F.when(F.col("q") == 0, "processing").when(F.col("t") == 1, "failed").otherwise("ready")
    now = F.to_timestamp(F.lit(NOW))
    ledger = known.select("sha", status.alias("status"), (now - F.make_dt_interval(F.lit(0), F.lit(0), (F.col("d") % 121).cast("int"))).alias("updated_at"))
    return state.reserve(docs.withColumnRenamed("doc_id", "request_id"), ledger, ["sha"], now).select("request_id", "outcome", "recovered")


@query("SELECT source AS key, max_by(doc_id, n_chars * 1000000 + doc_id) AS doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY 1")
def latest_ready(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    ledger = rows.select(F.col("source").alias("key"), F.when(F.col("quality") == 1, "ready").otherwise("failed").alias("status"), (F.col("n_chars") * 1000000 + F.col("doc_id")).alias("updated_at"), "doc_id")
    return state.latest_ready(ledger, ["key"]).select("key", "doc_id")


def _outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as work items: errors delete the user's record, all others write it."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id"), F.col("user_id").alias("record_id"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("operation"), F.col("value"), F.col("event_type").alias("run_id"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record_id"), F.col("c_acctbal").alias("value"))


@query("""WITH l AS (SELECT user_id AS record_id, arg_max(event_type, event_id) AS t, arg_max(value, event_id) AS value FROM events GROUP BY 1)
SELECT c_custkey AS record_id, c_acctbal AS value FROM customer WHERE c_custkey NOT IN (SELECT record_id FROM l) UNION ALL SELECT record_id, value FROM l WHERE t <> 'error'""")
def outbox_drain(spark, sf_dir):
    return state.drained(_records(spark, sf_dir), _outbox(spark, sf_dir), ["record_id"], ["event_id"])


@query("""WITH n AS (SELECT event_id, value FROM events UNION ALL SELECT event_id, value + 1 FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, value FROM events WHERE event_type = 'view'),
k AS (SELECT event_id, value FROM events WHERE event_type IN ('purchase', 'view')), c AS (SELECT event_id FROM n GROUP BY 1 HAVING count(DISTINCT value) > 1)
SELECT DISTINCT event_id, value FROM n WHERE event_id NOT IN (SELECT event_id FROM k) AND event_id NOT IN (SELECT event_id FROM c)""")
def outbox_enqueue(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "value", "event_type")
    given = e.unionByName(e.where("event_type = 'click'").withColumn("value", F.col("value") + 1)).unionByName(e.where("event_type = 'view'"))
    fresh, _ = state.enqueue(e.where("event_type IN ('purchase', 'view')"), given, ["value"])
    return fresh.select("event_id", "value")


@query("SELECT event_id FROM events WHERE event_type = 'click'")
def outbox_conflicts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "value", "event_type")
    given = e.unionByName(e.where("event_type = 'click'").withColumn("value", F.col("value") + 1))
    return state.enqueue(e.where("event_type IN ('purchase', 'view')"), given, ["value"])[1]


@query("SELECT event_id, user_id AS record_id FROM events WHERE event_type IN ('click', 'error') ORDER BY event_id LIMIT 100")
def outbox_batch(spark, sf_dir):
    status = F.when(F.col("run_id") == "click", "pending").when(F.col("run_id") == "error", "failed").otherwise("done")
    return state.next_batch(_outbox(spark, sf_dir).withColumn("status", status), 100).select("event_id", "record_id")


@query("SELECT event_type AS run_id, count(*) AS pending FROM events WHERE event_type IN ('click', 'error') GROUP BY 1")
def outbox_pending(spark, sf_dir):
    status = F.when(F.col("run_id") == "click", "pending").when(F.col("run_id") == "error", "failed").otherwise("done")
    x = _outbox(spark, sf_dir).withColumn("status", status).where(F.col("status").isin("pending", "failed"))
    return x.groupBy("run_id").agg(F.count("*").alias("pending"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'done' ELSE 'pending' END AS status, (event_type = 'error')::INT AS attempts, CASE WHEN event_type = 'error' THEN 'boom' END AS last_error FROM events""")
def outbox_transition(spark, sf_dir):
    box = _outbox(spark, sf_dir).select("event_id", F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("last_error"))
    out = table(spark, sf_dir, "events").where("event_type IN ('error', 'view')").select("event_id", F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("outcome"), F.lit("boom").alias("error"))
    return state.transitioned(box, out).select("event_id", "status", "attempts", "last_error")


_STATE = "CASE event_type WHEN 'view' THEN 'processing' WHEN 'signup' THEN 'processing' WHEN 'click' THEN 'pending' WHEN 'purchase' THEN 'ready' ELSE 'failed' END"


@query(f"""WITH s AS (SELECT event_id, user_id, {_STATE} AS state, lag({_STATE}) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events)
SELECT event_id, state, previous, coalesce((previous IS NULL AND state = 'processing') OR (previous = 'processing' AND state IN ('pending', 'failed')) OR (previous = 'pending' AND state IN ('ready', 'failed')) OR (previous = 'failed' AND state = 'processing'), false) AS legal FROM s""")
def lifecycle_transitions(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("event_id", "user_id", F.expr(_STATE).alias("state"))
    return state.transitions(log, "user_id", ["event_id"]).select("event_id", "state", "previous", "legal")


@query("SELECT c_custkey AS record_id, CASE WHEN o IS NULL THEN c_acctbal ELSE o END AS value FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS o FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def record_upsert(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("record_id")).agg(F.max("o_totalprice").alias("value"))
    return state.upserted(_records(spark, sf_dir), orders, ["record_id"])


@query("""SELECT l_orderkey, l_linenumber, l_returnflag AS role FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
UNION ALL SELECT o_orderkey, 0, 'replaced' FROM orders WHERE o_orderstatus = 'F'""")
def relations_replace(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), F.col("l_returnflag").alias("role"))
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("l_linenumber"), F.lit("replaced").alias("role"))
    return state.replaced(li, done, done, ["l_orderkey"])


# ---- evidence


@query(_PARAS + f""", h AS (SELECT doc_id, row_number() OVER (ORDER BY {_LEX_SCORE} DESC, doc_id) AS rank FROM documents WHERE {_LEX_SCORE} > 0 ORDER BY {_LEX_SCORE} DESC, doc_id LIMIT 20)
SELECT p.doc_id, p.ordinal, d.source AS header, row_number() OVER (ORDER BY rank, ordinal) AS place FROM p JOIN h USING (doc_id) JOIN documents d USING (doc_id)""")
def context_hydration(spark, sf_dir):
    hits = _lexical(spark, sf_dir, 20).select(F.col("chunk_ref").alias("doc_id"), "rank", F.lit(0).alias("query_id"))
    paras = document_paragraphs(spark, sf_dir).withColumn("paragraph_id", F.col("ordinal"))
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("header"))
    return evidence.hydrate(hits, paras, chunks, ["doc_id"]).select("doc_id", "ordinal", "header", "place")


@query(f"WITH {_FACTS}, p AS (SELECT DISTINCT paragraph_id FROM facts) SELECT paragraph_id, string_agg(DISTINCT concept || ' -> ' || role, ';' ORDER BY concept || ' -> ' || role) AS labels FROM p JOIN facts USING (paragraph_id) GROUP BY 1")
def paragraph_labels(spark, sf_dir):
    f = facts(spark, sf_dir)
    return evidence.with_labels(f.select("paragraph_id").distinct(), f).select("paragraph_id", F.array_join("labels", ";").alias("labels"))


_WORDS = r"length(regexp_replace(trim(text), '\s+', ' ', 'g')) - length(regexp_replace(trim(text), '\s+', '', 'g')) + (trim(text) <> '')::INT"


@query(f"""WITH w AS (SELECT source, doc_id, {_WORDS} AS words FROM documents), r AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY doc_id) AS running_words, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM w)
SELECT source, doc_id, words, running_words::BIGINT AS running_words, place FROM r WHERE running_words <= 4000 AND place <= 20""")
def context_limit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    return evidence.limited(docs, ["source"], ["doc_id"], 20, 4000).select("source", "doc_id", "words", "running_words", "place")


@query(f"""WITH r AS (SELECT source, {_WORDS} AS words, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) SELECT source FROM r WHERE n = 1 AND words > 200""")
def first_too_long(spark, sf_dir):
    return evidence.first_too_long(table(spark, sf_dir, "documents"), ["source"], ["doc_id"], 200)


@query(r"""WITH RECURSIVE t AS (SELECT conv_id, n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, n) - 1 AS i FROM (SELECT conv_id, turn, len(regexp_extract_all(text, '\S+')) AS n FROM conversations)),
s AS (SELECT DISTINCT conv_id, -1::BIGINT AS i, 0::BIGINT AS used, '' AS fits FROM t UNION ALL
SELECT t.conv_id, t.i, used + CASE WHEN used + n <= 150 THEN n ELSE 0 END, CASE WHEN used + n <= 150 THEN concat_ws(',', nullif(fits, ''), t.i) ELSE fits END FROM s JOIN t ON t.conv_id = s.conv_id AND t.i = s.i + 1)
SELECT conv_id, arg_max(fits, i) AS fits FROM s GROUP BY 1""")
def greedy_budget(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.word_count(F.col("text")).alias("n"))
    turns = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "n"))), lambda x: F.struct(x["n"].alias("n"))).alias("items"))
    return turns.select("conv_id", F.array_join(evidence.greedy_fit(F.col("items"), 150), ",").alias("fits"))


@query("""WITH l AS (SELECT user_id, event_type, event_id % 13 AS key, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rank, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS list_no FROM events WHERE event_type IN ('view', 'click', 'purchase')),
f AS (SELECT user_id, key, min(rank * 10 + list_no) AS o FROM l GROUP BY ALL), r AS (SELECT user_id, key, row_number() OVER (PARTITION BY user_id ORDER BY o) AS new_rank FROM f) SELECT * FROM r WHERE new_rank <= 5""")
def interleaved_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type IN ('view', 'click', 'purchase')")
    rank = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    lists = e.select("user_id", (F.col("event_id") % 13).alias("key"), rank.alias("rank"), F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).otherwise(2).alias("list_no"))
    return evidence.interleaved(lists, ["user_id"], ["key"], 5)


@query("""WITH n AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS call_number FROM events)
SELECT event_id, call_number, CASE event_type WHEN 'view' THEN call_number <= 3 WHEN 'click' THEN call_number <= 2 ELSE true END AS admitted FROM n""")
def budget_admission(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return evidence.admitted(calls, "user_id", "event_type", ["event_id"], {"view": 3, "click": 2}).select("event_id", "call_number", "admitted")


@query("""SELECT 'document:' || substr(sha256(concat_ws(chr(31), 'document', source, doc_id::VARCHAR, 'p' || doc_id, '')), 1, 20) AS evidence_id, doc_id, doc_id % 7 AS page, round(n_chars / 100000.0, 6) AS score FROM documents WHERE doc_id % 7 > 0""")
def evidence_ledger(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    p = d.select(F.col("source").alias("source_ref"), F.col("doc_id").cast("string").alias("chunk_id"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("paragraph_ref"), "text", F.array("lang", (F.col("doc_id") % 7).cast("string")).alias("pages"))
    null = F.lit(None).cast("double")
    s = d.select(F.col("doc_id").cast("string").alias("chunk_id"), null.alias("fused_score"), (F.col("n_chars") / 100000.0).alias("semantic_score"), null.alias("keyword_score"))
    return evidence.ledger(p, s).select("evidence_id", F.col("chunk_id").cast("long").alias("doc_id"), F.col("page").cast("long").alias("page"), F.round("score", 6).alias("score"))


@query("SELECT doc_id AS evidence_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1)")
def dangling_citations(spark, sf_dir):
    good = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi")
    return evidence.dangling(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("evidence_id")), good.select(F.col("doc_id").alias("evidence_id")))


@query("WITH f AS (SELECT user_id, event_type AS ref, min(event_id) AS first_use FROM events GROUP BY ALL) SELECT user_id, ref, row_number() OVER (PARTITION BY user_id ORDER BY first_use) AS number FROM f")
def citation_numbers(spark, sf_dir):
    uses = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("ref"), "event_id")
    return evidence.citation_numbers(uses, ["user_id"], "ref", "event_id").select("user_id", "ref", "number")


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'As ' || lang || ' says [2], and ' || source || ' too [1][2]; see [3].' WHEN 1 THEN lang || ' [1] and ' || source ELSE 'nothing by ' || source END AS answer,
doc_id % 3 = 0 OR (doc_id % 3 = 1 AND doc_id % 2 = 0) OR (doc_id % 3 = 2 AND doc_id % 2 = 1) AS agree FROM documents""")
def inline_citations(spark, sf_dir):
    k, none = F.col("doc_id") % 3, F.expr("cast(array() as array<string>)")
    answer = F.when(k == 0, F.format_string("As %s says [7], and %s too [2][7]; see [1].", "lang", "source")).when(k == 1, F.concat("lang", F.lit(" [4] and "), "source")).otherwise(F.concat(F.lit("nothing by "), "source"))
    # Every other label is not the one that the answer shows.
    odd = F.col("doc_id") % 2 == 1
    labels = F.when(k == 0, F.array(F.lit("[2]"), F.lit("[7]"), F.lit("[1]"))).when(k == 1, F.when(odd, F.array(F.lit("[4]"), F.lit("[5]"))).otherwise(F.array(F.lit("[4]")))).otherwise(F.when(odd, none).otherwise(F.array(F.lit("[9]"))))
    return table(spark, sf_dir, "documents").select("doc_id", evidence.renumbered(answer, labels).alias("answer"), evidence.citations_agree(answer, labels).alias("agree"))


@query("WITH c AS (SELECT user_id, floor(value)::BIGINT AS evidence_id, min(event_id) AS position FROM events GROUP BY ALL) SELECT user_id, evidence_id, position, source FROM c JOIN documents ON doc_id = evidence_id")
def answer_sources(spark, sf_dir):
    cites = table(spark, sf_dir, "events").select("user_id", F.floor("value").alias("evidence_id"), F.col("event_id").alias("position"))
    ev = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("evidence_id"), "source")
    return evidence.answer_sources(cites, ev, ["user_id"]).select("user_id", "evidence_id", "position", "source")


@query(r"""WITH k AS (SELECT source, doc_id, lang, replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ß', 'ss') AS choice FROM documents),
c AS (SELECT source, choice, min(doc_id) AS paragraph_ref, count(*) AS n FROM k GROUP BY ALL)
SELECT source, row_number() OVER (PARTITION BY source ORDER BY paragraph_ref)::VARCHAR AS key, paragraph_ref FROM c""")
def paragraph_choices(spark, sf_dir):
    p = table(spark, sf_dir, "documents").select(F.col("source").alias("scope"), F.col("doc_id").alias("paragraph_ref"), "source", "text", F.array("lang").alias("pages"))
    return evidence.merged_choices(p, ["scope"], "paragraph_ref").select(F.col("scope").alias("source"), "key", "paragraph_ref")


@query("""SELECT doc_id, md5(doc_id || ': ' || source || chr(10) || 'Paragraph ref: p' || doc_id || chr(10) || 'Source: ' || source || chr(10) || 'Nested headings: none' || chr(10) || 'Pages: 1-2' || chr(10) || 'Concepts and roles: ' || lang || chr(10) || 'Images: none' || chr(10) || 'Text:' || chr(10) || text) AS rendered_md5 FROM documents""")
def rendered_choices(spark, sf_dir):
    none = F.expr("cast(array() as array<string>)")
    r = evidence.rendered_choice(F.col("doc_id").cast("string"), F.col("source"), F.concat(F.lit("p"), F.col("doc_id").cast("string")), F.col("source"), none, F.array(F.lit("1"), F.lit("2")), F.array("lang"), none, F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(r).alias("rendered_md5"))


# ---- metrics and checks

def _telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("task"), F.when(F.col("value") > 40, "failed").otherwise("ok").alias("result"), F.col("value").alias("duration_ms"), tokens.alias("input_tokens"), (tokens % 10).alias("output_tokens"))


@query(r"""WITH t AS (SELECT event_type AS task, CASE WHEN value > 40 THEN 'failed' ELSE 'ok' END AS result, value, regexp_extract(props, '(\d+)', 1)::BIGINT AS k FROM events)
SELECT task, result, count(*) AS n, round(sum(value), 6) AS total_ms, min(value) AS min_ms, max(value) AS max_ms, sum(k)::BIGINT AS input_tokens, sum(k % 10)::BIGINT AS output_tokens FROM t GROUP BY ALL""")
def event_metrics(spark, sf_dir):
    return metrics.event_metrics(_telemetry(spark, sf_dir), ["task", "result"])


@query("""WITH s AS (SELECT event_type AS task, ts AS t_at, 1 AS d FROM events UNION ALL SELECT event_type, ts + to_seconds((value * 60)::BIGINT), -1 FROM events),
g AS (SELECT task, t_at, d, sum(d) AS x FROM s GROUP BY ALL), r AS (SELECT task, sum(x) OVER (PARTITION BY task ORDER BY t_at, d ROWS UNBOUNDED PRECEDING) AS running FROM g) SELECT task, max(running)::BIGINT AS max_concurrency FROM r GROUP BY 1""")
def max_concurrency(spark, sf_dir):
    t = _telemetry(spark, sf_dir)
    seconds = F.round(F.col("duration_ms") * 60).cast("long")
    spans = t.select("task", "ts", F.timestamp_micros(F.unix_micros("ts") + seconds * 1000000).alias("end"))
    return metrics.max_concurrency(spans, "task", "ts", "end")


@query(r"""WITH t AS (SELECT event_id, event_type, regexp_extract(props, '(\d+)', 1)::BIGINT AS k FROM events)
SELECT event_id, CASE event_type WHEN 'view' THEN ((k - k // 2) * 0.30 + (k // 2) * 0.006 + (k % 10) * 1.20) / 1000000.0 * 1000 WHEN 'click' THEN k * 0.02 / 1000000.0 * 1000 END::DOUBLE AS milli_usd FROM t""")
def model_cost(spark, sf_dir):
    t = _telemetry(spark, sf_dir).withColumns({"model": F.when(F.col("task") == "view", "deepseek-flash").when(F.col("task") == "click", "text-embedding-3-small").otherwise("unknown"), "cached_tokens": F.floor(F.col("input_tokens") / 2)})
    return metrics.model_cost(t).select("event_id", (F.col("cost_usd") * 1000).alias("milli_usd"))


@query("SELECT source, count(*) AS n, ceil(sum(length(text)) / 3.5)::BIGINT AS tokens FROM documents GROUP BY 1")
def prompt_estimate(spark, sf_dir):
    return metrics.prompt_estimate(table(spark, sf_dir, "documents"), ["source"], F.length("text"))


@query("""WITH p AS (SELECT event_id, row_number() OVER w AS completed, count(*) OVER (PARTITION BY user_id) AS total, epoch_us(ts) / 1000000.0 - min(epoch_us(ts) / 1000000.0) OVER (PARTITION BY user_id) AS e FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, completed, total, round(completed / total * 100, 2) AS progress_percent, round(CASE WHEN completed < total THEN e / completed * (total - completed) END, 1) AS eta_seconds FROM p""")
def ingest_progress(spark, sf_dir):
    t = _telemetry(spark, sf_dir)
    at = F.unix_micros("ts") / 1000000.0
    elapsed = at - F.min(at).over(Window.partitionBy("user_id"))
    return metrics.progress(t, "user_id", ["event_id"], elapsed).select("event_id", "completed", "total", "progress_percent", "eta_seconds")


@query("SELECT conv_id, count(*) AS n, max(length(text)) AS longest, sum(length(text))::BIGINT AS total, count(*) <= 6 AND max(length(text)) <= 2000 AND sum(length(text)) <= 6000 AS valid FROM conversations GROUP BY 1")
def chat_history_check(spark, sf_dir):
    return metrics.history_check(table(spark, sf_dir, "conversations"), "conv_id", "text", 6, 2000, 6000)


@query("""WITH c AS (SELECT user_id, event_type AS label, value / 100 AS confidence, row_number() OVER (PARTITION BY user_id ORDER BY value / 100 DESC, event_type) AS place, lead(value / 100) OVER (PARTITION BY user_id ORDER BY value / 100 DESC, event_type) AS next FROM events WHERE value / 100 >= 0.6),
k AS (SELECT user_id FROM c WHERE place = 1 AND next IS NOT NULL AND confidence - next <= 0.12), f AS (SELECT user_id, label, min(place) AS place FROM c JOIN k USING (user_id) WHERE place <= 4 GROUP BY ALL)
SELECT user_id, string_agg(label, ',' ORDER BY place) AS options FROM f GROUP BY 1 HAVING count(*) >= 2""")
def clarification_options(spark, sf_dir):
    c = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("label"), (F.col("value") / 100).alias("confidence"))
    return metrics.clarification(c, "user_id").select("user_id", F.array_join("options", ",").alias("options"))


@query("""SELECT doc_id, concat_ws(';', CASE WHEN toxic > quality THEN 'more tagged than paragraphs' END, CASE WHEN quality = 1 AND toxic > 0 THEN 'indexed despite failures' END) AS violations FROM labels""")
def report_violations(spark, sf_dir):
    r = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("paragraphs"), F.col("toxic").alias("tagged"), F.col("toxic").alias("failed"), (F.col("quality") == 1).alias("indexed"), F.expr("cast(array() as array<string>)").alias("errors"))
    return metrics.report_violations(r).select("doc_id", F.array_join("violations", ";").alias("violations"))


_SECRETS = "'Authorization: Bearer ' || lang || '.' || doc_id || '; COOKIE =bearer ' || doc_id || ', api_key=' || lang || doc_id || ', Password : bearer\tx; BEARER a.b-c by ' || source || '! ' || text"


@query(rf"""WITH t AS (SELECT doc_id, replace({_SECRETS}, source, '[REDACTED]') AS t FROM documents),
a AS (SELECT doc_id, regexp_replace(t, '{T.ASSIGNMENT}', '\1\2\3' || chr(57344) || '[REDACTED]', 'g') AS t FROM t),
b AS (SELECT doc_id, replace(regexp_replace(t, '(?i)Bearer ' || chr(57344), 'Bearer ', 'g'), chr(57344), '') AS t FROM a)
SELECT doc_id, regexp_replace(t, '{T.BEARER}', 'Bearer [REDACTED]', 'g') AS redacted FROM b""")
def secret_redaction(spark, sf_dir):
    # Each row masks its own source: the only name it can hold.
    own = F.replace(F.expr(_SECRETS), F.col("source"), F.lit(T.REDACTED))
    return table(spark, sf_dir, "documents").select("doc_id", T.redact(own).alias("redacted"))


@query("""WITH r AS (SELECT doc_id, unnest(['doc-' || doc_id, ' doc', 'a/b', 'a:b', '..', 'img/x.png', '../x.png', '/abs.png', 'http://x/y.png', 'a//b', 'CON.txt', 'dir/nul', 'ok/file.v1', 'end.']) AS ref FROM documents)
SELECT doc_id, ref, ref NOT IN (' doc', 'a/b', 'a:b', '..', 'img/x.png', '../x.png', '/abs.png', 'http://x/y.png', 'a//b', 'dir/nul', 'ok/file.v1') AS document_ok,
ref NOT IN (' doc', 'a:b', '..', '../x.png', '/abs.png', 'http://x/y.png', 'a//b') AS image_ok, ref NOT IN (' doc', 'a:b', '..', '../x.png', '/abs.png', 'http://x/y.png', 'a//b', 'CON.txt', 'dir/nul', 'end.') AS artifact_ok FROM r""")
def safe_references(spark, sf_dir):
    refs = [" doc", "a/b", "a:b", "..", "img/x.png", "../x.png", "/abs.png", "http://x/y.png", "a//b", "CON.txt", "dir/nul", "ok/file.v1", "end."]
    x = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), *[F.lit(r) for r in refs])).alias("ref"))
    c = F.col("ref")
    return x.select("doc_id", "ref", T.is_safe_document_ref(c).alias("document_ok"), T.is_safe_image_ref(c).alias("image_ok"), T.is_safe_artifact_ref(c).alias("artifact_ok"))


@query(r"SELECT doc_id, replace(lower(trim(regexp_replace('  ' || source || '  ' || text, '\s+', ' ', 'g'))), 'ß', 'ss') AS key FROM documents")
def concept_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.concept_key(F.concat(F.lit("  "), "source", F.lit("  "), "text")).alias("key"))


# ---- streams


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, max(value) AS most FROM events GROUP BY 1")
def stream_telemetry(spark, sf_dir):
    return streams.completed(streams.telemetry(streams.event_stream(spark, sf_dir)), "telemetry", ["event_type"])


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    return streams.completed(streams.tumbling(streams.event_stream(spark, sf_dir)), "tumbling", ["start", "event_type"])


@query("WITH h AS (SELECT date_trunc('hour', ts) AS start FROM events UNION ALL SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR FROM events) SELECT start, count(*) AS n FROM h GROUP BY 1")
def stream_sliding(spark, sf_dir):
    return streams.completed(streams.sliding(streams.event_stream(spark, sf_dir)), "sliding", ["start"])


@query("""WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w > INTERVAL 6 HOUR, true)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, sf_dir):
    return streams.completed(streams.sessions(streams.event_stream(spark, sf_dir)), "sessions", ["user_id", "start"], mode="complete")


@query("SELECT DISTINCT event_id, event_type FROM events")
def stream_idempotent_enqueue(spark, sf_dir):
    e = streams.event_stream(spark, sf_dir)
    twice = e.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return streams.finished(streams.deduplicated(twice, ["event_id"]).select("event_id", "event_type"), "dedup")


@query("""WITH t AS (SELECT user_id, min(event_id) AS last FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT e.user_id, event_id, row_number() OVER (PARTITION BY e.user_id ORDER BY event_id) AS sequence, event_type = 'error' AS terminal FROM events e LEFT JOIN t USING (user_id) WHERE event_id <= coalesce(last, event_id)""")
def stream_sequence(spark, sf_dir):
    return streams.finished(streams.sequenced(streams.event_stream(spark, sf_dir)), "sequence")


@query(SQL["outbox_drain"])
def stream_outbox_drain(spark, sf_dir):
    store = Store(spark, new_path(spark, "outbox-store"))
    store.commit({"records": _records(spark, sf_dir)})
    e = streams.event_stream(spark, sf_dir).select("event_id", F.col("user_id").alias("record_id"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("operation"), "value")
    return streams.drain_outbox(e, store, "records")


@query("""SELECT event_id, 'id: ' || event_id || chr(10) || 'event: ' || event_type || chr(10) || 'data: {"event_type":"' || event_type || '","user_id":' || user_id || '}' || chr(10) || chr(10) AS frame FROM events""")
def sse_frames(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", F.lit(None).cast("double").alias("value"))
    return streams.sse(e)


@query("SELECT user_id, event_id, event_type FROM events WHERE event_id > 500")
def event_replay(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_id > 500").select("user_id", "event_id", "event_type")


@query("SELECT user_id, count(*) AS n, string_agg(event_type, ',' ORDER BY event_id) AS history FROM events GROUP BY 1")
def event_history(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("h"))
    return e.select("user_id", F.size("h").alias("n"), F.array_join(F.transform("h", lambda x: x["event_type"]), ",").alias("history"))


# ---- flows

VOCABULARY = ["idiot", "licensed", "the", "que", "der"]


def _ingested(spark, sf_dir):
    store = Store(spark, new_path(spark, "flow-store"))
    changes = flows.ingest(store, flows.corpus_markdown(table(spark, sf_dir, "documents")), ports.FakeEmbedder(), ports.FakeTagger(VOCABULARY))
    return store, changes


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), k AS (SELECT doc_id, count(*) AS n FROM l WHERE trim(line) <> '' GROUP BY 1)
SELECT 'doc-' || doc_id AS document_ref, 'new' AS change, n FROM k""")
def ingest_flow(spark, sf_dir):
    """Ingest all documents into an empty store: the changes by document."""
    _, changes = _ingested(spark, sf_dir)
    return changes.groupBy("document_ref", "change").agg(F.count("*").alias("n"))


@query()
def retrieval_flow(spark, sf_dir):
    """Ingest, then the bounded context of one question."""
    store, _ = _ingested(spark, sf_dir)
    question = "Licensed under the Apache License"
    return flows.retrieve(store, question, ports.FakeEmbedder()([question])[0])


# ---- records


def _index_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as chunks; returned lines carry tags."""
    d = table(spark, sf_dir, "documents")
    none = F.expr("cast(array() as array<string>)")
    return d.select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), F.col("source").alias("document_ref"), F.lit("s1").alias("source_version"), F.col("text").alias("search_text"), F.when(F.col("doc_id") % 3 > 0, (F.col("doc_id") % 3).cast("int")).alias("page_start"), F.lit(None).cast("int").alias("page_end"), F.col("lang").alias("heading"), none.alias("heading_path"), F.array("lang").alias("tags"), "doc_id")


@query("SELECT 'c' || doc_id AS chunk_id, 'knowledge://' || source || '/c' || doc_id AS source_ref, sha256(text) AS content_hash, CASE WHEN doc_id % 3 > 0 THEN doc_id % 3 ELSE -1 END AS page_start, -1 AS page_end, lang AS heading, lang AS tags FROM documents")
def knowledge_rows(spark, sf_dir):
    return records.knowledge(_index_chunks(spark, sf_dir)).select("chunk_id", "source_ref", "content_hash", "page_start", "page_end", F.array_join("heading_path", "/").alias("heading"), F.array_join("tags", ",").alias("tags"))


@query("SELECT 'c' || doc_id AS chunk_id, 'document_ref' AS field FROM documents WHERE source <> 'src0' UNION ALL SELECT 'c' || doc_id, 'heading' FROM documents WHERE lang <> 'en'")
def scope_violations(spark, sf_dir):
    return records.scope_violations(_index_chunks(spark, sf_dir), "chunk_id", {"document_ref": "src0", "heading": "en"})


@query("SELECT event_id, user_id AS record_id FROM events WHERE event_type = 'error' OR event_type = 'view' OR user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def allowed_events(spark, sf_dir):
    e = _outbox(spark, sf_dir).withColumn("collection", F.when(F.col("run_id") == "view", "concept_catalog").otherwise("document_chunks"))
    allowed = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("chunk_id"))
    return records.allowed_events(e, allowed).select("event_id", "record_id")


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'view')")
def appended_duplicates(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return records.appended(e, e.where("event_type IN ('click', 'view')"))[1]


@query("SELECT doc_id, 'images/' || doc_id || '.png' AS refs, 'image unavailable' AS errors FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'images/' || doc_id || '.png,b.png', '' FROM documents WHERE doc_id % 2 = 1")
def safe_images(spark, sf_dir):
    good = F.concat(F.lit("images/"), F.col("doc_id").cast("string"), F.lit(".png"))
    refs = F.when(F.col("doc_id") % 2 == 0, F.array(good, F.lit("../up.png"), good)).otherwise(F.array(good, F.lit("b.png")))
    x = records.safe_images(table(spark, sf_dir, "documents").select("doc_id", refs.alias("refs")), "refs")
    return x.select("doc_id", F.array_join("refs", ",").alias("refs"), F.array_join("image_errors", ",").alias("errors"))


@query("SELECT doc_id, lang = 'en' AS web, lang = 'de' AS image FROM documents")
def intents(spark, sf_dir):
    q = F.when(F.col("lang") == "en", F.lit("Please SEARCH the web for it")).when(F.col("lang") == "de", F.lit("Show me the Figure of it")).when(F.col("lang") == "fr", F.lit("webs of search, figures shown")).otherwise(F.lit("tra web?? no: tratra mạng; image only"))
    q = F.when(F.col("lang") == "es", F.lit("an image only; the websearch is")).otherwise(q)
    return table(spark, sf_dir, "documents").select("doc_id", records.wants_web(q).alias("web"), records.wants_image(q).alias("image"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem l WHERE l_returnflag = 'A' AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_returnflag = 'R' AND r.l_orderkey = l.l_orderkey AND r.l_linenumber = l.l_linenumber)")
def attached_images(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    x = li.withColumn("image_refs", F.when(F.col("l_returnflag") == "A", F.array(F.lit("a.png"))).otherwise(F.expr("cast(array() as array<string>)")))
    selected = li.where("l_returnflag = 'R'").select(F.lit(0).alias("q"), F.col("l_orderkey").alias("chunk_id"), F.struct("l_orderkey", "l_linenumber").alias("paragraph_ref"))
    paras = x.select(F.lit(0).alias("q"), F.col("l_orderkey").alias("chunk_id"), F.struct("l_orderkey", "l_linenumber").alias("paragraph_ref"), "image_refs", "l_orderkey", "l_linenumber", "l_partkey")
    return records.attached_images(selected, paras, ["q"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT user_id, event_type AS chunk_id, min(event_id) AS rank FROM events GROUP BY ALL")
def best_ranks(spark, sf_dir):
    hits = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("chunk_id"), F.col("event_id").alias("rank"))
    return records.best_ranks(hits, ["user_id"])


@query("SELECT l_orderkey AS chunk_id, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') GROUP BY 1")
def relations_in_scope(spark, sf_dir):
    hits = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("chunk_id"))
    inside, _ = records.in_hit_chunks(facts(spark, sf_dir), hits)
    return inside.groupBy("chunk_id").agg(F.count("*").alias("n"))


@query("WITH f AS (SELECT user_id, event_type, min(event_id) AS r FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, ',' ORDER BY r) AS sources FROM f GROUP BY 1")
def distinct_sources(spark, sf_dir):
    hits = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("source_ref"), F.col("event_id").alias("rank"))
    return records.distinct_sources(hits, ["user_id"]).select("user_id", F.array_join("sources", ",").alias("sources"))


@query("WITH p AS (SELECT user_id, (event_id % 5)::VARCHAR AS page, min(event_id) AS r FROM events GROUP BY ALL) SELECT user_id, string_agg(page, ',' ORDER BY r) AS pages FROM p GROUP BY 1")
def collected_pages(spark, sf_dir):
    p = table(spark, sf_dir, "events").select("user_id", "event_id", F.array((F.col("event_id") % 5).cast("string")).alias("pages"))
    return records.collected_pages(p, ["user_id"], ["event_id"]).select("user_id", F.array_join("pages", ",").alias("pages"))


@query("SELECT doc_id, 'see [2] and [1] in ' || lang AS answer FROM documents")
def answer_relabelled(spark, sf_dir):
    a = F.concat(F.lit("see chunk-1:p10 and chunk-1:p1 in "), F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", records.relabelled(a, ["chunk-1:p1", "chunk-1:p10"]).alias("answer"))


@query("""WITH a AS (SELECT l_orderkey AS chunk_id, l_linenumber, 'p' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS alias FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))
SELECT chunk_id, alias, l_orderkey || '-' || l_linenumber AS paragraph_id FROM (SELECT *, chunk_id AS l_orderkey FROM a) WHERE alias IN ('p1', 'p2')""")
def restored_aliases(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").alias("ordinal"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("paragraph_id")).distinct()
    known = records.aliases(p)
    answers = known.where("alias IN ('p1', 'p2')").select("chunk_id", "alias")
    return records.restored_aliases(answers, known)[0].select("chunk_id", "alias", "paragraph_id")


@query("SELECT l_orderkey, l_linenumber, 'missing' AS side FROM lineitem WHERE l_returnflag = 'R'")
def relation_differences(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return records.relation_differences(li.select("l_orderkey", "l_linenumber"), li.where("l_returnflag <> 'R'").select("l_orderkey", "l_linenumber"))


@query("""WITH r AS (SELECT user_id AS d, min(event_id) AS run, arg_min(event_type, event_id) AS t FROM events GROUP BY 1),
q AS (SELECT run AS run_id, d AS document_ref FROM r UNION ALL SELECT max(event_id) + 1000000, user_id FROM events GROUP BY user_id)
SELECT q.run_id, CASE WHEN k.run IS NOT NULL AND k.t = 'error' THEN 'resumed' WHEN k.run IS NOT NULL THEN 'same' WHEN a.t IN ('view', 'click') THEN 'busy' WHEN a.run IS NOT NULL THEN 'busy' ELSE 'started' END AS outcome
FROM q LEFT JOIN r k ON k.run = q.run_id LEFT JOIN r a ON a.d = q.document_ref""")
def run_start(spark, sf_dir):
    """Known runs are asked for again, and a further run of each document is refused in the same batch."""
    e = table(spark, sf_dir, "events")
    first = e.groupBy(F.col("user_id").alias("document_ref")).agg(F.min("event_id").alias("run_id"), F.min_by("event_type", "event_id").alias("t"), F.max("event_id").alias("last"))
    runs = first.select("run_id", "document_ref", F.lit("s1").alias("source_version"), F.when(F.col("t").isin("view", "click"), "processing").when(F.col("t") == "error", "failed").otherwise("ready").alias("status"))
    asked = runs.select("run_id", "document_ref", "source_version").unionByName(first.select((F.col("last") + 1000000).alias("run_id"), "document_ref", F.lit("s1").alias("source_version")))
    return records.started(asked, runs).select("run_id", "outcome")


@query("SELECT doc_id AS document_ref, 'v' || quality AS previous_version FROM labels WHERE quality <> toxic")
def previous_versions(spark, sf_dir):
    l = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_ref"), F.concat(F.lit("v"), F.col("quality").cast("string")).alias("active_version"), F.concat(F.lit("v"), F.col("toxic").cast("string")).alias("source_version"))
    return records.previous_versions(l.select("document_ref", "active_version"), l.select("document_ref", "source_version"))


@query("SELECT event_id AS token FROM events WHERE ts + INTERVAL 1 HOUR * 24 > TIMESTAMP '2024-01-30 00:00:00' AND ts <= TIMESTAMP '2024-01-30 00:00:00' ORDER BY ts DESC, event_id DESC LIMIT 256")
def live_candidates(spark, sf_dir):
    now = F.to_timestamp(F.lit("2024-01-30 00:00:00"))
    saved_sets = table(spark, sf_dir, "events").select(F.col("event_id").alias("token"), F.col("ts").cast("timestamp").alias("saved_at"), F.lit(86400).alias("ttl_seconds")).where(F.col("saved_at") <= now)
    return records.live_candidates(saved_sets, now).select("token")


@query("""SELECT conv_id, md5('Use the following evidence records as the complete source:' || chr(10) || string_agg('- evidence_id: e' || turn || chr(10) || '  citation_label: [' || turn + 1 || ']' || chr(10) || '  source_type: document' || chr(10) || '  source: ' || role || chr(10) || '  scope: chunk=c' || conv_id || ', page=' || turn || chr(10) || '  image_refs: ' || CASE turn % 3 WHEN 0 THEN 'none' WHEN 1 THEN role || '.png' ELSE role || '.png, img/' || turn || '.jpg' END || chr(10) || '  text: ' || text, chr(10) ORDER BY turn)) AS text_md5 FROM conversations GROUP BY 1""")
def rendered_evidence(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    null = F.lit(None).cast("string")
    images = F.slice(F.array(F.concat("role", F.lit(".png")), F.concat(F.lit("img/"), F.col("turn").cast("string"), F.lit(".jpg"))), F.lit(1), (F.col("turn") % 3).cast("int"))
    rows = c.select("conv_id", "turn", F.concat(F.lit("e"), F.col("turn").cast("string")).alias("evidence_id"), F.lit("document").alias("kind"), F.col("role").alias("source"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("chunk"), null.alias("paragraph"), F.col("turn").alias("page"), null.alias("url"), images.alias("image_refs"), "text")
    return records.rendered_evidence(rows, ["conv_id"], "turn").select("conv_id", F.md5("text").alias("text_md5"))


@query("SELECT conv_id, substr(sha256(string_agg('p' || turn, chr(10) ORDER BY turn)), 1, 16) AS bundle FROM conversations GROUP BY 1")
def evidence_bundle(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("turn")), lambda x: F.concat(F.lit("p"), x.cast("string"))).alias("refs"))
    return c.select("conv_id", ids.bundle_ref(F.col("refs")).alias("bundle"))


@query("SELECT doc_id, 'concept::' || sha256(lang) AS record_id, 'embed-' || sha256(concat_ws(chr(10), 'm', source, lang)) AS embed_key, sha256('{\"a\":\"' || lang || '\",\"b\":' || doc_id || ',\"c\":null}') AS input_hash FROM documents")
def record_ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    payload = F.struct(F.col("lang").alias("a"), F.col("doc_id").alias("b"), F.lit(None).cast("string").alias("c"))
    return d.select("doc_id", ids.concept_record_id(F.col("lang")).alias("record_id"), ids.embedding_key(F.lit("m"), F.col("source"), F.col("lang")).alias("embed_key"), ids.input_hash(payload).alias("input_hash"))


@query()
def vector_event_ids(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    body = F.to_json(F.struct(F.col("label").alias("label"), F.col("vec_id").alias("record_id")))
    return e.select("vec_id", ids.vector_event_id(F.lit("upsert-"), body, F.col("embedding")).alias("event_id"))


# ---- bundles and answers


@query("""WITH h AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events WHERE event_type <> 'error'),
b AS (SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY rank) AS refs, count(*) AS n FROM h GROUP BY 1), f AS (SELECT user_id, event_type, min(rank) AS r FROM h GROUP BY ALL), i AS (SELECT user_id, string_agg(event_type, ',' ORDER BY r) AS images FROM f GROUP BY 1)
SELECT c_custkey AS query_id, CASE WHEN refs IS NULL THEN 'no matching evidence' ELSE 'ready' END AS status, coalesce(md5(refs), md5('')) AS refs_md5, coalesce(images, '') AS images FROM customer LEFT JOIN b ON b.user_id = c_custkey LEFT JOIN i ON i.user_id = c_custkey""")
def evidence_bundles(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    e = table(spark, sf_dir, "events").where("event_type <> 'error'")
    hits = e.select(F.col("user_id").alias("query_id"), rank.alias("rank"), F.col("event_id").cast("string").alias("chunk_ref"), F.lit("v1").alias("version"), F.col("props").alias("text"), F.array("event_type").alias("image_refs"))
    b = answers.evidence_bundles(hits, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id")))
    return b.select("query_id", "status", F.md5(F.array_join("selected_refs", ",")).alias("refs_md5"), F.array_join("image_refs", ",").alias("images"))


@query("""WITH h AS (SELECT user_id, count(*) AS hits, greatest(0.0, least(1.0, max(value / 100))) AS confidence, '0' AS hp FROM events GROUP BY 1), p AS (SELECT user_id, (event_id % 3)::VARCHAR AS page, min(event_id) AS r FROM events WHERE event_type = 'view' AND user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') GROUP BY ALL),
g AS (SELECT user_id, string_agg(page, ',' ORDER BY r) AS pages FROM p GROUP BY 1), n AS (SELECT user_id, count(*) AS paragraphs FROM events WHERE event_type = 'view' AND user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') GROUP BY 1)
SELECT c_custkey AS query_id, coalesce(hits, 0) AS hits, coalesce(paragraphs, 0) AS paragraphs, round(confidence, 6) AS confidence, coalesce(pages, hp, '') AS pages, CASE WHEN hits IS NULL THEN 'no_hits' WHEN paragraphs IS NULL THEN 'no_context' ELSE 'ready' END AS status
FROM customer LEFT JOIN h ON h.user_id = c_custkey LEFT JOIN g ON g.user_id = c_custkey LEFT JOIN n ON n.user_id = c_custkey""")
def document_searches(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("query_id", F.col("user_id"))
    null = F.lit(None).cast("double")
    hits = e.select("query_id", F.col("event_id").alias("rank"), null.alias("fused_score"), (F.col("value") / 100).alias("semantic_score"), null.alias("keyword_score"), F.array(F.lit("0")).alias("pages"))
    told = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("query_id"))
    paras = e.where("event_type = 'view'").join(told, "query_id", "left_semi").select("query_id", F.col("event_id").alias("place"), F.array((F.col("event_id") % 3).cast("string")).alias("pages"))
    d = answers.document_searches(hits, paras, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id")))
    return d.select("query_id", "hits", "paragraphs", F.round("confidence", 6).alias("confidence"), F.array_join("pages", ",").alias("pages"), "status")


@query("""SELECT conv_id AS query_id, md5('# Retrieval Context' || chr(10) || chr(10) || '## User question' || chr(10) || chr(10) || 'Why?' || chr(10) || chr(10) || '## Concept-role map' || chr(10) || chr(10) || '## Source paragraphs' || chr(10) || chr(10) ||
string_agg('### [' || (turn + 1) || ']' || chr(10) || chr(10) || '- Source: conv' || chr(10) || '- Parent header: ' || role || chr(10) || '- Pages: ' || turn || chr(10) || '- Concepts and roles: ' || role || chr(10) || '- Images: none' || chr(10) || chr(10) || text || chr(10), chr(10) ORDER BY turn)) AS markdown_md5 FROM conversations GROUP BY 1""")
def answer_context(spark, sf_dir):
    none = F.expr("cast(array() as array<string>)")
    p = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("place"), F.lit("conv").alias("source"), F.col("role").alias("header"), none.alias("nested"), F.array(F.col("turn").cast("string")).alias("pages"), F.array("role").alias("labels"), none.alias("image_refs"), "text")
    return answers.answer_context("Why?", p).select("query_id", F.md5("markdown").alias("markdown_md5"))


@query("""WITH o AS (SELECT user_id, floor(value)::BIGINT AS id, min(event_id) AS pos FROM events WHERE event_type = 'click' OR (event_type = 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'click')) GROUP BY ALL)
SELECT o.user_id AS run_id, o.id AS evidence_id, o.pos, d.source, CASE WHEN d.lang = 'en' THEN 'i' || d.doc_id ELSE '' END AS images FROM o JOIN documents d ON d.doc_id = o.id""")
def cited_sources(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("pos"), F.floor("value").alias("evidence_id"), "event_type", F.lit("[1]").alias("label"))
    d = table(spark, sf_dir, "documents")
    used_ids = e.select("run_id", "evidence_id").distinct()
    ev = used_ids.join(d.select(F.col("doc_id").alias("evidence_id"), F.col("source").alias("source_ref"), F.lit(None).cast("string").alias("url"), F.array(F.concat(F.lit("i"), F.col("doc_id").cast("string"))).alias("image_refs"), "lang"), "evidence_id")
    shown = ev.where("lang = 'en'").select("run_id", "evidence_id")
    out = answers.cited_sources(e.where("event_type = 'click'"), e.where("event_type = 'view'"), ev.drop("lang"), shown)
    return out.select("run_id", "evidence_id", "pos", "source", F.array_join("image_refs", ",").alias("images"))


@query(_CATALOG + """, g AS (SELECT normalized_label, min(canonical_label) AS c FROM catalog GROUP BY 1), e AS (SELECT DISTINCT normalized_label, header, excerpt FROM r WHERE r <= 3),
x AS (SELECT *, row_number() OVER (PARTITION BY normalized_label ORDER BY header, excerpt) AS k FROM e), s AS (SELECT normalized_label, string_agg(header || ': ' || excerpt, chr(10) ORDER BY k) AS t FROM x WHERE k <= 3 GROUP BY 1)
SELECT 'concept::' || sha256(normalized_label) AS record_id, c || chr(10) || t AS search_text, sha256(c || chr(10) || t) AS input_hash FROM g JOIN s USING (normalized_label)""")
def concept_records(spark, sf_dir):
    return answers.concept_records(concepts.global_catalog(_observations(spark, sf_dir)), "profile-1", "v1").select("record_id", "search_text", "input_hash")


@query("WITH l AS (SELECT user_id AS run_id, arg_max(event_type, event_id) AS t, max(event_id) AS s FROM events GROUP BY 1) SELECT run_id, s + 1 AS sequence, 'run_failed' AS type FROM l WHERE t NOT IN ('error', 'purchase')")
def run_cancel(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "run_failed").when(F.col("event_type") == "purchase", "run_completed").otherwise(F.col("event_type"))
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("sequence"), kind.alias("type"))
    return answers.cancelled(log, log).select("run_id", "sequence", "type")


@query("""WITH RECURSIVE t AS (SELECT user_id, event_id, event_type AS tool, (props->>'$.k')::BIGINT AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
s AS (SELECT DISTINCT user_id, NULL::BIGINT AS event_id, 0::BIGINT AS i, 0::BIGINT AS used, 0 AS views, 0 AS clicks, false AS ok FROM t UNION ALL
SELECT user_id, event_id, i, used + CASE WHEN free THEN k ELSE 0 END, views + (free AND tool = 'view')::INT, clicks + (free AND tool = 'click')::INT, free
FROM (SELECT t.*, s.used, s.views, s.clicks, s.used + t.k <= 300 AND (t.tool <> 'view' OR s.views < 3) AND (t.tool <> 'click' OR s.clicks < 2) AS free FROM s JOIN t ON t.user_id = s.user_id AND t.i = s.i + 1))
SELECT user_id, event_id, ok AS admitted FROM s WHERE i > 0""")
def budget_fold(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("tool"), F.get_json_object("props", "$.k").cast("long").alias("tokens"))
    return answers.admitted_calls(calls, "user_id", "event_id", {"view": 3, "click": 2}, 300)


@query("SELECT DISTINCT tag FROM (SELECT lang AS tag FROM documents UNION ALL SELECT source FROM documents UNION ALL SELECT p_type FROM part) ORDER BY 1")
def tag_catalog(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return answers.tag_catalog(d.select(F.col("lang").alias("tag")), d.select(F.col("source").alias("tag")), table(spark, sf_dir, "part").select(F.col("p_type").alias("tag")))


@query("SELECT source, count(*) FILTER (quality = 1) AS durable, count(*) FILTER (quality = 0) AS left, sum(CASE WHEN quality = 1 THEN 2 ELSE 0 END)::BIGINT AS paragraphs, sum(CASE WHEN quality = 1 THEN toxic ELSE 0 END)::BIGINT AS failed, count(*) FILTER (quality = 0) = 0 AS complete FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def checkpoint_report(spark, sf_dir):
    x = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return answers.checkpoint_report(x.select("source", (F.col("quality") == 1).alias("durable"), F.lit(2).cast("long").alias("paragraphs"), F.col("toxic").cast("long").alias("failed")), ["source"])
