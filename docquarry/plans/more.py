"""Queries of ingest, sources and checks over the standard tables, each with its SQL where SQL expresses it."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry import ports
from docquarry.functions import text as T
from docquarry.operators import answers, concepts, ingest, outbox, records, scan, search, segment, state
from docquarry.operators.term_index import TermIndex
from docquarry.operators.vector_lists import VectorLists
from docquarry.plans import flows, incremental
from docquarry.plans.queries import _CATALOG, _DIST, _FACTS, _observations, _query_vector, _states as _vector_states, facts, query
from docquarry.session import new_path, saved, table
from docquarry.sources import artifacts, files
from docquarry.sources.store import Store


def _none():
    return F.lit(None).cast("string")



# ---- vector states


def _chunk_records(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("c"), F.floor(F.col("doc_id") / 2).cast("string")).alias("chunk_id"), F.concat_ws("-", "source", (F.col("doc_id") % 11).cast("string")).alias("document_ref"), F.col("lang").alias("source_version"), F.col("text").alias("search_text"), F.lit("m1").alias("embedding_profile"), F.lit(8).alias("dimensions"))


@query("SELECT 'c' || doc_id // 2 AS entity_key, source || '-' || doc_id % 11 AS document_ref, lang AS source_version, sha256(text) AS input_hash, 'document_chunks' AS collection, 'v1' AS index_version, 8 AS dimensions FROM documents")
def chunk_states(spark, sf_dir):
    states, _ = ingest.chunk_states(_chunk_records(spark, sf_dir), " v1 ")
    return states.select("entity_key", "document_ref", "source_version", "input_hash", "collection", "index_version", "dimensions")


@query("""SELECT 'c' || doc_id // 2 AS key, 'repeated chunk' AS rule FROM documents GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT source || '-' || doc_id % 11, 'several versions' FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1""")
def chunk_state_violations(spark, sf_dir):
    return ingest.chunk_states(_chunk_records(spark, sf_dir), "v1")[1]


def _concept_records(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    key = F.lower("p_name")
    return p.select(key.alias("normalized_label"), F.concat(F.lit("concept::"), F.sha2(key, 256)).alias("record_id"), F.sha2("p_type", 256).alias("input_hash"), F.lit("m1").alias("model"), F.lit(8).alias("dimensions"), F.when(F.col("p_size") % 7 == 0, "v0").otherwise("v1").alias("index_version"), F.col("p_type").alias("search_text"), F.array(F.col("p_size").cast("double"), F.lit(0.5)).alias("embedding"))


@query("SELECT lower(p_name) AS entity_key, 'concept::' || sha256(lower(p_name)) AS record_id, sha256(p_type) AS input_hash, 'concept_catalog' AS collection, NULL::VARCHAR AS document_ref FROM part")
def concept_states(spark, sf_dir):
    return ingest.concept_states(_concept_records(spark, sf_dir), "v1")[0].select("entity_key", "record_id", "input_hash", "collection", "document_ref")


@query("SELECT lower(p_name) AS key, 'repeated label' AS rule FROM part GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT lower(p_name), 'other index version' FROM part WHERE p_size % 7 = 0")
def concept_state_violations(spark, sf_dir):
    return ingest.concept_states(_concept_records(spark, sf_dir), "v1")[1]


@query()
def concept_upserts(spark, sf_dir):
    """Ids depend on how Python prints numbers, which SQL does not."""
    return ingest.concept_upserts(_concept_records(spark, sf_dir), "catalog-1", "7", "run-1").select("event_id", "record_id", "payload")


def _states(df, key, document, hash_, synced):
    return df.select(F.lit("chunk").alias("entity_type"), key.alias("entity_key"), F.lit("document_chunks").alias("collection"), F.concat(F.lit("r-"), key).alias("record_id"), F.lit("v1").alias("index_version"), document.alias("document_ref"), hash_.alias("input_hash"), synced.alias("sync_status"))


def _marked(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = _states(d.where("doc_id % 3 > 0"), F.col("doc_id").cast("string"), F.col("source"), F.md5("text"), F.when(F.col("doc_id") % 2 == 0, "synced").otherwise("pending"))
    done = _states(d.join(l, "doc_id"), F.col("doc_id").cast("string"), F.when(F.col("toxic") == 1, "moved").otherwise(F.col("source")), F.sha2("text", 256), F.lit("pending"))
    return ingest.mark_synced(known, done)


_MARK = """WITH k AS (SELECT doc_id, source AS ref, md5(text) AS h, CASE WHEN doc_id % 2 = 0 THEN 'synced' ELSE 'pending' END AS s FROM documents WHERE doc_id % 3 > 0),
n AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'moved' ELSE source END AS ref, sha256(text) AS h FROM documents JOIN labels USING (doc_id)),
bad AS (SELECT n.* FROM n JOIN k USING (doc_id) WHERE n.ref <> k.ref), good AS (SELECT * FROM n WHERE doc_id NOT IN (SELECT doc_id FROM bad))"""


@query(_MARK + " SELECT doc_id::VARCHAR AS entity_key, h AS input_hash, ref AS document_ref, 'synced' AS sync_status FROM good UNION ALL SELECT doc_id::VARCHAR, h, ref, s FROM k WHERE doc_id NOT IN (SELECT doc_id FROM good)")
def states_marked(spark, sf_dir):
    return _marked(spark, sf_dir)[0].select("entity_key", "input_hash", "document_ref", "sync_status")


@query(_MARK + " SELECT doc_id::VARCHAR AS entity_key, ref AS document_ref FROM bad")
def states_refused(spark, sf_dir):
    return _marked(spark, sf_dir)[1].select("entity_key", "document_ref")


@query("SELECT doc_id::VARCHAR AS entity_key, source AS document_ref FROM documents WHERE doc_id % 2 = 0 AND source = 'src2'")
def states_listing(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    own = _states(d, F.col("doc_id").cast("string"), F.col("source"), F.md5("text"), F.when(F.col("doc_id") % 2 == 0, "synced").otherwise("pending"))
    return ingest.synced(own, "chunk", "document_chunks", "v1", "src2").select("entity_key", "document_ref")


@query("SELECT event_id, row_number() OVER (ORDER BY event_type, user_id::VARCHAR, event_id::VARCHAR) AS place FROM events")
def stale_order(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("entity_type"), F.lit("c").alias("collection"), F.lit("v1").alias("index_version"), F.col("user_id").cast("string").alias("record_id"), F.col("event_id").cast("string").alias("entity_key"))
    return scan.numbered(e, [F.col(c) for c in ingest.STALE_ORDER], "place").select("event_id", (F.col("place") + 1).alias("place"))


@query(f"WITH {_FACTS} SELECT paragraph_id, concept, role FROM facts WHERE document_ref = 'doc-1'")
def relations_listing(spark, sf_dir):
    return ingest.relations_of(facts(spark, sf_dir), "doc-1")


@query(f"WITH {_FACTS} SELECT DISTINCT chunk_id FROM facts WHERE document_ref = 'doc-2'")
def chunk_ids_listing(spark, sf_dir):
    return ingest.chunk_ids_of(facts(spark, sf_dir), "doc-2").distinct()


# ---- outbox


_PAYLOAD = """'{"record":{"chunk_id":"c' || CASE WHEN doc_id % 5 = 1 THEN 'x' ELSE '' END || doc_id || '","document_ref":"' || source || '","source_version":"s1","search_text":"' || lang || '",' || CASE WHEN doc_id % 5 = 2 THEN '' ELSE '"embedding":[' || doc_id % 9 || ',0.5],' END || '"embedding_profile":"m1","access_scope":"public","metadata":{"heading":"h"}}}'"""


def _outbox_events(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.format_string("e%09d", "doc_id").alias("event_id"), F.col("source").alias("run_id"), F.when(F.col("doc_id") % 5 == 3, "other").otherwise("document_chunks").alias("collection"), F.when(F.col("doc_id") % 5 == 4, "delete").otherwise("upsert").alias("operation"),
        F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("record_id"), F.col("source").alias("document_ref"), F.expr(_PAYLOAD).alias("payload"), F.when(F.col("doc_id") % 4 == 0, "done").otherwise("pending").alias("status"), F.lit(0).alias("attempts"), _none().alias("last_error"),
    )


_ERROR = f"CASE doc_id % 5 WHEN 1 THEN '{ingest.MISMATCH}' WHEN 2 THEN '{ingest.INVALID}' WHEN 3 THEN '{ingest.UNSUPPORTED}' END"


@query(f"SELECT 'e' || lpad(doc_id::VARCHAR, 9, '0') AS event_id, {_ERROR} AS error, CASE WHEN doc_id % 5 <> 2 THEN doc_id % 9 + 0.5 END::DOUBLE AS sum FROM documents")
def outbox_decoded(spark, sf_dir):
    x = ingest.decoded(_outbox_events(spark, sf_dir))
    return x.select("event_id", "error", F.aggregate("record.embedding", F.lit(0.0), lambda a, b: a + b).alias("sum"))


_BATCH = f"WITH b AS (SELECT *, {_ERROR} AS error FROM documents WHERE doc_id % 4 > 0 AND source = 'src2' ORDER BY doc_id LIMIT 40)"


@query(_BATCH + " SELECT count(*) FILTER (error IS NULL) AS succeeded, count(*) FILTER (error IS NOT NULL) AS failed FROM b")
def outbox_sync_counts(spark, sf_dir):
    return ingest.sync_pending(_outbox_events(spark, sf_dir), _index(spark, sf_dir), 40, "src2")[2]


def _index(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("doc_id % 5 = 4 OR doc_id % 10 = 0")
    return d.select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("record_id"), F.col("source").alias("document_ref"), F.lit("old").alias("search_text"), F.array(F.lit(1.0)).alias("embedding"))


@query(_BATCH + """ SELECT 'c' || doc_id AS record_id, source AS document_ref, lang AS search_text FROM b WHERE error IS NULL AND doc_id % 5 <> 4
UNION ALL SELECT 'c' || doc_id, source, 'old' FROM documents WHERE (doc_id % 5 = 4 OR doc_id % 10 = 0) AND doc_id NOT IN (SELECT doc_id FROM b WHERE error IS NULL)""")
def outbox_sync_index(spark, sf_dir):
    return ingest.sync_pending(_outbox_events(spark, sf_dir), _index(spark, sf_dir), 40, "src2")[1].select("record_id", "document_ref", "search_text")


@query(_BATCH + """ SELECT 'e' || lpad(d.doc_id::VARCHAR, 9, '0') AS event_id, CASE WHEN b.doc_id IS NULL THEN CASE WHEN d.doc_id % 4 = 0 THEN 'done' ELSE 'pending' END WHEN b.error IS NULL THEN 'done' ELSE 'failed' END AS status,
(b.error IS NOT NULL)::INT AS attempts, b.error AS last_error FROM documents d LEFT JOIN b USING (doc_id)""")
def outbox_sync_states(spark, sf_dir):
    return ingest.sync_pending(_outbox_events(spark, sf_dir), _index(spark, sf_dir), 40, "src2")[0].select("event_id", "status", "attempts", "last_error")


@query("""WITH a AS (SELECT user_id AS chunk_id, event_id AS pos, 'e' || event_id AS event_id, CASE event_type WHEN 'view' THEN 0 ELSE 1 END AS l FROM events WHERE event_type IN ('view', 'click'))
SELECT chunk_id, event_id, row_number() OVER (PARTITION BY chunk_id ORDER BY l, pos)::INT AS place FROM a""")
def events_merged(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("chunk_id"), F.col("event_id").alias("pos"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("event_id"), "event_type")
    return ingest.merged_events(e.where("event_type = 'view'"), e.where("event_type = 'click'"))[0]


@query("SELECT 'e' || event_id // 2 AS event_id FROM events WHERE event_type IN ('view', 'click') GROUP BY 1 HAVING count(*) > 1")
def events_merged_twice(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("chunk_id"), F.col("event_id").alias("pos"), F.concat(F.lit("e"), F.floor(F.col("event_id") / 2).cast("string")).alias("event_id"), "event_type")
    return ingest.merged_events(e.where("event_type = 'view'"), e.where("event_type = 'click'"))[1]


# ---- reservations, runs, budgets


def _closed(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ledger = d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "ready").otherwise("processing").alias("status"), F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("token"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("result"))
    claims = d.join(l, "doc_id").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "thief").otherwise(F.col("source")).alias("token"), F.when(F.col("quality") == 1, "ready").otherwise("failed").alias("outcome"), F.md5("text").alias("result"))
    return ingest.closed(ledger, claims, ["doc_id"])


_CLOSE = "WITH c AS (SELECT d.*, quality, md5(text) AS h, doc_id % 3 > 0 AND doc_id % 5 > 0 AND quality IS NOT NULL AS owned FROM documents d LEFT JOIN labels USING (doc_id))"


@query(_CLOSE + """ SELECT doc_id, CASE WHEN owned THEN CASE WHEN quality = 1 THEN 'ready' ELSE 'failed' END WHEN doc_id % 3 = 0 THEN 'ready' ELSE 'processing' END AS status, CASE WHEN NOT owned AND doc_id % 3 > 0 THEN source END AS token,
CASE WHEN owned AND quality = 1 THEN h WHEN doc_id % 3 = 0 THEN lang END AS result FROM c""")
def ledger_closed(spark, sf_dir):
    return _closed(spark, sf_dir)[0]


@query(_CLOSE + " SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'thief' ELSE source END AS token FROM c WHERE quality IS NOT NULL AND NOT owned")
def ledger_refused(spark, sf_dir):
    return _closed(spark, sf_dir)[1].select("doc_id", "token")


@query("""WITH l AS (SELECT user_id AS run_id, arg_max(event_type, event_id) AS t FROM events GROUP BY 1), r AS (SELECT c_custkey AS run_id FROM customer)
SELECT run_id, CASE WHEN t IS NULL THEN 'unknown' WHEN t IN ('purchase', 'error') THEN 'reopened' ELSE 'active' END AS outcome FROM r LEFT JOIN l USING (run_id)""")
def runs_reopened(spark, sf_dir):
    kind = F.when(F.col("event_type") == "purchase", "run_completed").when(F.col("event_type") == "error", "run_failed").otherwise(F.col("event_type"))
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("sequence"), kind.alias("type"))
    return ingest.reopened(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id")), log)


@query("SELECT event_id, CASE WHEN value > 30 THEN 'timed_out' ELSE 'done' END AS status, least(value, 30.0)::DOUBLE AS charged FROM events")
def calls_timed(spark, sf_dir):
    return ingest.timed_calls(table(spark, sf_dir, "events").select("event_id", F.col("value").alias("seconds")), 30.0).select("event_id", "status", "charged")


@query("WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) SELECT user_id, event_id FROM r WHERE n <= 2")
def hits_limited(spark, sf_dir):
    hits = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.col("event_id").alias("rank"))
    return ingest.limited_hits(hits, ["user_id", "event_type"], 2).select("user_id", "event_id")


# ---- tags


def _tags(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    p = F.col("l_orderkey").alias("paragraph_id")
    tag = F.concat(F.lit("t"), (F.col("l_partkey") % 40).cast("string"))
    generated = li.groupBy(p, tag.alias("tag")).agg(F.min("l_linenumber").alias("pos"))
    resolutions = li.where("l_linenumber < 6").select(
        p, (F.col("l_linenumber") + (F.col("l_quantity") > 45).cast("int")).alias("pos"), F.concat(F.lit(" "), tag).alias("generated_tag"), F.when(F.col("l_returnflag") == "N", F.concat(tag, F.lit(" "))).otherwise(F.lit("old")).alias("resolved_tag"),
        F.when(F.col("l_returnflag") == "N", "keep_new").when(F.col("l_returnflag") == "R", "reuse_existing").otherwise("guess").alias("action"),
    )
    existing = li.where("l_linestatus = 'O'").select(p, F.lit("old").alias("tag"))
    return generated, resolutions, existing


_TAGS = """WITH li AS (SELECT l_orderkey AS p, l_linenumber AS n, 't' || l_partkey % 40 AS tag, l_returnflag AS f, l_quantity AS q, l_linestatus AS m FROM lineitem),
g AS (SELECT p, tag, min(n) AS pos FROM li GROUP BY ALL), e AS (SELECT DISTINCT p FROM li WHERE m = 'O'),
r AS (SELECT p, tag, n + (q > 45)::INT AS place, CASE f WHEN 'N' THEN tag ELSE 'old' END AS resolved, CASE f WHEN 'N' THEN 'keep_new' WHEN 'R' THEN 'reuse_existing' ELSE 'guess' END AS action FROM li WHERE n < 6)"""


@query(_TAGS + """ SELECT p AS paragraph_id, tag, 'unknown action' AS rule FROM r WHERE action = 'guess'
UNION ALL SELECT p, tag, 'reuse without candidate' FROM r WHERE action = 'reuse_existing' AND p NOT IN (SELECT p FROM e)
UNION ALL SELECT p, tag, 'resolved twice' FROM r GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT p, tag, 'not resolved' FROM g WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.p = g.p AND r.tag = g.tag)
UNION ALL SELECT p, tag, 'out of order' FROM r JOIN g USING (p, tag) WHERE place <> pos""")
def tag_resolution_violations(spark, sf_dir):
    return ingest.resolution_violations(*_tags(spark, sf_dir))


@query(_TAGS + """, o AS (SELECT p, tag, min(resolved) AS resolved FROM r GROUP BY ALL)
SELECT p AS paragraph_id, string_agg(tag, ',' ORDER BY pos, tag) AS generated_tags, string_agg(resolved, ',' ORDER BY pos, tag) AS tags, 'completed' AS status FROM g JOIN o USING (p, tag) GROUP BY 1""")
def tags_resolved(spark, sf_dir):
    return _resolved(spark, sf_dir).select("paragraph_id", F.array_join("generated_tags", ",").alias("generated_tags"), F.array_join("tags", ",").alias("tags"), "status")


def _resolved(spark, sf_dir):
    generated, resolutions, _ = _tags(spark, sf_dir)
    one = resolutions.groupBy("paragraph_id", "generated_tag").agg(F.min("resolved_tag").alias("resolved_tag"))
    return ingest.resolved_tags(generated.select("paragraph_id").distinct(), generated, one)


@query(_TAGS + ", o AS (SELECT p, tag, min(resolved) AS resolved FROM r GROUP BY ALL) SELECT DISTINCT resolved AS tag FROM o UNION SELECT 't' || s FROM range(60) x(s) WHERE s % 7 = 0")
def tag_catalog_added(spark, sf_dir):
    tagged = _resolved(spark, sf_dir)
    catalog = spark.range(60).where("id % 7 = 0").select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("tag"))
    return ingest.persisted(tagged.select("paragraph_id", "tags").limit(0), catalog, tagged)[1]


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT 'doc-' || doc_id AS document_ref, count(*) AS chunks, '0|1|' AS runs FROM l WHERE trim(line) <> '' GROUP BY 1""")
def ingest_resumed(spark, sf_dir):
    """Ingest in two groups, stopped after the first and resumed, then begun once more: chunks by document, and the
    groups that each call did."""
    store = Store(spark, new_path(spark, "resumed-store"))
    docs = flows.corpus_markdown(table(spark, sf_dir, "documents"))
    runs = [flows.ingest_checkpointed(store, docs, ports.FakeEmbedder(), None, groups=2, stop_after=n) for n in (1, None, None)]
    return store.read("chunks").groupBy("document_ref").agg(F.count("*").alias("chunks")).withColumn("runs", F.lit("|".join(",".join(map(str, r)) for r in runs)))


# ---- chunk parts and layouts


@query("""SELECT 'doc-' || doc_id || ':s1:0:' || substr(sha256(source || chr(10) || text), 1, 16) AS chunk_id, source || CASE WHEN doc_id % 3 > 0 THEN ' (Part ' || doc_id % 3 || ' of 2)' ELSE '' END AS heading,
md5('## ' || source || CASE WHEN doc_id % 3 > 0 THEN ' (Part ' || doc_id % 3 || ' of 2)' ELSE '' END || chr(10) || chr(10) || text) AS text_md5, CASE WHEN doc_id % 3 > 0 THEN source END AS source_heading FROM documents""")
def part_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    some = F.col("doc_id") % 3 > 0
    parts = d.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("document_ref"), F.lit("s1").alias("source_version"), F.lit(0).alias("index"), F.col("source").alias("header"), F.col("text").alias("content"), F.when(some, (F.col("doc_id") % 3).cast("int")).alias("part"), F.when(some, F.lit(2)).alias("parts"))
    return ingest.part_chunks(parts).select("chunk_id", "heading", F.md5("search_text").alias("text_md5"), "source_heading")


@query("SELECT doc_id, coalesce(doc_id % 3 = 0 AND lang = 'en', false) AS raw FROM documents")
def raster_spaces(spark, sf_dir):
    space = F.struct(F.when(F.col("doc_id") % 3 == 0, "raw_pdf_raster_pixels").when(F.col("doc_id") % 3 == 1, "points").alias("name"), F.when(F.col("lang") == "en", "identity").otherwise("scale").alias("transform_to_source"))
    return table(spark, sf_dir, "documents").select("doc_id", ingest.is_raw_raster(space).alias("raw"))


# ---- questions


def _questions(spark, sf_dir):
    q = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"))
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    hits = o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("chunk_id"), F.col("o_orderkey").alias("rank"))
    f = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("paragraph_id"), F.col("l_orderkey").alias("chunk_id"), F.col("l_linestatus").alias("concept"), F.col("l_returnflag").alias("role"), F.col("l_linenumber").alias("ordinal"))
    selected = q.where("query_id % 3 > 0").select("query_id", F.lit("o").alias("concept"), F.lit("N").alias("role")).union(q.where("query_id % 2 = 0").select("query_id", F.lit(" F "), F.lit("R")))
    return q, hits, f, selected


def _texts(f):
    """Lines as paragraphs of four words."""
    return f.select("paragraph_id", "ordinal").distinct().withColumn("text", F.concat("paragraph_id", F.lit(" is one line")))


_ASKED = """WITH h AS (SELECT o_custkey AS query_id, o_orderkey AS chunk_id FROM orders WHERE o_orderstatus <> 'P'),
s AS (SELECT c_custkey AS query_id, 'O' AS c, 'N' AS r FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT c_custkey, 'F', 'R' FROM customer WHERE c_custkey % 2 = 0),
m AS (SELECT DISTINCT query_id, chunk_id, l_linenumber AS n FROM h JOIN lineitem ON l_orderkey = chunk_id JOIN s USING (query_id) WHERE l_linestatus = c AND l_returnflag = r)"""


@query(_ASKED + """ SELECT c_custkey AS query_id, CASE WHEN c_custkey NOT IN (SELECT query_id FROM h) THEN 'no_retrieval_context' WHEN c_custkey NOT IN (SELECT query_id FROM m) THEN 'no_relevant_concept_role' ELSE 'ready' END AS status FROM customer""")
def question_status(spark, sf_dir):
    q, hits, f, selected = _questions(spark, sf_dir)
    return ingest.question_bundles(q, hits, f, selected, _texts(f), 5, 12)[0]


@query(_ASKED + """, o AS (SELECT *, row_number() OVER w AS place, row_number() OVER w * 4 AS words FROM m WINDOW w AS (PARTITION BY query_id ORDER BY chunk_id, n))
SELECT query_id, chunk_id || '-' || n AS paragraph_id, place::INT AS place FROM o WHERE place <= 5 AND words <= 12""")
def question_context(spark, sf_dir):
    q, hits, f, selected = _questions(spark, sf_dir)
    return ingest.question_bundles(q, hits, f, selected, _texts(f), 5, 12)[1].select("query_id", "paragraph_id", "place")


@query(_ASKED + """, c AS (SELECT query_id, l_linestatus AS concept, l_returnflag AS role, count(DISTINCT chunk_id || '-' || l_linenumber) AS n FROM h JOIN lineitem ON l_orderkey = chunk_id GROUP BY ALL)
SELECT query_id, concept, string_agg(role || ':' || n, ',' ORDER BY role) AS roles FROM c GROUP BY 1, 2""")
def question_inventory(spark, sf_dir):
    _, hits, f, _ = _questions(spark, sf_dir)
    x = ingest.role_inventory(f.withColumn("seq", F.col("ordinal")), hits)
    return x.select("query_id", "concept", F.array_join(F.transform("roles", lambda r: F.concat_ws(":", r["role"], r["n"].cast("string"))), ",").alias("roles"))


# ---- source files: one for each region, written from the tables first


def _written(spark, sf_dir, value, name):
    """A folder with one text file for each region: ``value`` over its nations in order, as one line."""
    n = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name", F.lower("n_name").alias("n_comment"))
    rows = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name", "n_comment"))).alias("r"))
    path = new_path(spark, name)
    rows.select("n_regionkey", value(F.col("r")).alias("value")).repartition("n_regionkey").write.partitionBy("n_regionkey").text(path)
    return path


def _region(path="path"):
    return F.regexp_extract(path, r"n_regionkey=(\d+)", 1).cast("int").alias("region")


def _header_rows(r):
    content = lambda x: F.when(x["n_nationkey"] % 5 > 0, x["n_comment"])
    return F.to_json(F.transform(r, lambda x: F.struct(x["n_name"].alias("header"), content(x).alias("content"), x["n_nationkey"].cast("int").alias("page_start"))))


@query("""SELECT n_regionkey AS region, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::INT - 1 AS index, n_name AS header, n_nationkey::INT AS page_start, n_nationkey % 5 > 0 AND n_nationkey > 0 AS valid FROM nation""")
def header_chunk_files(spark, sf_dir):
    x = files.header_chunks(spark, _written(spark, sf_dir, _header_rows, "header-files"))
    return x.select(_region(), "index", "header", "page_start", "valid")


@query("""WITH j AS (SELECT n_regionkey, n_nationkey, '{"content":' || CASE WHEN n_nationkey % 5 > 0 THEN to_json(lower(n_name))::VARCHAR ELSE 'null' END || ',"header":' || to_json(n_name)::VARCHAR || ',"page_end":null,"page_start":' || n_nationkey || '}' AS j FROM nation)
SELECT n_regionkey AS region, sha256('[' || string_agg(j, ',' ORDER BY n_nationkey) || ']') AS version FROM j GROUP BY 1""")
def source_versions(spark, sf_dir):
    x = files.source_version(files.header_chunks(spark, _written(spark, sf_dir, _header_rows, "version-files")))
    return x.select(_region(), "version")


@query("SELECT 'img/' || n_nationkey || '.png' AS asset, n_name AS caption FROM nation WHERE n_nationkey % 4 > 0")
def caption_files(spark, sf_dir):
    def value(r):
        return F.to_json(F.struct(F.transform(r, lambda x: F.struct(F.concat(F.lit("img/"), x["n_nationkey"].cast("string"), F.lit(".png")).alias("asset"), F.when(x["n_nationkey"] % 4 > 0, x["n_name"]).otherwise(F.lit("  ")).alias("caption"))).alias("matches")))

    return files.caption_map(spark, _written(spark, sf_dir, value, "caption-files"))


@query("""SELECT n_regionkey + 1 AS page, n_nationkey::INT AS order, n_name AS text, CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey + 2.0 END::DOUBLE AS right FROM nation WHERE n_regionkey > 0""")
def layout_files(spark, sf_dir):
    def value(r):
        box = lambda x: F.array(F.lit(1.0), F.lit(1.0), x["n_nationkey"] + F.when(x["n_nationkey"] % 3 > 0, 2.0).otherwise(-50.0), F.lit(9.0))
        b = F.transform(r, lambda x: F.struct(x["n_nationkey"].cast("int").alias("block_order"), F.lit("text").alias("block_label"), x["n_name"].alias("block_content"), box(x).alias("block_bbox")))
        return F.to_json(F.struct(F.col("n_regionkey").cast("int").alias("page_index"), F.col("n_regionkey").cast("double").alias("width"), F.lit(7.0).alias("height"), b.alias("parsing_res_list")))

    pages = files.layout_pages(spark, _paged(spark, sf_dir, value))
    return files.layout_blocks(pages).select("page", "order", "text", F.get("bbox", F.lit(2)).alias("right"))


def _paged(spark, sf_dir, value):
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    path = new_path(spark, "layout-files")
    n.select("n_regionkey", value(F.col("r")).alias("value"), F.col("n_regionkey").alias("part")).repartition("n_regionkey").select("part", "value").write.partitionBy("part").text(path)
    return path


@query("SELECT n_regionkey AS region, sum(strlen(n_name) + 1) AS length, sha256(string_agg(n_name, ',' ORDER BY n_nationkey) || chr(10)) AS sha256 FROM nation GROUP BY 1")
def artifact_files(spark, sf_dir):
    path = _written(spark, sf_dir, lambda r: F.array_join(F.transform(r, lambda x: x["n_name"]), ","), "artifacts")
    return files.artifacts(spark, f"{path}/*").select(_region(), "length", "sha256")


@query("SELECT n_regionkey AS region, CASE n_regionkey WHEN 1 THEN 'size differs' WHEN 2 THEN 'checksum differs' ELSE 'missing' END AS rule FROM nation WHERE n_regionkey IN (1, 2, 4) GROUP BY ALL")
def artifact_checks(spark, sf_dir):
    path = _written(spark, sf_dir, lambda r: F.array_join(F.transform(r, lambda x: x["n_name"]), ","), "artifacts")
    found = files.artifacts(spark, f"{path}/*").withColumn("region", _region())
    expected = found.select("path", "region", (F.col("length") + (F.col("region") == 1).cast("int")).alias("size"), F.when(F.col("region") == 2, "x").otherwise(F.col("sha256")).alias("sha256"))
    return files.artifact_violations(found.where("region <> 4").drop("region"), expected).select(_region(), "rule")


@query("SELECT n_regionkey AS region, CASE n_regionkey WHEN 0 THEN 'kind' WHEN 1 THEN 'media type' WHEN 2 THEN 'checksum' ELSE 'size' END AS rule FROM nation WHERE n_regionkey < 4 GROUP BY ALL")
def source_checks(spark, sf_dir):
    path = _written(spark, sf_dir, lambda r: F.array_join(F.transform(r, lambda x: x["n_name"]), ","), "sources")
    found = files.artifacts(spark, f"{path}/*")
    r = F.col("region")
    sources = found.withColumn("region", _region()).select(
        "path", F.when(r == 0, "image").otherwise("source_pdf").alias("kind"), F.when(r == 1, "text/plain").otherwise("application/pdf").alias("media_type"), (F.col("length") + (r == 3).cast("int")).alias("size"), F.when(r == 2, "x").otherwise(F.col("sha256")).alias("sha256")
    )
    return ingest.source_violations(sources, found).select(_region(), "rule")


@query("SELECT page_id, 'ready' AS status, 1 AS rank, 't' || page_id AS title, url FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, 'empty', NULL, NULL, NULL FROM pages WHERE page_id % 2 = 1")
def web_results(spark, sf_dir):
    item = F.struct(F.concat(F.lit("t"), F.col("page_id").cast("string")).alias("title"), F.when(F.col("page_id") % 4 == 0, F.col("url")).alias("url"), F.when(F.col("page_id") % 4 == 2, F.col("url")).alias("link"))
    body = F.when(F.col("page_id") % 4 == 0, F.to_json(F.struct(F.array(item).alias("items")))).when(F.col("page_id") % 4 == 2, F.to_json(F.struct(F.array(item).alias("results")))).when(F.col("page_id") % 4 == 1, F.lit('{"data":[{"title":"no address"}]}')).otherwise("broken")
    raw = table(spark, sf_dir, "pages").select("page_id", body.alias("body"))
    return files.web_results(raw).select("page_id", "status", "rank", "title", "url")


@query(f"""WITH {_FACTS}, l AS (SELECT chunk_id, ordinal, paragraph_id, min(excerpt) AS text, string_agg(DISTINCT concept || ' -> ' || role, '; ' ORDER BY concept || ' -> ' || role) AS labels FROM facts GROUP BY ALL)
SELECT chunk_id, md5(string_agg('## ' || paragraph_id || chr(10) || text || chr(10) || '- ' || CASE WHEN ordinal % 3 > 0 THEN labels ELSE 'none' END, chr(10) || chr(10) ORDER BY ordinal)) AS markdown_md5 FROM l GROUP BY 1""")
def review_markdown(spark, sf_dir):
    f = facts(spark, sf_dir)
    x = files.review_markdown(f.groupBy("chunk_id", "ordinal", "paragraph_id").agg(F.min("excerpt").alias("text")), f.where("ordinal % 3 > 0"), "chunk_id")
    return x.select("chunk_id", F.md5("markdown").alias("markdown_md5"))


@query("SELECT doc_id, lang FROM documents")
def exported(spark, sf_dir):
    path = new_path(spark, "export")
    files.export({"documents": table(spark, sf_dir, "documents").select("doc_id", "lang")}, path)
    return spark.read.schema("doc_id long, lang string").json(f"{path}/documents")


# ---- checks and small rules


@query("SELECT doc_id FROM documents WHERE lang = 'de' AND CASE WHEN doc_id % 4 > 0 THEN source END IS NULL")
def metadata_filters(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("source", F.when(F.col("doc_id") % 4 > 0, F.col("source")))
    return d.where(search.matches({"lang": "de", "source": None})).select("doc_id")


@query("""WITH m AS (SELECT doc_id, unnest(['image/' || lang, 'text/' || source || '; charset=utf-8', ' image/png', 'image', 'image/png; a="x y"', 'Image/SVG+xml', lang || '/' || doc_id, 'a/b c']) AS m FROM documents)
SELECT doc_id, m, regexp_full_match(m, '[A-Za-z0-9+/]+(; ?[a-z]+=([a-z0-9-]+|"[^"]*"))?') AND contains(m, '/') AS media, starts_with(lower(m), 'image/') AS image FROM m""")
def media_types(spark, sf_dir):
    d, s = table(spark, sf_dir, "documents"), F.lit
    kinds = [F.concat(s("image/"), "lang"), F.concat(s("text/"), "source", s("; charset=utf-8")), s(" image/png"), s("image"), s('image/png; a="x y"'), s("Image/SVG+xml"), F.concat("lang", s("/"), F.col("doc_id").cast("string")), s("a/b c")]
    x = d.select("doc_id", F.explode(F.array(*kinds)).alias("m"))
    return x.select("doc_id", "m", T.is_media_type(F.col("m")).alias("media"), T.is_image_media_type(F.col("m")).alias("image"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Own' WHEN doc_id % 4 = 1 THEN lang WHEN doc_id % 4 = 2 THEN source || ' > ' || lang ELSE 'c' || doc_id END AS header FROM documents")
def chunk_headers(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 4
    none = F.expr("cast(array() as array<string>)")
    x = d.withColumns({"own": F.when(k == 0, "Own").otherwise("  "), "head": F.when(k == 1, F.col("lang")), "path": F.when(k == 2, F.array("source", "lang")).otherwise(none), "c": F.concat(F.lit("c"), F.col("doc_id").cast("string"))})
    return x.select("doc_id", concepts.chunk_header(F.col("own"), F.col("head"), F.col("path"), none, F.col("c")).alias("header"))


@query("SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 3 < 2 THEN doc_id % 3 END, CASE WHEN doc_id % 5 > 0 AND NOT (doc_id % 3 < 2 AND doc_id % 3 = doc_id % 5) THEN doc_id % 5 END) AS labels FROM documents")
def page_labels(spark, sf_dir):
    start, end = F.when(F.col("doc_id") % 3 < 2, F.col("doc_id") % 3), F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") % 5).otherwise(-1)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(records.page_labels(start, end), ",").alias("labels"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id % 7 ELSE doc_id % 9 END::INT AS first, doc_id % 9 AS last FROM documents")
def source_pages(spark, sf_dir):
    pages = F.array(F.lit("cover"), F.when(F.col("doc_id") % 2 == 0, (F.col("doc_id") % 7).cast("string")).otherwise("x"), F.concat(F.lit(" "), (F.col("doc_id") % 9).cast("string")))
    first, last = answers.source_pages(pages)
    return table(spark, sf_dir, "documents").select("doc_id", first.cast("int").alias("first"), last.cast("long").alias("last"))


@query("SELECT vec_id AS key, 'empty or not finite' AS rule FROM embeddings WHERE vec_id % 17 = 1 UNION ALL SELECT vec_id, 'missing' FROM embeddings WHERE vec_id % 17 = 0 UNION ALL SELECT vec_id, 'other dimension' FROM embeddings WHERE vec_id % 17 = 2")
def vector_violations(spark, sf_dir):
    v, k = F.col("embedding").cast("array<double>"), F.col("vec_id") % 17
    x = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.when(k == 0, F.lit(None)).when(k == 1, F.concat(F.array(F.lit(float("nan"))), F.slice(v, 2, 1000))).when(k == 2, F.slice(v, 2, 1000)).otherwise(v).alias("embedding"))
    return ports.vector_violations(x, "key")


@query("SELECT user_id AS run_id FROM events GROUP BY 1 HAVING count(DISTINCT event_type) <> 2")
def plan_violations(spark, sf_dir):
    x = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.concat(F.collect_list("event_type"), F.array(F.lit("  "))).alias("queries"))
    return answers.plan_violations(x).select("run_id")


@query("SELECT p_partkey, p_brand AS asset, p_name AS caption FROM part WHERE p_size % 2 = 0")
def captioned(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    paras = p.select(F.col("p_partkey").alias("paragraph_id"), F.array(F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")), F.lit("none.png")).alias("image_refs"))
    captions = p.where("p_size % 2 = 0").select(F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("asset"), F.col("p_name").alias("caption"))
    x = answers.with_captions(paras, captions).select("paragraph_id", F.explode("image_captions").alias("asset", "caption"))
    return x.select(F.col("paragraph_id").alias("p_partkey"), F.regexp_extract("asset", "^(.*)/", 1).alias("asset"), "caption")


@query("SELECT l_orderkey AS chunk_id, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') GROUP BY 1")
def relations_out_of_scope(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id"))
    hits = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("chunk_id"))
    return records.in_hit_chunks(f, hits)[1].groupBy("chunk_id").agg(F.count("*").alias("n"))


@query("""WITH k AS (SELECT user_id, event_type AS key, count(*) AS n FROM events GROUP BY ALL), c AS (SELECT DISTINCT user_id, event_type AS key FROM events WHERE value > 50)
SELECT user_id, key, 'repeated key' AS rule FROM k WHERE n > 1 UNION ALL SELECT e.user_id, e.event_type, 'unknown key' FROM events e WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = e.user_id AND c.key = e.event_type)""")
def choice_violations(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("key"), "value")
    return records.chosen(e.where("value > 50").select("user_id", "key").distinct(), e.select("user_id", "key"), ["user_id"])[1]


@query("SELECT page_id AS run_id, url, 'web:' || substr(sha256(concat_ws(chr(31), 'web', '', '', '', url)), 1, 20) AS evidence_id FROM pages")
def web_evidence(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("run_id"), F.concat(F.lit("t"), F.col("page_id").cast("string")).alias("title"), "url", F.lit("s").alias("snippet"), F.lit("c").alias("content"))
    return answers.web_evidence(p).select("run_id", "url", "evidence_id")


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'chunk_id' ELSE ' ' END AS name FROM documents WHERE doc_id % 3 < 2")
def metadata_violations(spark, sf_dir):
    m = F.map_from_arrays(F.array(F.when(F.col("doc_id") % 3 == 0, "chunk_id").when(F.col("doc_id") % 3 == 1, " ").otherwise("heading"), F.lit("tags")), F.array(F.array("lang"), F.array("source")))
    return records.metadata_violations(table(spark, sf_dir, "documents").withColumn("metadata", m), "doc_id", "metadata")


@query()
def token_slices(spark, sf_dir):
    """Texts in slices of 200 tokens, by a public tokenizer's file."""
    import public_tokenizers

    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    cut = ingest.token_slices(public_tokenizers.path("byte_bpe_50k.json"), 200)
    return d.select("doc_id", F.posexplode(cut("source", "text")).alias("part", "content"))


# ---- outbox with both collections, and headings

_TYPED = """SELECT doc_id, format_string('e%09d', doc_id) AS event_id, 'run' AS run_id, 'pending' AS status, 0 AS attempts, CAST(NULL AS STRING) AS last_error, 's1' AS source_version, 'v1' AS index_version,
CASE WHEN doc_id % 2 = 0 THEN 'document_chunks' ELSE 'concept_catalog' END AS collection, CASE WHEN doc_id % 10 IN (4, 9) THEN 'delete' ELSE 'upsert' END AS operation,
CASE WHEN doc_id % 2 = 0 THEN concat('c', doc_id % 300) ELSE concat('concept::', sha2(concat('l', doc_id % 51), 256)) END AS record_id, concat('d', doc_id % 300) AS document_ref,
CASE WHEN doc_id % 10 IN (2, 3) THEN '{"record":' WHEN doc_id % 2 = 0 THEN concat('{"record":{"chunk_id":"c', doc_id % 300, CASE WHEN doc_id % 10 = 6 THEN 'x' ELSE '' END, '","document_ref":"d', doc_id % 300, '","source_version":"s1","search_text":"', lang, doc_id, '","embedding":[0.5,', doc_id, '],"embedding_profile":"m1","access_scope":"public","metadata":{}}}')
ELSE concat('{"record":{"record_id":"concept::', sha2(concat('l', doc_id % 51), 256), '","canonical_label":"L', doc_id % 51, '","normalized_label":"', CASE WHEN doc_id % 10 = 7 THEN 'other' ELSE concat('l', doc_id % 51) END, '","search_text":"', lang, doc_id, '","embedding":[0.25],"usage_count":', doc_id, ',"embedding_input_hash":"', sha2(lang, 256), '","embedding_model":"m1","embedding_dimensions":1,"index_version":"v1","metadata":{}}}') END AS payload FROM documents"""


def _typed(spark, sf_dir):
    """Chunk and concept events of all documents, applied: a chunk's state whose number is divisible by seven is held
    by another document."""
    docs = table(spark, sf_dir, "documents")
    events = docs.sparkSession.sql(_TYPED.replace("{", "{{").replace("}", "}}").replace("FROM documents", "FROM {documents}"), documents=docs.select("doc_id", "lang"))
    n = docs.select((F.col("doc_id") % 300).alias("n")).distinct()
    text, none = F.lit("old"), F.lit(None).cast("string")
    chunks = n.select(F.format_string("c%d", "n").alias("record_id"), F.format_string("d%d", "n").alias("document_ref"), text.alias("search_text"))
    concepts_ = docs.select((F.col("doc_id") % 51).alias("n")).distinct().select(F.concat(F.lit("concept::"), F.sha2(F.format_string("l%d", "n"), 256)).alias("record_id"), text.alias("search_text"), F.lit(-1).cast("long").alias("usage_count"))
    states = n.select(
        F.lit("chunk").alias("entity_type"), F.format_string("c%d", "n").alias("entity_key"), F.lit("document_chunks").alias("collection"), F.format_string("c%d", "n").alias("record_id"), F.lit("h").alias("input_hash"), F.lit("m0").alias("model"), F.lit(2).alias("dimensions"),
        F.lit("v1").alias("index_version"), F.lit("synced").alias("sync_status"), F.when(F.col("n") % 7 == 0, "other").otherwise(F.format_string("d%d", "n")).alias("document_ref"), F.lit("s0").alias("source_version"),
    )
    return outbox.sync(events.drop("doc_id"), chunks, concepts_, states, None)


@query(f"""SELECT 'e' || lpad(doc_id::VARCHAR, 9, '0') AS event_id, CASE WHEN e IS NULL THEN 'done' ELSE 'failed' END AS status, (e IS NOT NULL)::INT AS attempts, e AS last_error FROM (SELECT doc_id,
CASE WHEN doc_id % 10 = 2 THEN '{outbox.INVALID}' WHEN doc_id % 10 IN (3, 7) THEN '{outbox.INVALID_CONCEPT}' WHEN doc_id % 10 = 6 THEN '{outbox.MISMATCH}' WHEN doc_id % 10 IN (0, 8) AND doc_id % 300 % 7 = 0 THEN '{outbox.TAKEN}' END AS e FROM documents)""")
def outbox_typed_events(spark, sf_dir):
    return _typed(spark, sf_dir).outbox.select("event_id", "status", "attempts", "last_error")


@query("""WITH l AS (SELECT doc_id % 300 AS n, max(doc_id) AS last, max_by(doc_id % 10 = 4, doc_id) AS gone, max_by(lang, doc_id) AS lang FROM documents WHERE doc_id % 10 IN (0, 4, 8) GROUP BY 1)
SELECT 'c' || n AS record_id, 'd' || n AS document_ref, lang || last AS search_text FROM l WHERE NOT gone UNION ALL SELECT DISTINCT 'c' || doc_id % 300, 'd' || doc_id % 300, 'old' FROM documents WHERE doc_id % 300 NOT IN (SELECT n FROM l)""")
def outbox_typed_chunks(spark, sf_dir):
    return _typed(spark, sf_dir).chunks


@query("""WITH l AS (SELECT doc_id % 51 AS n, max(doc_id) AS last, max_by(doc_id % 10 = 9, doc_id) AS gone, max_by(lang, doc_id) AS lang FROM documents WHERE doc_id % 10 IN (1, 5, 9) GROUP BY 1)
SELECT 'concept::' || sha256('l' || n) AS record_id, lang || last AS search_text, last AS usage_count FROM l WHERE NOT gone UNION ALL SELECT DISTINCT 'concept::' || sha256('l' || doc_id % 51), 'old', -1 FROM documents WHERE doc_id % 51 NOT IN (SELECT n FROM l)""")
def outbox_typed_concepts(spark, sf_dir):
    return _typed(spark, sf_dir).concepts


@query("""WITH m AS (SELECT doc_id % 300 AS n, max(doc_id) FILTER (doc_id % 10 <> 4) AS up, max(doc_id) FILTER (doc_id % 10 = 4) AS down FROM documents WHERE doc_id % 10 IN (0, 4, 8) AND doc_id % 300 % 7 > 0 GROUP BY 1),
c AS (SELECT doc_id % 51 AS n, max(doc_id) FILTER (doc_id % 10 <> 9) AS up, max(doc_id) FILTER (doc_id % 10 = 9) AS down FROM documents WHERE doc_id % 10 IN (1, 5, 9) GROUP BY 1)
SELECT 'chunk' AS entity_type, 'c' || d.n AS entity_key, CASE WHEN m.up IS NULL THEN 'm0' ELSE 'm1' END AS model, CASE WHEN d.n % 7 = 0 THEN 'other' ELSE 'd' || d.n END AS document_ref
FROM (SELECT DISTINCT doc_id % 300 AS n FROM documents) d LEFT JOIN m USING (n) WHERE m.down IS NULL OR m.up > m.down
UNION ALL SELECT 'concept', 'l' || n, 'm1', NULL FROM c WHERE up IS NOT NULL AND (down IS NULL OR up > down)""")
def outbox_typed_states(spark, sf_dir):
    return _typed(spark, sf_dir).states.select("entity_type", "entity_key", "model", "document_ref")


_HEADED = r"""SELECT doc_id, concat('## ', source, '#\n\n', lang, '\n\n## Two ', source, ' ##\n\nfirst\n\n### Deep # \n\nlast ', lang) AS markdown FROM {documents}"""


def _headed(spark, sf_dir):
    return spark.sql(_HEADED, documents=table(spark, sf_dir, "documents"))


@query("SELECT doc_id, 0 AS index, source || '#' AS heading FROM documents UNION ALL SELECT doc_id, 1, 'Two ' || source FROM documents")
def heading_titles(spark, sf_dir):
    """Closing signs go only after white space."""
    return segment.header_chunks(_headed(spark, sf_dir), ["doc_id"]).select("doc_id", "index", "heading")


@query("""SELECT doc_id, 0 AS ordinal, source || '#' AS path FROM documents UNION ALL SELECT doc_id, 1, source || '#/Two ' || source || ' ##' FROM documents UNION ALL SELECT doc_id, 2, source || '#/Two ' || source || ' ##/Deep #' FROM documents""")
def heading_paths(spark, sf_dir):
    """A paragraph's path holds titles as they are written."""
    return segment.paragraphs(_headed(spark, sf_dir), ["doc_id"], "markdown").select("doc_id", "ordinal", F.array_join("heading_path", "/").alias("path"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), k AS (SELECT doc_id, count(*) AS n FROM l WHERE trim(line) <> '' GROUP BY 1)
SELECT 'doc-' || doc_id AS document_ref, n + (doc_id % 100 = 0)::INT AS chunks, n + (doc_id % 100 = 0)::INT AS indexed FROM k WHERE doc_id % 100 <> 50""")
def ingest_incremental(spark, sf_dir):
    """Ingest all documents; then every hundredth gains a section and another hundredth loses all: chunks stored and
    indexed by document."""
    store, docs = Store(spark, new_path(spark, "incremental-store")), flows.corpus_markdown(table(spark, sf_dir, "documents"))
    incremental.ingest(store, docs, ports.FakeEmbedder(), None, "first", batches=2)
    incremental.apply_pending(store)
    n = F.regexp_extract("document_ref", r"(\d+)$", 1).cast("long") % 100
    changed = docs.where(n.isin(0, 50)).withColumn("markdown", F.when(n == 0, F.concat("markdown", F.lit("\n\n## Added\n\nmore words"))).otherwise(""))
    incremental.ingest(store, changed, ports.FakeEmbedder(), None, "second", batches=2)
    incremental.apply_pending(store)
    chunks = store.read("chunks").groupBy("document_ref").agg(F.count("*").alias("chunks"))
    return chunks.join(store.read("index").groupBy("document_ref").agg(F.count("*").alias("indexed")), "document_ref", "left")


# ---- vector search by lists, and every row as a query


@query(f"SELECT e.vec_id, e.label, round({_DIST}, 6) AS distance FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY {_DIST}, e.vec_id LIMIT 20")
def vector_lists_topk(spark, sf_dir):
    """As a scan's top-k, by lists around centroids of which most are skipped."""
    index = table(spark, sf_dir, "embeddings")
    found = VectorLists.build(index, new_path(spark, "vector-lists"), 32).topk(_query_vector(spark, sf_dir), 20)
    return found.rows.select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query(f"""WITH d AS (SELECT q.vec_id AS query_id, e.vec_id, {_DIST} AS d FROM embeddings e, embeddings q WHERE e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), vec_id) AS rank FROM d)
SELECT query_id, vec_id, round(d, 6) AS distance, rank FROM r WHERE rank <= 3""")
def all_topk(spark, sf_dir):
    """The neighbours of every row."""
    index = table(spark, sf_dir, "embeddings")
    found = search.batch_topk(index, index.select(F.col("vec_id").alias("query_id"), "embedding"), 3, exclude_self=True)
    return found.select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


# ---- substring search by an index, for many questions at once


@query(r"""WITH q AS (SELECT doc_id AS query_id, array_to_string(string_split(text, ' ')[2:4], ' ') AS query FROM documents WHERE doc_id % 50 = 0),
t AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}_-]+')) AS term FROM q), n AS (SELECT query_id, count(*) AS n FROM t GROUP BY 1),
h AS (SELECT t.query_id, d.doc_id AS key, count(*) AS held FROM t JOIN documents d ON contains(lower(d.text), t.term) GROUP BY ALL),
r AS (SELECT query_id, key, held / n::DOUBLE AS s, row_number() OVER (PARTITION BY query_id ORDER BY held / n::DOUBLE DESC, key) AS rank FROM h JOIN n USING (query_id))
SELECT query_id, key, round(s, 6) AS keyword_score, rank FROM r WHERE rank <= 5""")
def lexical_many(spark, sf_dir):
    """Words of every fiftieth document as a question, against all documents."""
    docs = table(spark, sf_dir, "documents")
    index = TermIndex.build(docs, F.col("text"), "doc_id", new_path(spark, "term-index"))
    asked = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 2, 3), " ").alias("query"))
    return index.search(asked, 5).select("query_id", "key", F.round("keyword_score", 6).alias("keyword_score"), "rank")


@query("""SELECT 'd' || doc_id AS entity_key, CASE WHEN doc_id % 89 = 0 THEN 'new' ELSE 'changed' END AS change, sha256(text) AS input_hash FROM documents WHERE doc_id % 89 = 0 OR doc_id % 97 = 0
UNION ALL SELECT 'p' || page_id, 'stale', md5(url) FROM pages WHERE page_id % 61 = 0""")
def vector_state_changes(spark, sf_dir):
    """What differs between states and documents, by digests of buckets: only buckets that differ are joined."""
    old, desired = _vector_states(spark, sf_dir)
    number = F.substring("entity_key", 2, 20).cast("long")
    pages = old.where("entity_key LIKE 'p%'").where(number % 61 == 0)
    kept = desired.where(number % 89 != 0).withColumn("input_hash", F.when(number % 97 == 0, F.md5("entity_key")).otherwise(F.col("input_hash"))).withColumn("sync_status", F.lit("synced"))
    existing = saved(kept.unionByName(pages.select(*kept.columns)), "states")
    changes, _ = state.changes_by_digest(existing, desired, state.bucket_digests(existing))
    return changes.select("entity_key", "change", "input_hash")


# ---- artifacts by content


@query("""SELECT 'pages/' || page_id AS path, sha256(c) AS sha256, strlen(c) AS length, true AS intact
FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN coalesce(url, '') ELSE coalesce(html, '') END AS c FROM pages WHERE page_id % 7 <> 0)""")
def artifact_store(spark, sf_dir):
    """Every page stored as an artifact; a second commit replaces a third of them and deletes a seventh."""
    root = new_path(spark, "artifact-store")
    pages = table(spark, sf_dir, "pages")
    path = F.concat(F.lit("pages/"), F.col("page_id").cast("string")).alias("path")
    html, url = (F.encode(F.coalesce(c, F.lit("")), "UTF-8") for c in ("html", "url"))
    artifacts.put(pages.select(path, html.alias("content"), F.sha2(html, 256).alias("sha256")), root)
    changed = pages.where("page_id % 3 = 0 OR page_id % 7 = 0").select(path, F.when(F.col("page_id") % 7 != 0, url).alias("content"), F.lit(None).cast("string").alias("sha256"))
    artifacts.put(changed, root)
    return artifacts.contents(artifacts.listed(spark, root), root).select("path", F.sha2("content", 256).alias("sha256"), "length", "intact")


# ---- results of tagging, and choices of roles


def _order_labels(spark, sf_dir):
    """Orders as paragraphs, and two labels of each: the second resolves to the first for even keys. Pending orders have
    no result, and the result of every seventh order is of no paragraph."""
    key, first, second = F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus")
    o = table(spark, sf_dir, "orders").select(key, first, second)
    both = F.inline(F.array(F.struct(F.lit(0).alias("pos"), first.alias("generated"), first.alias("resolved")), F.struct(F.lit(1).alias("pos"), second.alias("generated"), F.when(key % 2 == 0, first).otherwise(second).alias("resolved"))))
    name = F.when(key % 7 == 0, F.concat(key.cast("string"), F.lit("-gone"))).otherwise(key.cast("string")).alias("paragraph_id")
    return o.select(key.cast("string").alias("paragraph_id")), o.where("o_orderstatus <> 'P'").select(name, both)


@query("""SELECT o_orderkey::VARCHAR AS paragraph_id, o_orderpriority || '|' || o_orderstatus AS generated, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderpriority || '|' || o_orderstatus END AS tags
FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 7 <> 0""")
def paragraphs_tagged(spark, sf_dir):
    """Generated labels and distinct resolved tags of each order, in order."""
    tagged, _ = records.tagged_paragraphs(*_order_labels(spark, sf_dir))
    return tagged.select("paragraph_id", F.array_join("generated", "|").alias("generated"), F.array_join("tags", "|").alias("tags"))


@query("""SELECT o_orderkey::VARCHAR AS paragraph_id, 'no result' AS rule FROM orders WHERE o_orderstatus = 'P' OR o_orderkey % 7 = 0
UNION ALL SELECT o_orderkey || '-gone', 'unknown paragraph' FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 7 = 0""")
def tagging_coverage(spark, sf_dir):
    """Orders without a result, and results without an order."""
    return records.tagged_paragraphs(*_order_labels(spark, sf_dir))[1]


@query(f"""WITH {_FACTS}, f AS (SELECT DISTINCT lower(concept) AS key, role FROM facts),
s AS (SELECT p_partkey AS selection, CASE WHEN p_partkey % 10 = 3 THEN 'no ' || lower(p_type) ELSE lower(p_type) END AS key, CASE WHEN p_partkey % 3 = 0 THEN 'Z' ELSE 'A' END AS role, CASE WHEN p_partkey % 20 = 1 THEN p_partkey - 1 ELSE p_partkey END AS rank FROM part)
SELECT selection, 'unknown concept' AS rule FROM s WHERE key NOT IN (SELECT key FROM f)
UNION ALL SELECT selection, 'unknown role' FROM s WHERE key IN (SELECT key FROM f) AND NOT EXISTS (SELECT 1 FROM f WHERE f.key = s.key AND f.role = s.role)
UNION ALL SELECT selection, 'rank given twice' FROM s WHERE rank IN (SELECT rank FROM s GROUP BY 1 HAVING count(*) > 1)""")
def role_selection_violations(spark, sf_dir):
    """A choice of concept and role for each part, against the concepts and roles of all lines."""
    key = F.col("p_partkey")
    chosen = table(spark, sf_dir, "part").select(key.alias("selection"), F.when(key % 10 == 3, F.concat(F.lit("no "), "p_type")).otherwise(F.col("p_type")).alias("concept"), F.when(key % 3 == 0, "Z").otherwise("A").alias("role"), F.when(key % 20 == 1, key - 1).otherwise(key).alias("rank"))
    return answers.role_violations(chosen, facts(spark, sf_dir))


@query("""SELECT l_orderkey || '-' || l_linenumber AS paragraph_id, CASE WHEN l_linenumber <= 3 THEN p_brand || '/' || l_linenumber END AS label FROM lineitem JOIN part ON p_partkey = l_partkey""")
def labels_remapped(spark, sf_dir):
    """Labels kept for three places of each part's text, given to the lines of that text by place."""
    sha = lambda c: F.sha2(F.col(c).cast("string"), 256).alias("content_sha")
    cached = table(spark, sf_dir, "part").select(sha("p_partkey"), "p_brand", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("ordinal"))
    cached = cached.select("content_sha", "ordinal", F.concat_ws("/", "p_brand", "ordinal").alias("label"))
    lines = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("paragraph_id"), sha("l_partkey"), F.col("l_linenumber").alias("ordinal"))
    return records.remapped(cached, lines).select("paragraph_id", "label")


# ---- catalog times, errors of traversal and of the image gate


@query(_CATALOG + """ SELECT normalized_label, sum(usage_count)::BIGINT AS usage_count, min(document_ref) AS first_seen_source, CASE WHEN length(normalized_label) % 2 = 0 THEN '2024-01-01' ELSE '2024-02-01' END AS created, '2024-02-01' AS updated FROM catalog GROUP BY 1""")
def catalog_rebuilt(spark, sf_dir):
    before = facts(spark, sf_dir).select(F.lower("concept").alias("normalized_label")).distinct().where("length(normalized_label) % 2 = 0")
    gone = before.limit(1).select(F.lit("gone").alias("normalized_label"))
    previous = before.union(gone).withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    x = concepts.rebuilt_catalog(_observations(spark, sf_dir), previous, F.lit("2024-02-01").cast("timestamp"))
    return x.select("normalized_label", "usage_count", "first_seen_source", F.date_format("created_at", "yyyy-MM-dd").alias("created"), F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


@query(f"""WITH {_FACTS} SELECT paragraph_id || '/' || lower(concept) || '/' || role AS key, 'relation given twice' AS rule FROM facts GROUP BY paragraph_id, lower(concept), role HAVING count(*) > 1
UNION ALL SELECT DISTINCT paragraph_id, 'relation of a missing paragraph' FROM facts WHERE ordinal > 6
UNION ALL SELECT DISTINCT lower(concept) || '/X', 'pair without paragraph' FROM facts""")
def traversal_errors(spark, sf_dir):
    f = facts(spark, sf_dir)
    key = F.lower("concept")
    own = f.select(F.concat_ws("/", key, "role").alias("selection"), key.alias("concept"), "role", "chunk_id").distinct()
    other = f.select(F.concat(key, F.lit("/X")).alias("selection"), key.alias("concept"), F.lit("X").alias("role"), "chunk_id").distinct()
    return concepts.traversal_violations(own.union(other), f, f.where("ordinal <= 6").select("paragraph_id").distinct())


@query("SELECT doc_id, '../up.png' AS ref FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'http://x/' || doc_id FROM documents WHERE doc_id % 3 = 0")
def unsafe_images(spark, sf_dir):
    key = F.col("doc_id").cast("string")
    bad = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("../up.png"), F.lit("../up.png"))).otherwise(F.array(F.lit("b.png")))
    more = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(None).cast("string"), F.concat(F.lit("http://x/"), key))).otherwise(F.array(F.concat(F.lit("images/"), key)))
    return records.unsafe_images(table(spark, sf_dir, "documents").select("doc_id", F.concat(bad, more).alias("refs")), "doc_id", "refs")
