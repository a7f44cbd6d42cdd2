"""Queries of the question flow: customers ask, their orders are the hit chunks, lines are paragraphs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from docquarry.operators import answers, concepts, questions, records
from docquarry.plans.queries import _FACTS, facts, query
from docquarry.session import table

_ASKED = """WITH h AS (SELECT o_custkey AS q, o_orderkey AS chunk, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders WHERE o_orderstatus <> 'P'),
l AS (SELECT DISTINCT l_orderkey AS chunk, l_linenumber AS n, l_orderkey || '-' || l_linenumber AS paragraph, l_linestatus AS c, l_returnflag AS role FROM lineitem),
cand AS (SELECT *, CASE WHEN chunk % 5 = 0 THEN 30 ELSE 4 END AS words FROM h JOIN l USING (chunk)),
s AS (SELECT c_custkey AS q, 1 AS pos, 'O' AS c, ['N'] AS roles, 1 AS rk FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT c_custkey, 2, 'F', ['R', 'A'], CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 2 END FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 3, 'Z', ['N'], 3 FROM customer WHERE c_custkey % 11 = 0),
asked AS (SELECT * FROM s WHERE q IN (SELECT q FROM cand)),
k AS (SELECT q, c, list(DISTINCT role) AS known FROM cand GROUP BY 1, 2),
v AS (SELECT q, rule FROM (SELECT q, CASE WHEN known IS NULL THEN 'concept is not offered' WHEN NOT list_has_all(known, roles) THEN 'role is not offered' END AS rule FROM asked LEFT JOIN k USING (q, c)) WHERE rule IS NOT NULL UNION SELECT q, 'rank given twice' FROM asked GROUP BY q, rk HAVING count(*) > 1),
p AS (SELECT q, pos, c, unnest(roles) AS role, generate_subscripts(roles, 1) AS nth FROM asked WHERE q NOT IN (SELECT q FROM v)),
m AS (SELECT DISTINCT q, pos, nth, c, role, paragraph, chunk, words FROM p JOIN cand USING (q, c, role)),
a AS (SELECT q, paragraph, chunk, words, false AS attached, min(pos * 10 + nth) AS o1, 0 AS o2 FROM m GROUP BY ALL),
i AS (SELECT DISTINCT q, paragraph, chunk, words, true, rank, n FROM cand WHERE n % 4 = 0 AND q % 3 = 0 AND (q, chunk) IN (SELECT (q, chunk) FROM a) AND (q, paragraph) NOT IN (SELECT (q, paragraph) FROM a)),
o AS (SELECT *, row_number() OVER w AS place, sum(words) OVER w AS running FROM (SELECT * FROM a UNION ALL SELECT * FROM i) WINDOW w AS (PARTITION BY q ORDER BY attached, o1, o2, paragraph)),
x AS (SELECT * FROM o WHERE place <= 5 AND running <= 24),
r AS (SELECT * FROM v UNION ALL SELECT q, 'first paragraph exceeds the limit' FROM o WHERE place = 1 AND running > 24)"""


def _bundles(spark, sf_dir):
    key = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    asked = c.select(key.alias("query_id"), F.when(key % 3 == 0, "Please show the figure").otherwise("Why?").alias("question"))
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    hits = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("chunk_id"), rank.alias("rank"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("ordinal"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("paragraph_id"), F.col("l_linestatus").alias("concept"), F.col("l_returnflag").alias("role"))
    empty = F.expr("cast(array() as array<string>)")
    text = F.concat("paragraph_id", F.when(F.col("chunk_id") % 5 == 0, F.lit(" w" * 29)).otherwise(F.lit(" is one line")))
    paras = lines.select("paragraph_id", F.col("l_orderkey").alias("chunk_id"), "ordinal").distinct().select(
        "*", F.concat(F.lit("order "), F.col("chunk_id").cast("string")).alias("source"), F.lit("Lines").alias("header"), empty.alias("nested"), empty.alias("pages"), F.when(F.col("ordinal") % 4 == 0, F.array(F.lit("images/x.png"))).otherwise(empty).alias("image_refs"), text.alias("text")
    )
    one = c.where(key % 3 > 0).select(key.alias("query_id"), F.lit(1).alias("pos"), F.lit("O").alias("concept"), F.array(F.lit("N")).alias("roles"), F.lit(1).alias("selection_rank"))
    two = c.where(key % 2 == 0).select(key, F.lit(2), F.lit(" F "), F.array(F.lit("R"), F.lit("A")), F.when(key % 7 == 0, 1).otherwise(2))
    three = c.where(key % 11 == 0).select(key, F.lit(3), F.lit("Z"), F.array(F.lit("N")), F.lit(3))
    relations = lines.select("paragraph_id", "concept", "role").distinct()
    return questions.bundles(asked, hits, relations, paras, one.union(two).union(three), 5, 24)


@query(_ASKED + """ SELECT c_custkey AS query_id, CASE WHEN c_custkey NOT IN (SELECT q FROM h) THEN 'no_retrieval_context' WHEN c_custkey NOT IN (SELECT q FROM asked) THEN 'no_relevant_concept_role' WHEN rules IS NULL THEN 'ready' ELSE 'refused' END AS status, coalesce(rules, '') AS rules
FROM customer LEFT JOIN (SELECT q, string_agg(rule, ',' ORDER BY rule) AS rules FROM r GROUP BY 1) ON q = c_custkey""")
def question_flow_status(spark, sf_dir):
    return _bundles(spark, sf_dir).status.withColumn("rules", F.array_join("rules", ","))


@query(_ASKED + " SELECT q AS query_id, place, paragraph, attached FROM x")
def question_flow_context(spark, sf_dir):
    return _bundles(spark, sf_dir).context.select("query_id", "place", F.col("paragraph_id").alias("paragraph"), "attached")


@query(_ASKED + """, parents AS (SELECT q, c, string_agg(chunk || ' (rank ' || rank || ')', ', ' ORDER BY rank) AS parents FROM (SELECT DISTINCT q, c, chunk, rank FROM cand) GROUP BY 1, 2),
e AS (SELECT q, pos, nth, c, role, string_agg('[' || place || ']', ', ' ORDER BY paragraph) AS cited FROM m JOIN x USING (q, paragraph) WHERE NOT attached GROUP BY ALL),
rm AS (SELECT q, string_agg('### Concept: ' || c || E'\\n\\n- Selected role: ' || role || E'\\n- Paragraphs: ' || cited || E'\\n- Parent chunks: ' || parents || E'\\n', E'\\n' ORDER BY pos, nth) || E'\\n' AS roles FROM e JOIN parents USING (q, c) GROUP BY 1),
lb AS (SELECT paragraph, any_value(n) AS n, string_agg(DISTINCT c || ' -> ' || role, '; ' ORDER BY c || ' -> ' || role) AS labels FROM l GROUP BY 1),
pm AS (SELECT q, string_agg('### [' || place || E']\\n\\n- Source: order ' || chunk || E'\\n- Parent header: Lines\\n- Concepts and roles: ' || labels || E'\\n- Images: ' || CASE WHEN n % 4 = 0 THEN 'images/x.png' ELSE 'none' END || E'\\n\\n' || paragraph || CASE WHEN chunk % 5 = 0 THEN repeat(' w', 29) ELSE ' is one line' END || E'\\n', E'\\n' ORDER BY place) AS paragraphs FROM x JOIN lb USING (paragraph) WHERE NOT attached GROUP BY 1)
SELECT q AS query_id, md5(E'# Retrieval Context\\n\\n## User question\\n\\n' || CASE WHEN q % 3 = 0 THEN 'Please show the figure' ELSE 'Why?' END || E'\\n\\n## Concept-role map\\n\\n' || roles || E'## Source paragraphs\\n\\n' || paragraphs) AS markdown_md5 FROM pm JOIN rm USING (q)""")
def question_flow_markdown(spark, sf_dir):
    return _bundles(spark, sf_dir).markdown.select("query_id", F.md5("markdown").alias("markdown_md5"))


def _lists(spark, sf_dir):
    """Two ranked lists of documents for each source: by length and by digest, with metadata of the list."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("chunk_ref"), "lang", "n_chars")

    def ranked(order, score, name):
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "chunk_ref"))
        x = d.withColumn("rank", rank).where("rank <= 60")
        return x.select("query_id", "chunk_ref", F.concat_ws("/", F.lit(name), "lang").alias("source_ref"), "rank", score.alias("score"), F.struct(F.lit(name).alias("list"), "n_chars").alias("metadata"))

    return ranked(F.desc("n_chars"), F.col("n_chars").cast("double"), "long"), ranked(F.col("n_chars") % 997, (F.col("n_chars") % 997).cast("double"), "mixed")


@query("""WITH a AS (SELECT source AS q, doc_id, lang, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 60),
b AS (SELECT source AS q, doc_id, lang, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars % 997, doc_id) AS rank FROM documents QUALIFY rank <= 60),
f AS (SELECT q, doc_id, coalesce(a.lang, b.lang) AS lang, coalesce(a.n_chars, b.n_chars) AS n_chars, CASE WHEN a.rank IS NULL THEN 'mixed' ELSE 'long' END AS list, a.n_chars::DOUBLE AS s, (b.n_chars % 997)::DOUBLE AS w, round(coalesce(1 / (60.0 + a.rank), 0) + coalesce(1 / (60.0 + b.rank), 0), 9) AS fused FROM a FULL JOIN b USING (q, doc_id))
SELECT q AS query_id, doc_id AS chunk_ref, list || '/' || lang AS source_ref, list, n_chars, s AS semantic_score, w AS keyword_score, fused AS fused_score FROM f QUALIFY row_number() OVER (PARTITION BY q ORDER BY fused DESC, doc_id) <= 50""")
def hybrid_questions(spark, sf_dir):
    x = questions.fused(*_lists(spark, sf_dir), 50)
    return x.select("query_id", "chunk_ref", "source_ref", "metadata.list", "metadata.n_chars", "semantic_score", "keyword_score", F.round("fused_score", 9).alias("fused_score"))


# ---- answers: an order is an answer, its lines are the context


def _used(spark, sf_dir):
    """Each order's answer names its first line by number and its second by reference; every fifth also a line that is not
    there, every third the first line again by reference."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("place"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("paragraph_ref")).distinct()
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"))
    ref = lambda n: F.concat(F.col("query_id").cast("string"), F.lit(f"-{n}"))
    values = F.array_compact(F.array(F.lit("1"), ref(2), F.when(F.col("query_id") % 5 == 0, F.lit("99")), F.when(F.col("query_id") % 3 == 0, ref(1))))
    return answers.used_refs(o.select("query_id", F.posexplode(values).alias("pos", "value")), lines)


_USED = """WITH l AS (SELECT DISTINCT l_orderkey AS q, l_linenumber AS n FROM lineitem),
v AS (SELECT o_orderkey AS q, unnest([1, 2]) AS n, false AS by_key FROM orders UNION ALL SELECT o_orderkey, 99, true FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, 1, false FROM orders WHERE o_orderkey % 3 = 0)"""


@query(_USED + " SELECT DISTINCT q AS query_id, n AS place, q || '-' || n AS paragraph_ref FROM v JOIN l USING (q, n)")
def grounded_refs(spark, sf_dir):
    return _used(spark, sf_dir)[0]


@query(_USED + """, w AS (SELECT q, n, row_number() OVER (PARTITION BY q, n) AS k FROM v)
SELECT w.q AS query_id, CASE WHEN w.n = 99 THEN '99' WHEN w.n = 1 AND w.k = 1 THEN '1' ELSE w.q || '-' || w.n END AS value, 'not in the context' AS rule FROM w LEFT JOIN l USING (q, n) WHERE l.n IS NULL
UNION ALL SELECT q, q || '-' || n, 'used twice' FROM v JOIN l USING (q, n) GROUP BY ALL HAVING count(*) > 1""")
def grounded_errors(spark, sf_dir):
    return _used(spark, sf_dir)[1]


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS q, l_linenumber AS n FROM lineitem), o AS (SELECT o_orderkey AS q FROM orders),
r AS (SELECT q, 'used' AS list, unnest([1, 2, 1]) AS n FROM o UNION ALL SELECT q, 'cited', unnest([1, 9]) FROM o UNION ALL SELECT q, 'images', unnest([2, 4]) FROM o WHERE q % 2 = 0)
SELECT q AS run_id, NULL AS evidence_id, 'answer is empty' AS rule FROM o WHERE q % 7 = 0
UNION ALL SELECT q, q || '-' || n, list || ' twice' FROM r GROUP BY q, n, list HAVING count(*) > 1
UNION ALL SELECT DISTINCT q, q || '-' || r.n, CASE WHEN l.n IS NULL THEN list || ' unknown' ELSE 'images without a picture' END FROM r LEFT JOIN l USING (q, n) WHERE l.n IS NULL OR list = 'images' AND r.n % 4 > 0""")
def synthesis_errors(spark, sf_dir):
    key = F.col("run_id")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), "l_linenumber").distinct()
    evidence = lines.select("run_id", F.concat_ws("-", "run_id", "l_linenumber").alias("evidence_id"), F.when(F.col("l_linenumber") % 4 == 0, F.array(F.lit("images/x.png"))).alias("image_refs"))
    ids = lambda *n: F.array(*[F.concat(key.cast("string"), F.lit(f"-{i}")) for i in n])
    results = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id")).select("run_id", F.when(key % 7 == 0, "  ").otherwise("Yes.").alias("answer"), ids(1, 2, 1).alias("used"), ids(1, 9).alias("cited"), F.when(key % 2 == 0, ids(2, 4)).alias("images"))
    return answers.synthesis_violations(results, evidence)


@query(f"""WITH {_FACTS}, t AS (SELECT chunk_id, paragraph_id, concept, dense_rank() OVER (PARTITION BY chunk_id ORDER BY paragraph_id, concept) AS o FROM facts WHERE ordinal <> 2),
m AS (SELECT chunk_id, concept, min(o) AS o FROM t GROUP BY ALL), g AS (SELECT chunk_id, string_agg(concept, ',' ORDER BY o) AS tags FROM m GROUP BY 1), p AS (SELECT chunk_id, string_agg(DISTINCT paragraph_id, ',' ORDER BY paragraph_id) AS tagged FROM t GROUP BY 1)
SELECT o_orderkey AS chunk_id, coalesce(tags, '') AS tags, coalesce(tagged, '') AS tagged_paragraphs, 'm1' AS embedding_profile, 'v1' AS index_version FROM orders LEFT JOIN g ON g.chunk_id = o_orderkey LEFT JOIN p ON p.chunk_id = o_orderkey""")
def index_inputs(spark, sf_dir):
    f = facts(spark, sf_dir)
    tags = concepts.index_tags(f.select("chunk_id", "paragraph_id").distinct(), f.where("ordinal <> 2"))
    x = records.index_inputs(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id")), tags, "m1", "v1")
    return x.select("chunk_id", F.array_join("tags", ",").alias("tags"), F.array_join("tagged_paragraphs", ",").alias("tagged_paragraphs"), "embedding_profile", "index_version")
