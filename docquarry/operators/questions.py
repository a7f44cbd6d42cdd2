"""The question flow for many questions at once: hits, scope, chosen concepts and roles, images, limits, rendering.

One row of ``questions`` is one question; each step is a join or an aggregate over all of them. Paragraphs move as ids,
ranks and word counts until the limits have chosen them; only then are their texts fetched.

Defined results: a question without hits is ``no_retrieval_context``; without relations in its hit chunks, or
without a selection, ``no_relevant_concept_role``; one whose selection is wrong, whose relations repeat, or whose first
paragraph alone passes the limit is ``refused`` with the rules it breaks; all others are ``ready``. A null text has no
words and is rendered as an empty one. Rows of unknown questions give nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.operators import answers, evidence, records
from docquarry.session import saved

Q = "query_id"


@dataclass(frozen=True)
class Bundles:
    """status: query_id, status, rules. context: query_id, place, paragraph_id, chunk_id, attached (an image's
    paragraph, which is not cited). roles: query_id, n, concept, role, places, parents. markdown: query_id, markdown."""

    status: DataFrame
    context: DataFrame
    roles: DataFrame
    markdown: DataFrame


def selection_violations(selections: DataFrame, offered: DataFrame) -> DataFrame:
    """query_id, rule. selections: query_id, pos, concept, roles, selection_rank; offered: query_id, concept, role."""
    told = F.array_size("roles")
    own = (
        selections.select(Q, F.explode(F.array(
            F.when(F.coalesce(F.trim("concept"), F.lit("")) == "", "concept must not be empty"),
            F.when(F.coalesce(told, F.lit(0)) == 0, "roles must not be empty"),
            F.when(F.size(F.array_distinct("roles")) < told, "roles must be distinct"),
            F.when(F.coalesce(F.col("selection_rank") < 1, F.lit(True)), "rank must be positive"),
        )).alias("rule"))
        .where("rule IS NOT NULL")
    )
    s = selections.select(Q, F.trim("concept").alias("concept"), "roles", "selection_rank")
    twice = s.groupBy(Q, "concept").count().where("count > 1").select(Q, F.lit("concept selected twice").alias("rule"))
    ranks = s.groupBy(Q, "selection_rank").count().where("count > 1").select(Q, F.lit("rank given twice").alias("rule"))
    known = offered.groupBy(Q, "concept").agg(F.collect_set("role").alias("__known"))
    met = s.join(known, [Q, "concept"], "left")
    rule = F.when(F.col("__known").isNull(), "concept is not offered").when(F.size(F.array_except("roles", "__known")) > 0, "role is not offered")
    return own.unionByName(twice).unionByName(ranks).unionByName(met.select(Q, rule.alias("rule")).where("rule IS NOT NULL")).distinct()


def bundles(questions: DataFrame, hits: DataFrame, relations: DataFrame, paras: DataFrame, selections: DataFrame, max_paragraphs: int, max_words: int) -> Bundles:
    """questions: query_id, question; hits: query_id, chunk_id, rank; relations: paragraph_id, concept, role; paras:
    paragraph_id, chunk_id, ordinal, source, header, nested, pages, image_refs, text; selections: query_id, pos,
    concept, roles, selection_rank.

    A selected pair takes its paragraphs within the chunks of its concept, in order of id, and pairs follow each other as
    selected; a question that asks for a picture gets the paragraphs with images of the same chunks after them. The
    count and the words of paragraphs are limited over both.
    """
    if min(max_paragraphs, max_words) < 1:
        raise ValueError("limits must be positive")
    hits = hits.join(questions.select(Q), Q, "left_semi").groupBy(Q, "chunk_id").agg(F.min("rank").alias("rank"))
    narrow = paras.select("paragraph_id", "chunk_id", "ordinal", (F.coalesce(F.size("image_refs"), F.lit(0)) > 0).alias("pictured"), F.coalesce(T.word_count(F.col("text")), F.lit(0)).alias("words"))
    candidates = saved(narrow.join(hits, "chunk_id"), "question-candidates")
    keyed = T.with_key(relations.withColumn("concept", F.trim("concept")), "concept", "key")
    facts = saved(candidates.select(Q, "paragraph_id", "chunk_id", "rank").join(keyed.select("paragraph_id", "concept", "key", "role"), "paragraph_id"), "question-facts")

    asked = selections.join(questions.select(Q), Q, "left_semi").join(facts.select(Q).distinct(), Q, "left_semi")
    repeated = facts.groupBy(Q, "paragraph_id", "key", "role").count().where("count > 1").select(Q, F.lit("relation given twice").alias("rule"))
    wrong = saved(selection_violations(asked, facts.select(Q, "concept", "role").distinct()).unionByName(repeated.join(asked.select(Q).distinct(), Q, "left_semi")).distinct(), "question-rules")

    sound = asked.join(wrong.select(Q).distinct(), Q, "left_anti").withColumn("concept", F.trim("concept"))
    pairs = T.with_key(sound, "concept", "key").select(Q, "pos", "concept", "key", F.posexplode("roles").alias("at", "role"))
    parents = facts.select(Q, "concept", "chunk_id", "rank").distinct()
    inside = pairs.join(parents.drop("rank"), [Q, "concept"])
    met = saved(facts.select(Q, "key", "role", "chunk_id", "paragraph_id").join(inside, [Q, "key", "role", "chunk_id"]).select(Q, "pos", "at", "concept", "role", "paragraph_id").distinct(), "question-pairs")

    first = met.groupBy(Q, "paragraph_id").agg(F.min(F.struct("pos", "at")).alias("first"))
    chosen = candidates.join(first, [Q, "paragraph_id"]).select(Q, "paragraph_id", "chunk_id", "words", F.lit(False).alias("attached"), F.col("first.pos").alias("o1"), F.col("first.at").alias("o2"))
    for_images = questions.where(records.wants_image(F.col("question"))).select(Q)
    own = candidates.where("pictured").join(for_images, Q, "left_semi")
    pictures = own.join(chosen.select(Q, "chunk_id").distinct(), [Q, "chunk_id"], "left_semi").join(first.select(Q, "paragraph_id"), [Q, "paragraph_id"], "left_anti")
    pictures = pictures.select(Q, "paragraph_id", "chunk_id", "words", F.lit(True).alias("attached"), F.col("rank").alias("o1"), F.col("ordinal").alias("o2"))

    by = Window.partitionBy(Q).orderBy("attached", "o1", "o2", "paragraph_id")
    placed = chosen.unionByName(pictures).withColumn("place", F.row_number().over(by)).where(F.col("place") <= max_paragraphs)
    placed = saved(placed.withColumn("running", F.sum("words").over(by.rowsBetween(Window.unboundedPreceding, 0))), "question-places")
    too_long = placed.where((F.col("place") == 1) & (F.col("running") > max_words)).select(Q, F.lit("first paragraph exceeds the limit").alias("rule"))
    context = placed.where(F.col("running") <= max_words).select(Q, "place", "paragraph_id", "chunk_id", "attached")

    offered = parents.groupBy(Q, "concept").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("parents"))
    order = F.struct("pos", "at").alias("n")
    kept = met.join(context.where("NOT attached").select(Q, "paragraph_id", "place"), [Q, "paragraph_id"])
    roles = kept.groupBy(Q, "pos", "at", "concept", "role").agg(F.transform(F.array_sort(F.collect_list(F.struct("paragraph_id", "place"))), lambda p: p["place"]).alias("places"))
    roles = roles.join(offered, [Q, "concept"]).select(Q, order, "concept", "role", "places", "parents")

    labels = relations.withColumn("concept", F.trim("concept"))
    cited = context.where("NOT attached").drop("chunk_id", "attached")
    shown = evidence.with_labels(paras.join(cited, "paragraph_id").withColumn("text", F.coalesce("text", F.lit(""))), labels.join(cited.select("paragraph_id").distinct(), "paragraph_id", "left_semi"))
    markdown = answers.answer_context(questions.select(Q, "question"), shown, roles, Q)

    flags = [df.select(Q).distinct().withColumn(name, F.lit(True)) for df, name in ((hits, "hit"), (asked, "some"))]
    rules = wrong.unionByName(too_long).groupBy(Q).agg(F.array_sort(F.collect_set("rule")).alias("rules"))
    x = questions.select(Q).join(flags[0], Q, "left").join(flags[1], Q, "left").join(rules, Q, "left")
    status = F.when(F.col("hit").isNull(), "no_retrieval_context").when(F.col("some").isNull(), "no_relevant_concept_role").when(F.col("rules").isNotNull(), "refused").otherwise("ready")
    return Bundles(x.select(Q, status.alias("status"), F.coalesce("rules", F.expr("cast(array() as array<string>)")).alias("rules")), context, roles, markdown)


def fused(semantic: DataFrame, lexical: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists for each question (query_id, chunk_ref, source_ref, rank, score,
    metadata): query_id, chunk_ref, source_ref, metadata, semantic_score, keyword_score, fused_score, rank.

    What both lists have keeps the source and the metadata of the semantic one. A chunk twice in a list adds up, and its
    later score counts. Lists are top-k results, so a question's window holds two of them.
    """
    none = F.lit(None).cast("double")
    a = semantic.select(Q, "chunk_ref", "source_ref", "rank", F.col("score").alias("s"), none.alias("w"), "metadata", F.lit(0).alias("l"))
    b = lexical.select(Q, "chunk_ref", "source_ref", "rank", none.alias("s"), F.col("score").alias("w"), "metadata", F.lit(1).alias("l"))
    seen = F.struct("l", "rank")
    x = a.unionByName(b).groupBy(Q, "chunk_ref").agg(
        F.min_by(F.struct("source_ref", "metadata"), seen).alias("m"), F.max_by("s", F.struct(F.col("l") == 0, F.col("rank"))).alias("semantic_score"), F.max_by("w", F.struct(F.col("l") == 1, F.col("rank"))).alias("keyword_score"),
        F.round(F.sum(1 / (F.lit(constant) + F.col("rank"))), 12).alias("fused_score"),  # equal sums tie, whatever their order
    )
    rank = F.row_number().over(Window.partitionBy(Q).orderBy(F.desc("fused_score"), "chunk_ref"))
    return x.select(Q, "chunk_ref", "m.source_ref", "m.metadata", "semantic_score", "keyword_score", "fused_score", rank.alias("rank")).where(F.col("rank") <= k)
