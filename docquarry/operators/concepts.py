"""Concept tags: relations, catalogs, inventories, candidates, traversal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.session import saved


def relations(tagged: DataFrame, chunk: str = "chunk_id") -> DataFrame:
    """paragraph_id, concept, role from rows of chunk tagging results
    (paragraphs: array<struct<paragraph_id, labels: array<struct<label, roles: array<string>>>>>)."""
    x = tagged.select(chunk, F.explode("paragraphs").alias("p")).select(chunk, "p.paragraph_id", F.explode("p.labels").alias("l"))
    return x.select(chunk, "paragraph_id", F.col("l.label").alias("concept"), F.explode("l.roles").alias("role"))


def tagging_violations(tagged: DataFrame, expected: DataFrame, candidates: DataFrame) -> DataFrame:
    """chunk_id, paragraph_id, rule: paragraphs missing, unknown or repeated; labels reused that were no candidates."""
    got = tagged.select("chunk_id", F.explode("paragraphs").alias("p")).select("chunk_id", "p.paragraph_id", "p.labels")
    keys = ["chunk_id", "paragraph_id"]
    missing = expected.select(keys).join(got, keys, "left_anti").select(*keys, F.lit("missing paragraph").alias("rule"))
    unknown = got.join(expected.select(keys), keys, "left_anti").select(*keys, F.lit("unknown paragraph").alias("rule"))
    twice = got.groupBy(keys).count().where("count > 1").select(*keys, F.lit("repeated paragraph").alias("rule"))
    reused = got.select(*keys, F.explode("labels").alias("l")).where(F.col("l.reuse")).select(*keys, T.concept_key(F.col("l.label")).alias("key"))
    bad = reused.join(candidates.select("paragraph_id", T.concept_key(F.col("label")).alias("key")), ["paragraph_id", "key"], "left_anti").select(*keys, F.lit("reused label is no candidate").alias("rule"))
    return missing.unionByName(unknown).unionByName(twice).unionByName(bad)


def chunk_header(header: Column, heading: Column, path: Column, paragraph_path: Column, chunk: Column) -> Column:
    """The first of these that is not blank; paths are joined."""

    def some(c: Column) -> Column:
        return F.when(~T.is_blank(c), T.strip(c))

    return F.coalesce(some(header), some(heading), some(F.array_join(path, " > ")), some(F.array_join(paragraph_path, " > ")), chunk)


def document_catalog(facts: DataFrame, scope: list[str], examples: int = 3, order: tuple[str, ...] = ("chunk_id", "ordinal", "paragraph_id")) -> DataFrame:
    """scope, normalized_label, canonical_label, usage_count, examples from facts
    (scope, concept, paragraph_id, header, excerpt and the order's columns).

    Usage counts distinct paragraphs, however many roles they have. The canonical label is the least by
    (folded, value). Examples are the first ``examples`` paragraphs in order.
    """
    by = [*scope, "normalized_label"]
    keyed = T.with_key(facts, "concept", "normalized_label").where(F.col("normalized_label").isNotNull())
    usage = keyed.withColumn("__folded", T.folded_label(F.col("concept"))).groupBy(*by).agg(F.min(F.struct(F.col("__folded").alias("folded"), F.col("concept").alias("value")))["value"].alias("canonical_label"), F.countDistinct("paragraph_id").alias("usage_count"))
    # The rank stands before the headers and excerpts are brought together, so that its limit holds before the shuffle.
    place = F.dense_rank().over(Window.partitionBy(*by).orderBy(*order))
    first = keyed.select(*by, *order, "header", "excerpt").withColumn("r", place).where(F.col("r") <= examples)
    first = first.groupBy(*by, "r").agg(F.min("header").alias("header"), F.min("excerpt").alias("excerpt"))
    shown = first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "header", "excerpt"))), lambda x: F.struct(x["header"].alias("header"), x["excerpt"].alias("excerpt"))).alias("examples"))
    return usage.join(shown, by).select(*by, "canonical_label", "usage_count", "examples")


def global_catalog(observations: DataFrame, examples: int = 3) -> DataFrame:
    """One row for each normalized_label of observations (document_ref, source_version, normalized_label,
    canonical_label, usage_count, examples): usage is the sum over documents; examples are the first
    distinct by (header, excerpt); first_seen is the least (document_ref, source_version)."""
    base = observations.groupBy("normalized_label").agg(
        F.sum("usage_count").alias("usage_count"),
        F.min(F.struct(T.casefold(F.col("canonical_label")).alias("folded"), F.col("canonical_label").alias("value")))["value"].alias("canonical_label"),
        F.min(F.struct("document_ref", "source_version")).alias("first_seen"),
    )
    shown = observations.select("normalized_label", F.explode("examples").alias("e")).select("normalized_label", "e.header", "e.excerpt").distinct()
    rank = F.row_number().over(Window.partitionBy("normalized_label").orderBy("header", "excerpt"))
    first = shown.withColumn("r", rank).where(F.col("r") <= examples).groupBy("normalized_label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("r", "header", "excerpt"))), lambda x: F.struct(x["header"].alias("header"), x["excerpt"].alias("excerpt"))).alias("examples")
    )
    return base.join(first, "normalized_label", "left")


def rebuilt_catalog(observations: DataFrame, previous: DataFrame, now: Column, examples: int = 3) -> DataFrame:
    """``global_catalog`` with first_seen_source, created_at and updated_at: a label that ``previous`` (normalized_label,
    created_at) holds keeps the least created_at of it, others are created ``now``; labels without observations go."""
    before = previous.groupBy("normalized_label").agg(F.min("created_at").alias("created_at"))
    x = global_catalog(observations, examples).join(before, "normalized_label", "left")
    return x.select("normalized_label", "canonical_label", "usage_count", "examples", F.col("first_seen.document_ref").alias("first_seen_source"), F.coalesce("created_at", now).alias("created_at"), now.alias("updated_at"))


def catalog_version(catalog: DataFrame) -> DataFrame:
    """sha256 of the catalog's entries as JSON, in order of label. The whole catalog is one text by contract."""
    rows = catalog.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("normalized_label", F.to_json(F.struct("canonical_label", "normalized_label", "usage_count")).alias("j")))), lambda x: x["j"]).alias("j"))
    return rows.select(F.sha2(F.concat(F.lit("["), F.array_join("j", ","), F.lit("]")), 256).alias("catalog_version"))


def inventory(facts: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """scope, concept, first_seq, roles (role, paragraphs), parents (chunk, rank) from relations of retrieved chunks
    (seq, paragraph_id, concept, role, chunk_id, chunk_rank): concepts keep the order of first sight."""
    by = [*(scope or []), "concept"]
    roles = facts.groupBy(*by, "role").agg(F.countDistinct("paragraph_id").alias("n"))
    roles = roles.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("role", "n"))).alias("roles"))
    parents = facts.select(*by, "chunk_rank", "chunk_id").distinct().groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("chunk_rank", "chunk_id"))).alias("parents"))
    first = facts.groupBy(*by).agg(F.min("seq").alias("first_seq"))
    return first.join(roles, by).join(parents, by)


def deduplicated_candidates(candidates: DataFrame, scope: list[str]) -> DataFrame:
    """Of candidates (scope, label, rank, score) with equal keys the best by (rank, -score)."""
    keyed = T.with_key(candidates, "label", "key").where(F.col("key").isNotNull())
    best = F.min(F.struct("rank", (-F.col("score")).alias("minus"), "label"))
    return keyed.groupBy(*scope, "key").agg(best.alias("b")).select(*scope, "key", "b.rank", (-F.col("b.minus")).alias("score"), "b.label")


def ranked_candidates(candidates: DataFrame, query: Column, limit: int, scope: list[str]) -> DataFrame:
    """The first candidates of each scope: exact key first, then more shared words, rank, key."""
    key = T.concept_key(query)
    x = deduplicated_candidates(candidates, scope).withColumn("q", key)
    shared = F.size(F.array_intersect(F.array_distinct(F.split("q", " ")), F.array_distinct(F.split("key", " "))))
    x = x.withColumns({"exact": (F.col("key") == F.col("q")), "shared": shared})
    order = Window.partitionBy(*scope).orderBy(F.desc("exact"), F.desc("shared"), "rank", "key")
    return x.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).drop("q")


def traversal_rows(selected: DataFrame, facts: DataFrame) -> DataFrame:
    """For each selected (selection, concept, role, chunk_id: a row for each parent chunk): its paragraphs, once each."""
    s = T.with_key(selected, "concept", "key").select("selection", "key", "role", "chunk_id").distinct()
    f = T.with_key(facts, "concept", "key").select("key", "role", "paragraph_id", "chunk_id")
    return f.join(s, ["key", "role", "chunk_id"]).select("selection", "paragraph_id").distinct()


def joined_refs(met: DataFrame, sep: str = ",", most: int = 500_000) -> DataFrame:
    """selection, paragraph_refs: the paragraphs of ``traversal_rows`` sorted and joined. Ranges of about ``most`` rows are
    joined by themselves, so that only a selection's pieces of text meet in one task."""
    met = saved(met, "traversal-rows")
    n = max(1, -(-met.count() // most))
    ranged = met.repartitionByRange(n, "selection", "paragraph_id").withColumn("part", F.spark_partition_id())
    pieces = ranged.groupBy("selection", "part").agg(F.array_join(F.array_sort(F.collect_list("paragraph_id")), sep).alias("refs"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("part", "refs"))), lambda x: x["refs"])
    return pieces.groupBy("selection").agg(F.array_join(whole, sep).alias("paragraph_refs"))


def traversal(selected: DataFrame, facts: DataFrame) -> DataFrame:
    """For each selected (selection, concept, role, parents: array of chunks): its paragraphs, sorted."""
    met = traversal_rows(selected.select("selection", "concept", "role", F.explode("parents").alias("chunk_id")), facts)
    return selected.select("selection").join(met.groupBy("selection").agg(F.array_sort(F.collect_set("paragraph_id")).alias("paragraph_refs")), "selection", "left")


def traversal_violations(selected: DataFrame, facts: DataFrame, paras: DataFrame) -> DataFrame:
    """key, rule: what makes a traversal an error. selected: selection, concept, role, chunk_id (a row for each parent
    chunk); facts: paragraph_id, chunk_id, concept, role; paras: paragraph_id."""
    f = T.with_key(facts, "concept", "key")
    relation = F.concat_ws("/", "paragraph_id", "key", "role")
    twice = f.groupBy("paragraph_id", "key", "role").count().where("count > 1").select(relation.alias("key"), F.lit("relation given twice").alias("rule"))
    lost = facts.select("paragraph_id").distinct().join(paras, "paragraph_id", "left_anti").select(F.col("paragraph_id").alias("key"), F.lit("relation of a missing paragraph").alias("rule"))
    met = traversal_rows(selected, facts).select("selection").distinct()
    empty = selected.select("selection").distinct().join(met, "selection", "left_anti").select(F.col("selection").alias("key"), F.lit("pair without paragraph").alias("rule"))
    return twice.unionByName(lost).unionByName(empty)


def index_tags(paras: DataFrame, facts: DataFrame, chunk: str = "chunk_id") -> DataFrame:
    """Per chunk: its distinct tags in order of paragraph_id and first label, and the tagged paragraphs."""
    per = facts.groupBy(chunk, "paragraph_id").agg(F.array_sort(F.collect_set("concept")).alias("tags"))
    rows = paras.select(chunk, "paragraph_id").join(per, [chunk, "paragraph_id"], "left")
    return rows.groupBy(chunk).agg(
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("tags").isNotNull(), F.struct("paragraph_id", "tags")))), lambda x: x["tags"]))).alias("tags"),
        F.array_sort(F.collect_set(F.when(F.col("tags").isNotNull(), F.col("paragraph_id")))).alias("tagged_paragraphs"),
    )


def distinct_concepts(facts: DataFrame) -> DataFrame:
    """Concepts by (folded, value)."""
    return facts.select("concept").distinct().withColumn("folded", T.casefold(F.col("concept"))).orderBy("folded", "concept")


def run_summary(tagged: DataFrame, facts: DataFrame) -> DataFrame:
    """Distinct chunks, paragraphs by status, relations, of tagged paragraphs (chunk_id, paragraph_id, status)."""
    a = tagged.agg(F.countDistinct("chunk_id").alias("chunks"), F.count("*").alias("paragraphs"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))
    return a.crossJoin(facts.agg(F.count("*").alias("relations")))  # one row each


def chunk_payload(paras: DataFrame, chunk: str = "chunk_id") -> DataFrame:
    """Per chunk its paragraphs, in order of ordinal and id."""
    return paras.groupBy(chunk).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "paragraph_id", "text"))), lambda x: F.struct(x["paragraph_id"].alias("paragraph_id"), x["text"].alias("text"))).alias("paragraphs"))
