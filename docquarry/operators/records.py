"""Projections and checks of records: index inputs, knowledge rows, events, scopes, images."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import text as T

# How a question asks for the web, and the nouns and verbs by which it asks for a picture.
WEB_REQUEST = r"(?U)\b(?:tra(?:\s+cứu)?|tìm(?:\s+kiếm)?|search(?:\s+the)?)\s+(?:(?:trên|on)\s+)?(?:w?web|internet|mạng)\b"
PICTURE_NOUN = r"(?U)\b(?:figure|image|diagram|illustration)\b"
PICTURE_VERB = r"(?U)\b(?:include|show|display|attach|provide)\b"

#: Keys that a record's own columns have in an index; metadata must not use them.
RESERVED = ("chunk_id", "document_ref", "source_version", "embedding_profile", "access_scope")


def scope_violations(rows: DataFrame, key: str, expected: dict[str, Any]) -> DataFrame:
    """key, field: fields of a row that are not what the command says."""
    wrong = F.filter(F.array(*[F.when(~F.col(c).eqNullSafe(F.lit(v)), F.lit(c)) for c, v in expected.items()]), lambda x: x.isNotNull())
    return rows.select(key, F.explode(wrong).alias("field"))


def index_inputs(chunks: DataFrame, tags: DataFrame, profile: str, index_version: str) -> DataFrame:
    """Chunks with tags, tagged_paragraphs (see ``concepts.index_tags``), profile and index version."""
    none = F.expr("cast(array() as array<string>)")
    x = chunks.join(tags, "chunk_id", "left")
    return x.withColumns({"tags": F.coalesce("tags", none), "tagged_paragraphs": F.coalesce("tagged_paragraphs", none), "embedding_profile": F.lit(profile), "index_version": F.lit(index_version)})


def tagged_paragraphs(paras: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """paras with generated (all labels, in order) and tags (resolved, distinct, in order), and what does not
    fit: paragraphs without a result, results without a paragraph. labels: paragraph_id, pos, generated, resolved."""
    per = labels.groupBy("paragraph_id").agg(F.array_sort(F.collect_list(F.struct("pos", "generated", "resolved"))).alias("l"))
    x = paras.join(per, "paragraph_id").withColumns({"generated": F.transform("l", lambda v: v["generated"]), "tags": F.array_distinct(F.transform("l", lambda v: v["resolved"]))}).drop("l")
    missing = paras.join(per, "paragraph_id", "left_anti").select("paragraph_id", F.lit("no result").alias("rule"))
    unknown = per.join(paras, "paragraph_id", "left_anti").select("paragraph_id", F.lit("unknown paragraph").alias("rule"))
    return x, missing.unionByName(unknown)


def knowledge(chunks: DataFrame) -> DataFrame:
    """Knowledge rows of indexed chunks: page -1 if unknown, the heading as path if there is none."""
    path = F.when(F.size("heading_path") > 0, F.col("heading_path")).when(F.col("heading").isNotNull(), F.array("heading")).otherwise(F.expr("cast(array() as array<string>)"))
    return chunks.select(
        "chunk_id", F.col("document_ref").alias("document_id"), "source_version", F.concat(F.lit("knowledge://"), "document_ref", F.lit("/"), "chunk_id").alias("source_ref"), "search_text",
        F.sha2("search_text", 256).alias("content_hash"), F.coalesce("page_start", F.lit(-1)).alias("page_start"), F.coalesce("page_end", F.lit(-1)).alias("page_end"), path.alias("heading_path"), F.coalesce("tags", F.expr("cast(array() as array<string>)")).alias("tags"),
    )


def knowledge_violations(rows: DataFrame) -> DataFrame:
    """Rows whose pages run backwards."""
    return rows.where((F.col("page_start") >= 0) & (F.col("page_end") >= 0) & (F.col("page_end") < F.col("page_start"))).select("chunk_id")


def plain_metadata(metadata: Column) -> Column:
    """Metadata (map of arrays) without empty lists."""
    return F.map_filter(metadata, lambda k, v: F.size(v) > 0)


def metadata_violations(rows: DataFrame, key: str, metadata: str) -> DataFrame:
    """key, name: metadata under reserved or blank names."""
    return rows.select(key, F.explode(F.filter(F.map_keys(metadata), lambda k: k.isin(*RESERVED) | T.is_blank(k))).alias("name"))


def allowed_events(events: DataFrame, allowed: DataFrame, collection: str = "document_chunks") -> DataFrame:
    """Events without the upserts of chunks that are not allowed; deletes and other collections pass."""
    a = allowed.select(F.col("chunk_id").alias("record_id"), F.lit(True).alias("__ok")).distinct()
    x = events.join(a, "record_id", "left")
    return x.where((F.col("operation") != "upsert") | (F.col("collection") != collection) | F.col("__ok").isNotNull()).drop("__ok")


def appended(events: DataFrame, more: DataFrame, key: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """Both lists, and the ids that occur twice (an error)."""
    both = events.unionByName(more)
    return both, both.groupBy(key).count().where("count > 1").select(key)


def safe_images(rows: DataFrame, refs: str, known: DataFrame | None = None) -> DataFrame:
    """rows with their safe references, distinct and in order, and image_errors: one note if any was refused.

    known: the references that exist (column ref); without it every safe one counts.
    """
    x, good = rows, T.is_plain_image_ref
    if known is not None:
        k = known.select(F.col("ref").alias("__r"), F.lit(True).alias("__k")).distinct()
        lists = rows.select(refs).distinct()  # looked up once for each distinct list
        found = lists.withColumn("__r", F.explode(refs)).join(k, "__r").groupBy(refs).agg(F.collect_set("__r").alias("__found"))
        x = rows.join(found, refs, "left").withColumn("__found", F.coalesce("__found", F.expr("cast(array() as array<string>)")))
        good = lambda r: T.is_plain_image_ref(r) & F.array_contains("__found", r)
    x = x.withColumn("__safe", F.array_distinct(F.filter(T.nfc_only(F.col(refs)), good)))
    errors = F.when(F.size("__safe") < F.size(F.array_distinct(refs)), F.array(F.lit("image unavailable"))).otherwise(F.expr("cast(array() as array<string>)"))
    return x.withColumn("image_errors", errors).withColumn(refs, F.col("__safe")).drop("__safe", "__found")


def unsafe_images(rows: DataFrame, key: str, refs: str) -> DataFrame:
    """key, ref: the references that a strict gate refuses, once each; a null one is refused, a null list has none."""
    x = rows.select(key, F.explode(refs).alias("ref"))
    return x.where(~F.coalesce(T.is_safe_image_ref(F.col("ref")), F.lit(False))).distinct()


def wants_web(question: Column) -> Column:
    """The question asks for a web search, in English or Vietnamese."""
    return T.casefold(question).rlike(WEB_REQUEST)


def wants_image(question: Column) -> Column:
    """The question asks to show a picture: a noun and a verb for it."""
    q = T.casefold(question)
    return q.rlike(PICTURE_NOUN) & q.rlike(PICTURE_VERB)


def attached_images(selected: DataFrame, paras: DataFrame, scope: list[str], chunk: str = "chunk_id", ref: str = "paragraph_ref") -> DataFrame:
    """Paragraphs with images of the selected chunks that are not selected themselves."""
    own = paras.where(F.size("image_refs") > 0)
    return own.join(selected.select(*scope, chunk).distinct(), [*scope, chunk], "left_semi").join(selected.select(*scope, ref), [*scope, ref], "left_anti")


def chosen(choices: DataFrame, keys: DataFrame, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """Choices by selected key, and the selections that are unknown or repeated (errors)."""
    picked = choices.join(keys.select(*scope, "key").distinct(), [*scope, "key"], "left_semi")
    unknown = keys.join(choices, [*scope, "key"], "left_anti").select(*scope, "key", F.lit("unknown key").alias("rule"))
    twice = keys.groupBy(*scope, "key").count().where("count > 1").select(*scope, "key", F.lit("repeated key").alias("rule"))
    return picked, unknown.unionByName(twice)


def best_ranks(hits: DataFrame, scope: list[str], chunk: str = "chunk_id") -> DataFrame:
    """The best rank of each chunk."""
    return hits.groupBy(*scope, chunk).agg(F.min("rank").alias("rank"))


def in_hit_chunks(facts: DataFrame, hits: DataFrame, chunk: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """Relations of the hit chunks, and those outside (an error where scoping is strict)."""
    h = hits.select(chunk).distinct()
    return facts.join(h, chunk, "left_semi"), facts.join(h, chunk, "left_anti")


def collected_pages(paras: DataFrame, scope: list[str], order: list[str], pages: str = "pages") -> DataFrame:
    """A scope's page labels in order, each once."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(pages).alias("__p"))))
    return paras.groupBy(*scope).agg(F.array_distinct(F.flatten(F.transform(rows, lambda r: r["__p"]))).alias("pages"))


def distinct_sources(hits: DataFrame, scope: list[str], source: str = "source_ref", rank: str = "rank") -> DataFrame:
    """A scope's sources in order of their first hit."""
    first = hits.groupBy(*scope, source).agg(F.min(rank).alias("__first"))
    return first.groupBy(*scope).agg(F.transform(F.array_sort(F.collect_list(F.struct("__first", source))), lambda x: x[source]).alias("sources"))


def page_labels(start: Column, end: Column) -> Column:
    """Distinct page numbers from 0 up, as text."""
    return F.array_distinct(F.transform(F.filter(F.array(start, end), lambda p: p.isNotNull() & (p >= 0)), lambda p: p.cast("string")))


def relabelled(answer: Column, refs: list[str]) -> Column:
    """The answer with internal references as [n], longer ones first, so that none is cut by a shorter."""
    for n, ref in sorted(enumerate(refs, 1), key=lambda x: (-len(x[1]), x[0])):
        answer = F.replace(answer, F.lit(ref), F.lit(f"[{n}]"))
    return answer


def restored_aliases(results: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results (chunk_id, alias …) with the paragraph of their alias, and unknown, repeated, missing aliases."""
    key = ["chunk_id", "alias"]
    good = results.join(aliases, key)
    unknown = results.join(aliases, key, "left_anti").select(*key, F.lit("unknown alias").alias("rule"))
    twice = results.groupBy(*key).count().where("count > 1").select(*key, F.lit("repeated alias").alias("rule"))
    missing = aliases.join(results, key, "left_anti").select(*key, F.lit("missing alias").alias("rule"))
    return good, unknown.unionByName(twice).unionByName(missing)


def aliases(paras: DataFrame) -> DataFrame:
    """chunk_id, alias (p1, p2 …), paragraph_id by ordinal."""
    n = F.row_number().over(Window.partitionBy("chunk_id").orderBy("ordinal"))
    return paras.select("chunk_id", F.concat(F.lit("p"), n.cast("string")).alias("alias"), "paragraph_id")


def relation_differences(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Relations on one side alone, with multiplicity: must be empty."""
    columns = expected.columns
    a = expected.exceptAll(found.select(*columns)).withColumn("side", F.lit("missing"))
    return a.unionByName(found.select(*columns).exceptAll(expected).withColumn("side", F.lit("extra")))


def remapped(cached: DataFrame, paras: DataFrame) -> DataFrame:
    """Cached labels by position given to a new document's paragraphs: content_sha, pos join by place. The cache grows with
    the texts, so it is not sent to all tasks."""
    return paras.join(cached.hint("merge"), ["content_sha", "ordinal"], "left")


def started(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """requests (run_id, document_ref, source_version) with outcome: resumed (failed before), same (known),
    mismatch (known under another identity), busy (the document has another active run), started."""
    r = runs.select("run_id", F.col("document_ref").alias("__d"), F.col("source_version").alias("__v"), F.col("status").alias("__s"))
    active = runs.where(F.col("status").isin("processing", "pending")).groupBy("document_ref").agg(F.min("run_id").alias("__active"))
    x = requests.join(r, "run_id", "left").join(active, "document_ref", "left")
    first = F.row_number().over(Window.partitionBy("document_ref").orderBy(F.col("__s").isNotNull().desc(), "run_id")) == 1
    outcome = (
        F.when(F.col("__s").isNotNull() & ((F.col("__d") != F.col("document_ref")) | (F.col("__v") != F.col("source_version"))), "mismatch")
        .when(F.col("__s") == "failed", "resumed")
        .when(F.col("__s").isNotNull(), "same")
        .when(F.col("__active").isNotNull() | ~first, "busy")
        .otherwise("started")
    )
    return x.withColumn("outcome", outcome).drop("__d", "__v", "__s", "__active")


def previous_versions(documents: DataFrame, commands: DataFrame) -> DataFrame:
    """The active version of each command's document, if it is another."""
    d = documents.select("document_ref", "active_version")
    return commands.join(d, "document_ref").where(F.col("active_version").isNotNull() & (F.col("active_version") != F.col("source_version"))).select("document_ref", F.col("active_version").alias("previous_version"))


def live_candidates(saved: DataFrame, now: Column, capacity: int = 256) -> DataFrame:
    """Candidate sets (token, saved_at, ttl_seconds) that have not expired, the last ``capacity`` saved."""
    live = saved.where(F.unix_micros("saved_at") + F.col("ttl_seconds").cast("long") * 1000000 > F.unix_micros(now))
    return live.orderBy(F.desc("saved_at"), F.desc("token")).limit(capacity)


def rendered_roles(question: str, inventory: DataFrame) -> DataFrame:
    """One Markdown text that lists the inventory (a bounded result of retrieval) for role selection."""
    # The lines' wording is fixed.
    roles = F.transform("roles", lambda r: F.concat(F.lit("- Available role: "), r["role"], F.lit(" — "), r["n"].cast("string"), F.lit(" paragraphs")))
    parents = F.concat(F.lit("- Parent chunks: "), F.array_join(F.transform("parents", lambda p: F.concat(p["chunk_id"].cast("string"), F.lit(" (rank "), p["chunk_rank"].cast("string"), F.lit(")"))), ", "))
    block = F.concat_ws("\n", F.concat(F.lit("### Concept: "), F.col("concept")), F.lit(""), F.array_join(roles, "\n"), parents, F.lit(""))
    head = "\n".join(["# Concept and Role Selection", "", "## User question", "", question, "", "## Candidate concepts from retrieved chunks", "", ""])
    rows = inventory.groupBy().agg(F.array_sort(F.collect_list(F.struct("first_seq", "concept", block.alias("b")))).alias("r"))
    return rows.select(F.concat(F.lit(head), F.array_join(F.transform("r", lambda x: x["b"]), "\n")).alias("markdown"))


def rendered_evidence(rows: DataFrame, scope: list[str], order: str) -> DataFrame:
    """scope, text: evidence records (evidence_id, kind, source, chunk, paragraph, page, url, image_refs, text) for
    synthesis. An empty chunk or paragraph is left out like a null."""
    part = lambda name, c: F.when(F.col(c).cast("string") != "", F.concat(F.lit(f"{name}="), F.col(c).cast("string")))
    inside = F.concat_ws(", ", part("chunk", "chunk"), part("paragraph", "paragraph"), part("page", "page"), part("url", "url"))
    images = F.coalesce(F.col("image_refs"), F.expr("cast(array() as array<string>)"))
    n = F.row_number().over(Window.partitionBy(*scope).orderBy(order))
    # The lines' wording is fixed.
    body = F.concat_ws(
        "\n", F.concat(F.lit("- evidence_id: "), F.col("evidence_id")), F.concat(F.lit("  citation_label: ["), F.col("__n").cast("string"), F.lit("]")), F.concat(F.lit("  source_type: "), F.col("kind")),
        F.concat(F.lit("  source: "), F.coalesce("source", "url", F.lit("unknown source"))), F.concat(F.lit("  scope: "), F.when(inside != "", inside).otherwise(F.lit("unspecified"))), F.concat(F.lit("  image_refs: "), F.when(F.size(images) > 0, F.array_join(images, ", ")).otherwise(F.lit("none"))), F.concat(F.lit("  text: "), F.col("text")),
    )
    x = rows.withColumn("__n", n).select(*scope, "__n", body.alias("b"))
    head = "Use the following evidence records as the complete source:"
    return x.groupBy(*scope).agg(F.concat(F.lit(head + "\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", "b"))), lambda v: v["b"]), "\n")).alias("text"))


#: Retry delay in seconds before attempt n (from 1), doubling; the server's own wish wins if it is longer.
def retry_delay(attempt: int, backoff: float, retry_after: float | None = None, jitter: float = 0.0) -> float:
    return max(backoff * 2 ** (attempt - 1) * (1 + jitter), retry_after or 0.0)
