"""Bundles and answers: what retrieval hands on, with its status, and what an answer may cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.functions.ids import concept_record_id, evidence_id

NO_STRINGS = "cast(array() as array<string>)"


def evidence_bundles(hits: DataFrame, queries: DataFrame, scope: str = "query_id") -> DataFrame:
    """A row for each query: its hit chunks in order, images in order of first sight, version and status.

    hits: scope, rank, chunk_ref, version, text, image_refs. Status is ready, no matching evidence, several
    versions, or missing text.
    """
    rows = F.array_sort(F.collect_list(F.struct("rank", "chunk_ref", "image_refs")))
    x = hits.groupBy(scope).agg(rows.alias("r"), F.min("version").alias("version"), F.count_distinct("version").alias("versions"), F.count_if(F.col("text").isNull() | T.is_blank(F.col("text"))).alias("blank"))
    x = queries.select(scope).join(x, scope, "left")
    status = F.when(F.col("r").isNull(), "no matching evidence").when(F.col("versions") > 1, "several versions").when(F.col("blank") > 0, "missing text").otherwise("ready")
    refs = F.coalesce(F.transform("r", lambda v: v["chunk_ref"]), F.expr(NO_STRINGS))
    images = F.coalesce(F.array_distinct(F.flatten(F.transform("r", lambda v: F.coalesce(v["image_refs"], F.expr(NO_STRINGS))))), F.expr(NO_STRINGS))
    return x.select(scope, status.alias("status"), "version", refs.alias("selected_refs"), images.alias("image_refs"))


def document_searches(hits: DataFrame, paras: DataFrame, queries: DataFrame, scope: str = "query_id") -> DataFrame:
    """A row for each query: hits, paragraphs, pages (of paragraphs in order, else of hits), confidence, status
    (no_hits, no_context, ready). hits: scope, rank, scores, pages; paras: scope, place, pages."""
    score = F.coalesce("fused_score", "semantic_score", "keyword_score")
    h = hits.groupBy(scope).agg(
        F.count("*").alias("hits"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.max(score))).alias("confidence"), F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "pages"))), lambda v: v["pages"]))).alias("hit_pages")
    )
    p = paras.groupBy(scope).agg(F.count("*").alias("paragraphs"), F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "pages"))), lambda v: v["pages"]))).alias("pages"))
    x = queries.select(scope).join(h, scope, "left").join(p, scope, "left")
    status = F.when(F.col("hits").isNull(), "no_hits").when(F.col("paragraphs").isNull(), "no_context").otherwise("ready")
    pages = F.when(F.size(F.coalesce("pages", F.expr(NO_STRINGS))) > 0, F.col("pages")).otherwise(F.coalesce("hit_pages", F.expr(NO_STRINGS)))
    return x.select(scope, F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("paragraphs", F.lit(0)).alias("paragraphs"), "confidence", pages.alias("pages"), status.alias("status"))


def role_violations(selected: DataFrame, facts: DataFrame) -> DataFrame:
    """selection, rule: concepts or roles that the inventory lacks, and ranks given twice."""
    keyed = T.with_key(selected, "concept", "key")
    known = T.with_key(facts, "concept", "key").select("key", "role").distinct()
    no_concept = keyed.join(known.select("key").distinct(), "key", "left_anti").select("selection", F.lit("unknown concept").alias("rule"))
    no_role = keyed.join(known.select("key").distinct(), "key", "left_semi").join(known, ["key", "role"], "left_anti").select("selection", F.lit("unknown role").alias("rule"))
    twice = keyed.groupBy("rank").agg(F.collect_list("selection").alias("s")).where(F.size("s") > 1).select(F.explode("s").alias("selection"), F.lit("rank given twice").alias("rule"))
    return no_concept.unionByName(no_role).unionByName(twice)


def answer_context(question: str | DataFrame, paras: DataFrame, roles: DataFrame | None = None, scope: str = "query_id") -> DataFrame:
    """scope, markdown: the prompt's context. question: one for all, or a table (scope, question). paras: scope, place, source, header, nested, pages, labels,
    image_refs, text (bounded by ``evidence.limited``); roles: scope, n, concept, role, places, parents."""

    def line(name: str, values: Column, joint: str, always: str | None = None) -> Column:
        full = F.concat(F.lit(f"- {name}: "), F.array_join(values, joint))
        return F.when(F.size(values) > 0, full) if always is None else F.when(F.size(values) > 0, full).otherwise(F.lit(f"- {name}: {always}"))

    # The lines' wording is fixed.
    number = F.row_number().over(Window.partitionBy(scope).orderBy("place"))
    block = F.concat_ws(
        "\n", F.concat(F.lit("### ["), F.col("__n").cast("string"), F.lit("]")), F.lit(""), F.concat(F.lit("- Source: "), "source"), F.concat(F.lit("- Parent header: "), "header"), line("Nested heading", F.col("nested"), "; "), line("Pages", F.col("pages"), "–"),
        line("Concepts and roles", F.col("labels"), "; ", ""), line("Images", F.col("image_refs"), ", ", "none"), F.lit(""), F.col("text"), F.lit(""),
    )
    body = paras.withColumn("__n", number).groupBy(scope).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", block.alias("b")))), lambda v: v["b"]), "\n").alias("paragraphs"))
    if isinstance(question, str):
        asked = F.lit(question)
    else:
        body, asked = body.join(question.select(scope, F.col("question").alias("__asked")), scope), F.coalesce("__asked", F.lit(""))
    head = F.concat(F.lit("# Retrieval Context\n\n## User question\n\n"), asked, F.lit("\n\n## Concept-role map\n\n"))
    if roles is None:
        return body.select(scope, F.concat(head, F.lit("## Source paragraphs\n\n"), "paragraphs").alias("markdown"))
    parents = F.array_join(F.transform("parents", lambda p: F.concat(p["chunk_id"].cast("string"), F.lit(" (rank "), p["rank"].cast("string"), F.lit(")"))), ", ")
    cited = F.array_join(F.transform("places", lambda p: F.concat(F.lit("["), p.cast("string"), F.lit("]"))), ", ")
    entry = F.concat_ws("\n", F.concat(F.lit("### Concept: "), "concept"), F.lit(""), F.concat(F.lit("- Selected role: "), "role"), F.concat(F.lit("- Paragraphs: "), cited), F.concat(F.lit("- Parent chunks: "), parents), F.lit(""))
    mapped = roles.groupBy(scope).agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", entry.alias("b")))), lambda v: v["b"]), "\n"), F.lit("\n")).alias("roles"))
    x = body.join(mapped, scope, "left")
    return x.select(scope, F.concat(head, F.coalesce("roles", F.lit("")), F.lit("## Source paragraphs\n\n"), "paragraphs").alias("markdown"))


def used_refs(answers: DataFrame, context: DataFrame, scope: str = "query_id") -> tuple[DataFrame, DataFrame]:
    """References of answers (scope, pos, value: a citation number or a reference) as paragraphs of the context
    (scope, place, paragraph_ref), in order of place; and the values that are unknown or repeated."""
    by_ref = context.select(scope, F.col("paragraph_ref").alias("value"), "paragraph_ref", "place")
    by_key = context.select(scope, F.col("place").cast("string").alias("value"), "paragraph_ref", "place")
    by_key = by_key.join(by_ref.select(scope, "value"), [scope, "value"], "left_anti")  # a reference goes first
    known = by_ref.unionByName(by_key)
    found = answers.join(known, [scope, "value"])
    unknown = answers.join(known, [scope, "value"], "left_anti").select(scope, "value", F.lit("not in the context").alias("rule"))
    twice = found.groupBy(scope, "paragraph_ref").count().where("count > 1").select(scope, F.col("paragraph_ref").alias("value"), F.lit("used twice").alias("rule"))
    return found.select(scope, "place", "paragraph_ref").distinct(), unknown.unionByName(twice)


def synthesis_violations(results: DataFrame, evidence: DataFrame, scope: str = "run_id") -> DataFrame:
    """scope, evidence_id, rule: what makes synthesised answers wrong. results: scope, answer, used, cited, images (arrays
    of evidence ids; null ones are empty); evidence: scope, evidence_id, image_refs. A row without evidence_id is about
    the answer itself."""
    lists = F.explode(F.array(*[F.struct(F.lit(c).alias("list"), F.coalesce(c, F.expr(NO_STRINGS)).alias("ids")) for c in ("used", "cited", "images")])).alias("l")
    refs = results.select(scope, lists).select(scope, "l.list", F.explode("l.ids").alias("evidence_id"))
    blank = results.where(T.is_blank(F.coalesce("answer", F.lit("")))).select(scope, F.lit(None).cast("string").alias("evidence_id"), F.lit("answer is empty").alias("rule"))
    twice = refs.where("list <> 'cited'").groupBy(scope, "list", "evidence_id").count().where("count > 1").select(scope, "evidence_id", F.concat("list", F.lit(" twice")).alias("rule"))
    known = evidence.select(scope, "evidence_id", F.lit(True).alias("known"), (F.coalesce(F.size("image_refs"), F.lit(0)) > 0).alias("pictured"))
    rule = F.when(F.col("known").isNull(), F.concat("list", F.lit(" unknown"))).when((F.col("list") == "images") & ~F.col("pictured"), "images without a picture")
    met = refs.distinct().join(known, [scope, "evidence_id"], "left").select(scope, "evidence_id", rule.alias("rule")).where("rule IS NOT NULL")
    return blank.unionByName(twice).unionByName(met)


def source_pages(pages: Column) -> tuple[Column, Column]:
    """The first and the last label that is a number."""
    n = F.filter(F.transform(pages, lambda p: F.trim(p).try_cast("int")), lambda x: x.isNotNull())
    return F.get(n, F.lit(0)), F.get(n, F.size(n) - 1)


def cited_sources(citations: DataFrame, used: DataFrame, evidence: DataFrame, images: DataFrame, scope: str = "run_id") -> DataFrame:
    """Sources of runs in order: cited evidence, or that used if nothing is cited; with the citation's label,
    and images only where the answer shows them. citations: scope, pos, evidence_id, label; used: scope, pos,
    evidence_id; images: scope, evidence_id; evidence: scope, evidence_id, source_ref, url, image_refs."""
    rest = used.join(citations.select(scope).distinct(), scope, "left_anti").select(scope, "pos", "evidence_id", F.lit(None).cast("string").alias("label"))
    first = citations.select(scope, "pos", "evidence_id", "label").unionByName(rest).groupBy(scope, "evidence_id").agg(F.min("pos").alias("pos"), F.max_by("label", "pos").alias("label"))
    shown = images.select(scope, "evidence_id", F.lit(True).alias("__shown")).distinct()
    x = first.join(evidence, [scope, "evidence_id"]).join(shown, [scope, "evidence_id"], "left")
    return x.select(scope, "pos", "evidence_id", "label", F.coalesce("source_ref", "url", F.lit("web source")).alias("source"), F.when(F.col("__shown"), F.col("image_refs")).otherwise(F.expr(NO_STRINGS)).alias("image_refs"))


def web_evidence(results: DataFrame, scope: str = "run_id") -> DataFrame:
    """Evidence of web results (scope, title, url, snippet, content); the URL is the identity."""
    null = F.lit(None).cast("string")
    x = results.where(F.col("url").isNotNull())
    text = F.coalesce(F.when(~T.is_blank(F.col("content")), F.col("content")), F.col("snippet"))
    return x.select(scope, evidence_id(F.lit("web"), F.col("title"), null, null, F.col("url")).alias("evidence_id"), F.col("title").alias("source_ref"), "url", text.alias("text")).dropDuplicates([scope, "evidence_id"])


def concept_records(catalog: DataFrame, model: str, index_version: str, examples: int = 3) -> DataFrame:
    """Catalog rows as records to embed: record_id, search_text (label, then "header: excerpt" lines), hash."""
    lines = F.concat(F.array("canonical_label"), F.transform(F.slice("examples", 1, examples), lambda e: F.concat(e["header"], F.lit(": "), e["excerpt"])))
    x = catalog.withColumn("search_text", F.array_join(lines, "\n"))
    return x.select(concept_record_id(F.col("normalized_label")).alias("record_id"), "normalized_label", "canonical_label", "usage_count", "search_text", F.sha2("search_text", 256).alias("input_hash"), F.lit(model).alias("model"), F.lit(index_version).alias("index_version"))


def cancelled(log: DataFrame, runs: DataFrame, run: str = "run_id", code: str = "client_disconnected") -> DataFrame:
    """A run_failed event for each of the runs that is open: its last event is not terminal."""
    last = log.groupBy(run).agg(F.max_by("type", "sequence").alias("type"), F.max("sequence").alias("sequence"))
    open_ = last.where(~F.col("type").isin("run_completed", "run_failed")).join(runs.select(run).distinct(), run, "left_semi")
    return open_.select(run, (F.col("sequence") + 1).alias("sequence"), F.lit("run_failed").alias("type"), F.lit(code).alias("error_code"))


def admitted_calls(calls: DataFrame, run: str, order: str, quota: dict[str, int], most_tokens: int) -> DataFrame:
    """run, order, admitted: calls (tool, tokens) under quotas and a token budget together: a denied call uses
    neither, so this is a fold over a run's calls, which the budgets keep few."""
    tools = list(quota)
    start = F.struct(*[F.lit(0).alias(f"n{i}") for i in range(len(tools))], F.lit(0).cast("long").alias("used"), F.expr("cast(array() as array<boolean>)").alias("ok"))

    def step(acc: Column, c: Column) -> Column:
        free = F.lit(True)
        for i, t in enumerate(tools):
            free = free & ((c["tool"] != t) | (acc[f"n{i}"] < quota[t]))
        ok = free & (acc["used"] + c["tokens"] <= most_tokens)
        return F.struct(*[(acc[f"n{i}"] + F.when(ok & (c["tool"] == t), 1).otherwise(0)).alias(f"n{i}") for i, t in enumerate(tools)], (acc["used"] + F.when(ok, c["tokens"]).otherwise(0)).cast("long").alias("used"), F.concat(acc["ok"], F.array(ok)).alias("ok"))

    per = calls.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "tool", "tokens"))).alias("c"))
    per = per.withColumn("ok", F.aggregate("c", start, step, lambda acc: acc["ok"]))
    return per.select(run, F.posexplode("c").alias("i", "x"), "ok").select(run, F.col("x.o").alias(order), F.get("ok", F.col("i")).alias("admitted"))


def plan_violations(plans: DataFrame, scope: str = "run_id", queries: str = "queries", wanted: int = 2) -> DataFrame:
    """Plans that have not ``wanted`` distinct, non-blank search queries."""
    n = F.size(F.array_distinct(F.filter(F.transform(queries, T.collapse), lambda q: F.length(q) > 0)))
    return plans.where((n != wanted) | (F.size(queries) != wanted)).select(scope, n.alias("distinct_queries"))


def with_captions(paras: DataFrame, captions: DataFrame, key: str = "paragraph_id") -> DataFrame:
    """paras with image_captions: a map from their references to the captions known (asset, caption)."""
    x = paras.select(key, F.explode("image_refs").alias("asset")).join(captions.dropDuplicates(["asset"]), "asset")
    per = x.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("asset", F.trim("caption").alias("caption"))))).alias("image_captions"))
    return paras.join(per, key, "left").withColumn("image_captions", F.coalesce("image_captions", F.expr("cast(map() as map<string,string>)")))


def tag_catalog(*frames: DataFrame) -> DataFrame:
    """The distinct tags of all frames (column tag), sorted."""
    out = frames[0].select("tag")
    for f in frames[1:]:
        out = out.unionByName(f.select("tag"))
    return out.where(~T.is_blank(F.col("tag"))).distinct().orderBy("tag")


def checkpoint_report(chunks: DataFrame, by: list[str]) -> DataFrame:
    """Counters of a run that ended early: durable chunks and those left, paragraphs and failures of the durable."""
    done = F.col("durable")
    return chunks.groupBy(*by).agg(F.count_if(done).alias("durable"), F.count_if(~done).alias("left"), F.sum(F.when(done, F.col("paragraphs")).otherwise(0)).alias("paragraphs"), F.sum(F.when(done, F.col("failed")).otherwise(0)).alias("failed"), (F.count_if(~done) == 0).alias("complete"))
