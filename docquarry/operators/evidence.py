"""Bounded evidence: hydration, limits, budgets, ledgers, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.functions.ids import evidence_id


def hydrate(hits: DataFrame, paras: DataFrame, chunks: DataFrame, keys: list[str], most_broadcast: int = 100_000) -> DataFrame:
    """Paragraphs of the hit chunks with their chunk's header, in order of hit, ordinal, id (``place``).

    Hits are a top-k list; they are broadcast if they number at most ``most_broadcast``.
    """
    few = hits.limit(most_broadcast + 1).count() <= most_broadcast
    h = F.broadcast(hits) if few else hits
    if few:  # so that the other chunks are not dealt
        chunks = chunks.join(F.broadcast(hits.select(*keys).distinct()), keys, "left_semi")
    x = paras.join(h, keys).join(chunks, keys)
    order = Window.partitionBy("query_id").orderBy("rank", "ordinal", "paragraph_id")
    return x.withColumn("place", F.row_number().over(order))


def with_labels(paras: DataFrame, facts: DataFrame) -> DataFrame:
    """paras with labels: "concept -> role" of each, sorted; none gives an empty list."""
    labels = facts.groupBy("paragraph_id").agg(F.array_sort(F.collect_set(F.concat_ws(" -> ", "concept", "role"))).alias("labels"))
    return paras.join(labels, "paragraph_id", "left").withColumn("labels", F.coalesce("labels", F.expr("cast(array() as array<string>)")))


def limited(paras: DataFrame, scope: list[str], order: list[str], most: int, most_words: int, text: str = "text") -> DataFrame:
    """The first rows of each scope: at most ``most``, stopping at the first that would pass ``most_words``.

    The count comes first: its limit is applied before the shuffle, so that a scope's sums see ``most`` rows.
    """
    by = Window.partitionBy(*scope).orderBy(*order)
    x = paras.withColumn("place", F.row_number().over(by)).where(F.col("place") <= most).withColumn("words", T.word_count(F.col(text)))
    return x.withColumn("running_words", F.sum("words").over(by.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("running_words") <= most_words)


def first_too_long(paras: DataFrame, scope: list[str], order: list[str], most_words: int, text: str = "text") -> DataFrame:
    """Scopes whose first row alone passes the limit: an error of the request."""
    first = F.row_number().over(Window.partitionBy(*scope).orderBy(*order))
    return paras.withColumn("__n", first).where((F.col("__n") == 1) & (T.word_count(F.col(text)) > most_words)).select(*scope)


def greedy_fit(items: Column, budget: int) -> Column:
    """The items (struct with ``n``) that fit, in order, each skipped if it does not: a fold, no window."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.expr("cast(array() as array<int>)").alias("at"), F.lit(0).alias("i"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["n"] <= budget
        return F.struct((acc["used"] + F.when(fits, x["n"]).otherwise(0)).cast("long").alias("used"), F.when(fits, F.concat(acc["at"], F.array(acc["i"]))).otherwise(acc["at"]).alias("at"), (acc["i"] + 1).alias("i"))

    return F.aggregate(items, start, step, lambda acc: acc["at"])


def interleaved(lists: DataFrame, scope: list[str], key: list[str], limit: int) -> DataFrame:
    """Ranked lists (scope, list_no, rank, key) merged round-robin: first sight wins, renumbered, cut."""
    first = lists.groupBy(*scope, *key).agg(F.min(F.struct("rank", "list_no")).alias("first"))
    order = Window.partitionBy(*scope).orderBy("first.rank", "first.list_no")
    return first.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= limit).select(*scope, *key, "new_rank")


def admitted(calls: DataFrame, run: str, tool: str, order: list[str], quota: dict[str, int]) -> DataFrame:
    """calls with call_number of the tool and admitted: within the tool's quota (none: always).

    A denied call uses nothing up; while quotas are per tool, that is the first ``quota`` calls.
    """
    n = F.row_number().over(Window.partitionBy(run, tool).orderBy(*order))
    limit = F.coalesce(*[F.when(F.col(tool) == t, F.lit(q)) for t, q in quota.items()], F.lit(None).cast("int"))
    return calls.withColumn("call_number", n).withColumn("admitted", limit.isNull() | (F.col("call_number") <= limit))


def first_page(pages: Column) -> Column:
    """The first positive whole number among the page labels."""
    return F.get(F.filter(F.transform(pages, lambda p: F.regexp_extract(p, r"^\s*(\d+)\s*$", 1).try_cast("int")), lambda n: n > 0), F.lit(0))


def ledger(paras: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Evidence of selected paragraphs (source_ref, chunk_id, paragraph_ref, text, pages): id, page and the
    chunk's score; paragraphs without a positive page are left out; equal ids count once."""
    x = paras.withColumn("page", first_page(F.col("pages"))).where(F.col("page").isNotNull())
    if scores is not None:
        x = x.join(scores.select("chunk_id", F.coalesce("fused_score", "semantic_score", "keyword_score").alias("score")), "chunk_id", "left")
    else:
        x = x.withColumn("score", F.lit(None).cast("double"))
    null = F.lit(None).cast("string")
    x = x.withColumn("evidence_id", evidence_id(F.lit("document"), F.col("source_ref"), F.col("chunk_id"), F.col("paragraph_ref"), null))
    return x.dropDuplicates(["evidence_id"]).select("evidence_id", "source_ref", "chunk_id", "paragraph_ref", "text", "page", "score")


def dangling(refs: DataFrame, evidence: DataFrame, key: str = "evidence_id") -> DataFrame:
    """References to evidence that is not there: must be empty."""
    return refs.join(evidence.select(key), key, "left_anti")


def citation_numbers(uses: DataFrame, scope: list[str], ref: str, position: str) -> DataFrame:
    """scope, ref, number: references numbered by first use."""
    first = uses.groupBy(*scope, ref).agg(F.min(position).alias("first_use"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy(*scope).orderBy("first_use", ref)))


CITATION = r"\[[0-9]+\]"


def inline_labels(answer: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(f"({CITATION})")))


def citations_agree(answer: Column, labels: Column) -> Column:
    """The labels in the text are those listed, no more, no less."""
    inline = inline_labels(answer)
    return (F.size(F.array_except(inline, labels)) == 0) & (F.size(F.array_except(labels, inline)) == 0)


def renumbered(answer: Column, labels: Column) -> Column:
    """The answer with its labels numbered by their place in ``labels``, all at once (no label is read twice)."""
    pieces = F.split(answer, CITATION)
    found = F.concat(F.regexp_extract_all(answer, F.lit(f"({CITATION})")), F.array(F.lit("")))
    fresh = F.transform(found, lambda x: F.when(x == "", "").otherwise(F.concat(F.lit("["), F.array_position(labels, x).cast("string"), F.lit("]"))))
    return F.array_join(F.zip_with(pieces, fresh, lambda p, x: F.concat(p, F.coalesce(x, F.lit("")))), "")


def merged_choices(paras: DataFrame, scope: list[str], order: str) -> DataFrame:
    """Paragraphs with equal text (by choice key) as one choice: the first ref, the last non-empty scalars,
    lists merged in order without repeats, numbered by first place."""
    x = paras.withColumn("choice", T.choice_key(F.col("text")))

    def last(c: str) -> Column:
        return F.max_by(F.col(c), F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col(order))).alias(c)

    # Aggregates that combine before the shuffle: many copies of a text are no long list anywhere.
    merged = x.groupBy(*scope, "choice").agg(F.min(order).alias("first"), F.min_by("paragraph_ref", order).alias("paragraph_ref"), last("source"), last("text"))
    seen = x.select(*scope, "choice", F.col(order).alias("__o"), F.posexplode("pages").alias("__i", "__p")).groupBy(*scope, "choice", "__p").agg(F.min(F.struct("__o", "__i")).alias("__first"))
    pages = seen.groupBy(*scope, "choice").agg(F.transform(F.array_sort(F.collect_list(F.struct("__first", "__p"))), lambda v: v["__p"]).alias("pages"))
    merged = merged.join(pages, [*scope, "choice"], "left").withColumn("pages", F.coalesce("pages", F.expr("cast(array() as array<string>)")))
    return merged.withColumn("key", F.row_number().over(Window.partitionBy(*scope).orderBy("first")).cast("string")).select(*scope, "key", "paragraph_ref", "source", "text", "pages")


def rendered_choice(key: Column, header: Column, ref: Column, source: Column, nested: Column, pages: Column, labels: Column, images: Column, text: Column) -> Column:
    """The prompt's block of lines for one choice."""

    def listed(name: str, values: Column, joint: str) -> Column:
        return F.concat(F.lit(f"{name}: "), F.when(F.size(values) > 0, F.array_join(values, joint)).otherwise(F.lit("none")))

    return F.concat_ws("\n", F.concat(key, F.lit(": "), header), F.concat(F.lit("Paragraph ref: "), ref), F.concat(F.lit("Source: "), source), listed("Nested headings", nested, "; "), listed("Pages", pages, "-"), listed("Concepts and roles", labels, "; "), listed("Images", images, ", "), F.lit("Text:"), text)


def answer_sources(citations: DataFrame, evidence: DataFrame, scope: list[str]) -> DataFrame:
    """Cited evidence in order of citation, each once."""
    first = citations.groupBy(*scope, "evidence_id").agg(F.min("position").alias("position"))
    return first.join(evidence, "evidence_id")
