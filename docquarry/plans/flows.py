"""Whole flows: Markdown to a searchable store, and questions to bounded, cited context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry import ports
from docquarry.functions import text as T
from docquarry.operators import answers, concepts, evidence, search, segment, state
from docquarry.session import saved
from docquarry.sources.store import Store

#: Columns of chunks that are made from others wherever chunks are read.
MADE = {"search_text": "concat('## ', heading, char(10), char(10), content)"}
STATE = ("entity_type", "entity_key", "collection", "record_id", "input_hash", "model", "dimensions", "index_version", "sync_status", "document_ref", "source_version")


def chunked(documents: DataFrame, heading_level: int = 2) -> DataFrame:
    """Chunks of documents (document_ref, source_version, markdown), found where texts lie; texts are dealt only where
    their files are fewer than the cores."""
    if len(documents.inputFiles()) < documents.sparkSession.sparkContext.defaultParallelism:
        documents = documents.repartition("document_ref")
    chunks = segment.with_chunk_ids(segment.header_chunks(documents, ["document_ref", "source_version"], "markdown", heading_level), F.col("document_ref"), F.col("source_version"))
    return chunks.withColumns({c: F.expr(x) for c, x in MADE.items()})


def paragraphs_of(chunks: DataFrame) -> DataFrame:
    """Paragraphs of ``chunked`` (best written first, else it is done again), with their chunk's heading as ``header``."""
    own = ["document_ref", "source_version", "chunk_id", "header"]
    return segment.identified_paragraphs(chunks.withColumn("header", F.coalesce("heading", F.lit(""))), own)


def ingest(store: Store, documents: DataFrame, embedder: ports.Embedder, tagger: ports.Tagger | None, model: str = "profile-1", index_version: str = "v1", run_id: str = "run", also: dict[str, DataFrame] | None = None) -> DataFrame:
    """Bring the store up to date with ``documents``: all rows of the documents named are replaced.

    Chunks, paragraphs, relations, the concept catalog, vector states and the vector index are committed (as layers)
    at once, with the tables of ``also``; only new and changed chunks are embedded. Without a tagger, chunks are
    indexed without tags. Returns the changes (entity_key, change, document_ref).
    """
    known = set(store.tables())

    def current(name: str, like: DataFrame) -> DataFrame:
        return store.read(name) if name in known else like.limit(0)

    # What a table gains is written once, where the store keeps it; headers are in the files for the catalog alone.
    chunks = store.staged("chunks", chunked(documents), made=MADE)
    paras = store.staged("paragraphs", paragraphs_of(chunks), ["header"])
    scope = documents.select("document_ref").distinct()
    asked = paras.select("document_ref", "source_version", "chunk_id", "ordinal", "paragraph_id", "text", "header")
    labelled = ports.tag(asked, "text", tagger) if tagger else asked.withColumn("labels", F.expr("cast(array() as array<string>)"))
    found = labelled.select("document_ref", "source_version", "chunk_id", "ordinal", "paragraph_id", "text", F.explode("labels").alias("concept"), F.lit("mention").alias("role"), "header")
    tags = store.staged("relations", found, ["header"])
    facts = tags.withColumnRenamed("text", "excerpt")
    observed = store.staged("observations", concepts.document_catalog(facts, ["document_ref", "source_version"]))

    desired = chunks.select(
        F.lit("chunk").alias("entity_type"), F.col("chunk_id").alias("entity_key"), F.lit("document_chunks").alias("collection"), F.col("chunk_id").alias("record_id"), F.sha2("search_text", 256).alias("input_hash"),
        F.lit(model).alias("model"), F.lit(1).alias("dimensions"), F.lit(index_version).alias("index_version"), F.lit("synced").alias("sync_status"), "document_ref", "source_version",
    )
    states = current("states", desired)
    own = states.join(scope, "document_ref", "left_semi")
    changes = saved(state.reconcile(own, desired).select("entity_key", "change", "document_ref"), "changes")
    # Unchanged chunks are few at a first ingest, changed ones later: what is joined is read from files, by its size.
    same = saved(changes.where(F.col("change") == "unchanged").select(F.col("entity_key").alias("chunk_id")), "same-chunks")
    todo = chunks.select("document_ref", "chunk_id", "search_text").join(same, "chunk_id", "left_anti")
    vectors = ports.embed(todo, "search_text", embedder).select("document_ref", "chunk_id", "embedding")
    vectors = store.staged("index", vectors)
    gone = changes.where(F.col("change").isin("changed", "stale")).select(F.col("entity_key").alias("chunk_id"))
    # A layer names only documents that are stored as taken away, so that reading new ones needs no join.
    held = saved(own.select("document_ref").distinct(), "held-documents")
    none_held = held.isEmpty()

    observations = state.replaced(current("observations", observed), scope, observed, ["document_ref"])
    own, held, gone = ["document_ref"], None if none_held else held, None if none_held else gone
    store.commit(
        {"catalog": concepts.global_catalog(observations), **(also or {})},
        layers={
            "chunks": (chunks, held, own), "paragraphs": (paras, held, own), "relations": (tags, held, own), "observations": (observed, held, own), "states": (desired, held, own),
            "index": (vectors, gone, ["chunk_id"]),
        },
    )
    return changes


def ingest_checkpointed(store: Store, documents: DataFrame, embedder: ports.Embedder, tagger: ports.Tagger | None, groups: int = 8, run_id: str = "run", stop_after: int | None = None) -> list[int]:
    """``ingest`` in groups of documents by hash, each durable before the next begins; a group's commit holds its
    checkpoint (run_id, group), so a run that is started again goes on where it ended. Returns the groups done by
    this call (``stop_after`` ends it early)."""
    spark, done = documents.sparkSession, []
    known = store.read("checkpoints") if "checkpoints" in store.tables() else spark.createDataFrame([], "run_id string, group int")
    before = {r[0] for r in known.where(F.col("run_id") == run_id).select("group").collect()}  # at most ``groups``
    for g in range(groups):
        if g in before or (stop_after is not None and len(done) >= stop_after):
            continue
        own = documents.where(F.pmod(F.xxhash64("document_ref"), F.lit(groups)) == g)
        known = known.unionByName(spark.createDataFrame([(run_id, g)], "run_id string, group int"))
        ingest(store, own, embedder, tagger, run_id=run_id, also={"checkpoints": known.coalesce(1)})
        known = store.read("checkpoints")
        done.append(g)
    return done


def retrieve(store: Store, question: str, vector: list[float], hits: int = 10, paragraphs: int = 20, words: int = 4000) -> DataFrame:
    """The bounded context of a question: paragraphs of the fused top chunks, in order, with labels.

    Columns: place, paragraph_id, chunk_id, header, text, labels, fused_score, evidence_id.
    """
    chunks = store.read("chunks")
    semantic = search.semantic_hits(search.vector_topk(store.read("index"), vector, hits, "chunk_id"), "chunk_id", F.col("chunk_id"))
    lexical = search.lexical_search(chunks.withColumnRenamed("chunk_id", "chunk_ref"), question, search.metadata_text(F.col("heading"), F.col("content")), hits)
    fused = saved(search.fuse(semantic, lexical, hits).select(F.col("chunk_ref").alias("chunk_id"), "rank", "fused_score").withColumn("query_id", F.lit(0)), "hits")
    found = evidence.hydrate(fused, store.read("paragraphs"), chunks.select("chunk_id", F.col("heading").alias("header")), ["chunk_id"])
    bounded = saved(evidence.limited(found, ["query_id"], ["rank", "ordinal", "paragraph_id"], paragraphs, words), "context")
    # Few paragraphs are left: the others' labels are not brought together.
    facts = store.read("relations").select("paragraph_id", "concept", "role").join(F.broadcast(bounded.select("paragraph_id").distinct()), "paragraph_id", "left_semi")
    labelled = evidence.with_labels(bounded, facts)
    from docquarry.functions.ids import evidence_id

    none = F.lit(None).cast("string")
    labelled = labelled.withColumn("evidence_id", evidence_id(F.lit("document"), F.col("document_ref"), F.col("chunk_id"), F.col("paragraph_id"), none))
    return labelled.select("place", "paragraph_id", "chunk_id", "header", "text", "labels", "fused_score", "evidence_id").orderBy("place")


def rendered_context(context: DataFrame, question: str) -> str:
    """The context as Markdown for a prompt; it is bounded by ``retrieve``'s limits."""
    none = F.expr("cast(array() as array<string>)")
    paras = context.select(F.lit(0).alias("query_id"), "place", F.col("chunk_id").alias("source"), "header", none.alias("nested"), none.alias("pages"), "labels", none.alias("image_refs"), "text")
    row = answers.answer_context(question, paras).first()
    return row["markdown"] if row else ""


def answer(context: DataFrame, generate, question: str) -> tuple[str, list[str]]:
    """generate(question, context) -> (answer, labels of its citations); checked, renumbered, with sources.

    Labels are the places in the context, as [n]. A citation of something else is an error.
    """
    spark: SparkSession = context.sparkSession
    rows = context.select("place", "evidence_id").collect()
    known = {f"[{r['place']}]": r["evidence_id"] for r in rows}
    text, labels = generate(question, rendered_context(context, question))
    if set(labels) - set(known):
        raise ValueError(f"citations of unknown evidence: {sorted(set(labels) - set(known))}")
    one = spark.createDataFrame([(text, list(labels))], "answer string, labels array<string>")
    got = one.select(evidence.citations_agree(F.col("answer"), F.col("labels")).alias("ok"), evidence.renumbered(F.col("answer"), F.col("labels")).alias("answer")).first()
    if not got["ok"]:
        raise ValueError("inline citations must match the listed labels")
    return got["answer"], [known[x] for x in labels]


def corpus_markdown(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents table as Markdown documents: each line a section."""
    lines = F.array_join(F.transform(T.lines(F.col(text)), lambda line, i: F.concat(F.lit("## Section "), (i + 1).cast("string"), F.lit("\n\n"), line)), "\n\n")
    return documents.select(F.concat(F.lit("doc-"), F.col(key).cast("string")).alias("document_ref"), F.lit("s1").alias("source_version"), lines.alias("markdown"))
