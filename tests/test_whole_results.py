"""Queries return their whole results, compared with figures counted without their SQL."""

import unicodedata

import duckdb

from docquarry.plans.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def test_traversal_takes_every_parent_chunk(spark):
    lines = duckdb.execute(f"SELECT lower(p_type) || '/' || l_returnflag, l_orderkey || '-' || l_linenumber, l_orderkey FROM '{SMALL}/lineitem.parquet' JOIN '{SMALL}/part.parquet' ON l_partkey = p_partkey").fetchall()
    wanted, chunks = {}, {}
    for selection, paragraph, chunk in lines:
        wanted.setdefault(selection, set()).add(paragraph)
        chunks.setdefault(selection, set()).add(chunk)
    assert max(map(len, chunks.values())) > 50
    got = {r.selection: r.paragraph_refs for r in QUERIES["paragraph_traversal"](spark, SMALL).collect()}
    assert got == {selection: ",".join(sorted(refs)) for selection, refs in wanted.items()}


def test_redaction_masks_every_source(spark, tmp_path):
    rows = [(i, f"text {i}", "en", f"site-{i}.example", 6) for i in range(1500)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.redacted for r in QUERIES["secret_redaction"](spark, str(tmp_path)).collect()]
    assert len(got) == 1500
    assert {g.rsplit("!", 1)[0] for g in got} == {"Authorization: Bearer [REDACTED]; COOKIE =Bearer [REDACTED], api_key=[REDACTED], Password : [REDACTED]; Bearer [REDACTED] by [REDACTED]"}


def test_concept_keys_are_whole(spark):
    docs = duckdb.execute(f"SELECT doc_id, source, text FROM '{SMALL}/documents.parquet'").fetchall()
    wanted = {d: " ".join(unicodedata.normalize("NFC", f"{source} {text}").split()).casefold() for d, source, text in docs}
    assert max(map(len, wanted.values())) > 60
    assert {r.doc_id: r.key for r in QUERIES["concept_keys"](spark, SMALL).collect()} == wanted
