"""Identities and digests."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docquarry.functions.text import identity_text

#: Separator of the fields of a hashed identity.
UNIT = "\x1f"


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def fingerprint(c: Column) -> Column:
    """sha256, md5 and length in bytes."""
    return F.struct(F.sha2(c, 256).alias("sha256"), F.md5(c).alias("md5"), F.octet_length(c).cast("long").alias("byte_length"))


def identity_hash(c: Column) -> Column:
    return F.sha2(identity_text(c), 256)


def identity_digest(c: Column) -> Column:
    return F.substring(identity_hash(c), 1, 12)


def paragraph_ref(chunk_id: Column, text: Column, occurrence: Column) -> Column:
    return F.concat_ws(":", chunk_id, identity_digest(text), occurrence.cast("string"))


def chunk_id(document_ref: Column, version: Column, index: Column, heading: Column, content: Column) -> Column:
    return F.concat_ws(":", document_ref, version, index.cast("string"), F.substring(F.sha2(F.concat(heading, F.lit("\n"), content), 256), 1, 16))


def joined_hash(*parts: Column) -> Column:
    """sha256 of the parts between unit separators; null counts as empty."""
    return F.sha2(F.concat_ws(UNIT, *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def evidence_id(kind: Column, source: Column, chunk: Column, paragraph: Column, url: Column) -> Column:
    """Where a fragment is from; web fragments are told apart by URL, whatever their source is called."""
    own = F.when(kind == "web", F.lit("")).otherwise(F.trim(F.coalesce(source, F.lit(""))))
    rest = [F.trim(F.coalesce(p, F.lit(""))) for p in (chunk, paragraph, url)]
    some = F.length(F.concat(own, *rest)) > 0
    return F.when(some, F.concat(kind, F.lit(":"), F.substring(joined_hash(kind, own, *rest), 1, 20)))


def concept_record_id(key: Column) -> Column:
    return F.concat(F.lit("concept::"), F.sha2(key, 256))


def stale_delete_id(run_id: Column, entity_type: Column, entity_key: Column, collection: Column, record_id: Column, index_version: Column) -> Column:
    return F.concat(F.lit("stale-delete-"), joined_hash(run_id, entity_type, entity_key, collection, record_id, index_version))


def bundle_ref(refs: Column) -> Column:
    return F.substring(F.sha2(F.array_join(refs, "\n"), 256), 1, 16)


def embedding_key(*lines: Column) -> Column:
    return F.concat(F.lit("embed-"), F.sha2(F.concat_ws("\n", *lines), 256))


def input_hash(payload: Column) -> Column:
    """sha256 of compact JSON; the struct's fields must be in order of name and hold no floats."""
    return F.sha2(F.to_json(payload, {"ignoreNullFields": "false"}), 256)


@F.pandas_udf(StringType())
def vector_event_id(prefix: pd.Series, payload: pd.Series, vector: pd.Series) -> pd.Series:
    """Identity of an event that carries a vector: JSON with sorted keys, numbers as Python prints them."""
    import hashlib

    def one(p: str, body: str, v) -> str:
        data = {**json.loads(body), "embedding": [float(x) for x in v]}
        return p + hashlib.sha256(json.dumps(data, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    return pd.Series([one(*x) for x in zip(prefix, payload, vector, strict=True)])
