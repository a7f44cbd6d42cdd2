"""Text functions as Spark columns.

White space and case follow Unicode: ``WS`` is the class of characters that ``str.isspace`` accepts, and
``casefold`` is full case folding. Folding and normal forms have no Spark builtin; they run as Arrow UDFs
over batches, and only where a text has a character outside ASCII (the rest stays in the JVM).
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Unicode white space, with the separators U+001C to U+001F: as a class, and as the characters to trim by.
WS = r"(?U)[\s\x1c-\x1f]"
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Line ends: \r\n counts once.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
TERM = r"[\p{L}\p{N}_-]+"
#: The characters that end a line, but \n.
_RARE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


@F.pandas_udf(StringType())
def _folded(s: pd.Series) -> pd.Series:
    return s.map(str.casefold, na_action="ignore")


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def bound(value: Column, use) -> Column:
    """use(value), the value found once for a row: an expression may be put where its name stands, inside lambdas too,
    but not where a lambda's own argument stands."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_ascii(c: Column) -> Column:
    """As many bytes as characters: no regular expression over the text."""
    return F.octet_length(c) == F.char_length(c)


def _outside_ascii(c: Column, udf) -> Column:
    """udf(c) where c has other characters than ASCII; the UDF gets nulls for all others."""
    return F.coalesce(udf(F.when(~is_ascii(c), c)), c)


def casefold(c: Column) -> Column:
    return F.coalesce(_folded(F.when(~is_ascii(c), c)), F.lower(c))


def nfc(c: Column) -> Column:
    return _outside_ascii(c, _nfc)


def nfkc(c: Column) -> Column:
    return _outside_ascii(c, _nfkc)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WS_CHARS))


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def is_blank(c: Column) -> Column:
    return F.ltrim(c, F.lit(WS_CHARS)) == ""


def word_count(c: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(c, F.lit(r"(?U)[^\s\x1c-\x1f]+"))


def plain_ends(c: Column) -> Column:
    """A text whose lines all end in \\n. Hardly any has another line end: looking for each is cheaper than one
    expression for all."""
    rare = reduce(Column.__or__, [c.contains(x) for x in _RARE_ENDS])
    return F.when(rare, F.regexp_replace(c, LINE_END, "\n")).otherwise(c)


def plain_lines(c: Column) -> Column:
    """The lines of a text with plain ends."""
    whole = lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return bound(F.split(c, "\n"), whole)


def lines(c: Column) -> Column:
    """The lines of a text; a line end at the end makes no line of its own."""
    return plain_lines(plain_ends(c))


@F.pandas_udf(StringType())
def _concept_key(s: pd.Series) -> pd.Series:
    return s.map(lambda x: " ".join(unicodedata.normalize("NFC", x).split()).casefold(), na_action="ignore")


@F.pandas_udf(StringType())
def _identity_text(s: pd.Series) -> pd.Series:
    return s.map(lambda x: " ".join(unicodedata.normalize("NFKC", x).split()).casefold(), na_action="ignore")


def _plain_key(c: Column) -> Column:
    """The key of an ASCII text, in the JVM."""
    return F.lower(F.trim(F.regexp_replace(c, r"[\x09-\x0d\x1c-\x20]+", " ")))


def concept_key(c: Column) -> Column:
    """Key of a concept label: NFC, white space collapsed, case folded; null for a blank label."""
    key = F.coalesce(_concept_key(F.when(~is_ascii(c), c)), _plain_key(c))
    return F.when(F.length(key) > 0, key)


@F.arrow_udf(StringType())
def _label_key(labels: pa.Array) -> pa.Array:
    d = labels.dictionary_encode()
    keys = [x and " ".join(unicodedata.normalize("NFC", x).split()).casefold() for x in d.dictionary.to_pylist()]
    return pa.array([k or None for k in keys], pa.string()).take(d.indices)


@F.arrow_udf(StringType())
def _label_fold(labels: pa.Array) -> pa.Array:
    d = labels.dictionary_encode()
    return pa.array([x.casefold() for x in d.dictionary.to_pylist()], pa.string()).take(d.indices)


def folded_label(label: Column) -> Column:
    """``casefold`` of labels, found once for each distinct one of a batch."""
    return _label_fold(label)


def with_key(df: DataFrame, column: str, key: str) -> DataFrame:
    """df with ``key``, the concept key of ``column``: found once for each distinct label of a batch, where the row lies.
    Rows are not dealt by label, as few labels stand in very many rows."""
    return df.withColumn(key, _label_key(F.col(column)))


def identity_text(c: Column) -> Column:
    """Key of a paragraph: NFKC, white space collapsed, case folded."""
    return F.coalesce(_identity_text(F.when(~is_ascii(c), c)), _plain_key(c))


@F.arrow_udf(ArrayType(StringType()))
def _identity_texts(texts: pa.Array) -> pa.Array:
    keys = [None if x is None else " ".join(unicodedata.normalize("NFKC", x).split()).casefold() for x in texts.flatten().to_pylist()]
    offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys, pa.string()), mask=texts.is_null())


def identity_texts(c: Column) -> Column:
    """``identity_text`` of each text of an array, for a whole batch's texts at once."""
    return _identity_texts(c)


def choice_key(c: Column) -> Column:
    """Key of an answer choice: white space collapsed, case folded, no normal form."""
    return casefold(collapse(c))


def terms(c: Column) -> Column:
    """Distinct query terms of the lower-cased text, in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(f"({TERM})")))


def clean_heading(c: Column) -> Column:
    """A heading without closing signs, which stand after white space: ``C#`` keeps its own."""
    return strip(F.regexp_replace(c, r"(?U)\s+#+\s*$", ""))


MARKDOWN_IMAGE = r"!\[[^\]]*\]\(([^)\s]+)(?:\s+[^)]*)?\)"
HTML_IMAGE = r"(?i)<img\b[^>]*?\bsrc=[\"']([^\"']+)[\"'][^>]*>"


def image_refs(line: Column) -> Column:
    """References of Markdown images, then of HTML images, distinct, in order."""
    return F.array_distinct(F.concat(F.regexp_extract_all(line, F.lit(MARKDOWN_IMAGE)), F.regexp_extract_all(line, F.lit(HTML_IMAGE))))


def is_image_only(line: Column) -> Column:
    return is_blank(F.regexp_replace(F.regexp_replace(line, MARKDOWN_IMAGE, ""), HTML_IMAGE, ""))


def caption_fallback(ref: Column) -> Column:
    """A caption from a file name: last part, no extension, _ and - as spaces."""
    name = F.regexp_replace(F.regexp_replace(ref, r"^.*/", ""), r"\.[^.]*$", "")
    name = strip(F.regexp_replace(name, r"[_-]+", " "))
    return F.when(F.length(name) > 0, name).otherwise(F.lit("Source image"))


# ---- predicates on references and media types

_CONTROL = r"[\x00-\x1f\x7f]"


def is_safe_document_ref(c: Column) -> Column:
    """Usable as one path component: trimmed, NFC, no control, slash, colon; not . or .."""
    return F.coalesce((F.length(c) > 0) & (strip(c) == c) & (nfc(c) == c) & ~c.rlike(_CONTROL) & ~c.rlike(r"[/\\:]") & ~c.isin(".", ".."), F.lit(False))


@F.pandas_udf(ArrayType(StringType()))
def nfc_only(s: pd.Series) -> pd.Series:
    """The array's texts that are in NFC."""
    return s.map(lambda xs: [x for x in xs if x is not None and unicodedata.is_normalized("NFC", x)], na_action="ignore")


def is_plain_image_ref(c: Column) -> Column:
    """As ``is_safe_image_ref``, but for the normal form: usable inside lambdas."""
    bad = c.rlike(_CONTROL) | c.contains("\\") | c.startswith("/") | c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | c.rlike(r"(^|/)\.\.(/|$)") | c.rlike(r"(^|/)\.(/|$)|//|/$")
    return F.coalesce((F.length(c) > 0) & (strip(c) == c) & ~bad, F.lit(False))


def is_safe_image_ref(c: Column) -> Column:
    """A relative POSIX path in its plain spelling and NFC, without .. or scheme."""
    return is_plain_image_ref(c) & F.coalesce(nfc(c) == c, F.lit(False))


def is_safe_artifact_ref(c: Column) -> Column:
    """Path parts that any file system can store: no dots alone, no device names, no end in dot or space."""

    def good(part: Column) -> Column:
        device = F.upper(F.regexp_extract(part, r"^([^.]*)", 1))
        return ~part.isin("", ".", "..") & ~part.rlike(r"[ .]$") & ~part.rlike(r'[<>"|?*]') & ~device.rlike(r"^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$")

    return F.coalesce((strip(c) == c) & (nfc(c) == c) & ~c.rlike(_CONTROL) & ~c.rlike(r"[\\:]") & F.forall(F.split(c, "/"), good), F.lit(False))


_TOKEN = r"[A-Za-z0-9!#$%&'*+\-.^_`|~]+"
_PARAMETER = rf'\s*{_TOKEN}=(?:{_TOKEN}|"(?:[^"\\]|\\.)*")\s*'


def is_media_type(c: Column) -> Column:
    return F.coalesce((strip(c) == c) & ~c.rlike(_CONTROL) & c.rlike(rf"^{_TOKEN}/{_TOKEN}\s*(?:;{_PARAMETER})*$"), F.lit(False))


def is_image_media_type(c: Column) -> Column:
    return is_media_type(c) & F.lower(c).startswith("image/")


# Names of secrets, how they are assigned, bearer tokens, and the mark that replaces them.
SECRET_NAMES = "api[_-]?key|secret|token|authorization|cookie|password|credential"
ASSIGNMENT = rf"(?i)({SECRET_NAMES})(\s*[:=]\s*)(?:(Bearer )\s*[^\s,;]+|(?:Bearer\s+)?[^\s,;]+)"
BEARER = r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+"
REDACTED = "[REDACTED]"
_HERE = "\ue000"  # a private sign that marks what was just masked


def redact(c: Column, secrets: tuple[str, ...] = ()) -> Column:
    """Mask assignments to names of secrets (the word Bearer of one stays), bearer tokens, and the given secrets,
    longest first."""
    for s in sorted((s for s in secrets if s), key=len, reverse=True):
        c = F.replace(c, F.lit(s), F.lit(REDACTED))
    c = F.regexp_replace(c, ASSIGNMENT, f"$1$2$3{_HERE}{REDACTED}")
    c = F.replace(F.regexp_replace(c, f"(?i)Bearer {_HERE}", "Bearer "), F.lit(_HERE), F.lit(""))
    return F.regexp_replace(c, BEARER, f"Bearer {REDACTED}")


def is_secret_name(c: Column) -> Column:
    return c.rlike(rf"(?i)(?:{SECRET_NAMES}|private[_-]?key)")
