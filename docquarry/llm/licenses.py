"""License scan with DataFrame and SQL functions only.

A text becomes the sequence of its 5-word shingle hashes. Its windows begin at each word and are as long as a
template, so they overlap. MinHash bands of one row retrieve: band b of a template is its shingle with the least
hash under seed b, and a window meets the template in that band if this shingle is also the window's least. So
only the shingles that are some template's least are looked up in a text, and around each one found the run of
windows in which nothing is less gives the windows that meet. They are verified by the exact share of the
template's shingles that each holds, which running sums give for all windows at once. A window with a share of 0.8 or more has a similarity of 2/3 or more to its
template, so it meets in some band with probability 1 - (1/3)^bands > 0.999998 for 12 bands, and surely if it
equals the template.

Templates are a parameter of at most ``most_templates`` notices, which bounds what is looked up and broadcast.
SPDX lines name licenses by identifier, as some are shorter than a shingle; those of the templates' licenses
count, with "-only", "-or-later" and "+" left off.

Defined results: a null or empty text, or one of fewer words than a shingle, has no license; rows that
repeat a doc_id, or have none, with other texts are scanned each by itself; the query unites rows that repeat an
id; an empty table gives no rows. Only the id and the text are read, so other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.llm.license_texts import TEXTS, WORDINGS
from docquarry.llm.textkeys import quoted
from docquarry.session import table

# License notices by SPDX identifier.
NOTICES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

# What the query scans for.
TEMPLATES = NOTICES + TEXTS + WORDINGS

SHINGLE = 5
NARROW = 16  # shingles of a short template
SPDX_TAG, SPDX_ID = r"(?i)SPDX-License-Identifier:", r"[A-Za-z0-9][A-Za-z0-9.+-]*"
SPDX_EXPRESSION = rf"^\s*(\(*{SPDX_ID}\)*(?:\s+(?:OR|AND|WITH)\s+\(*{SPDX_ID}\)*)*)"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _let(value: Column, use) -> Column:
    """use(value) with value computed once: a lambda's variable is bound, not substituted."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingles_of(words: Column) -> Column:
    """The hash of the five words from each position on."""

    def hashes(w: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (SHINGLE - 1)))
        return F.when(F.size(w) >= SHINGLE, F.transform(places, lambda i: F.xxhash64(F.slice(w, i, SHINGLE)))).otherwise(F.expr("cast(array() as array<bigint>)"))

    return _let(words, hashes)


def _known(templates: DataFrame, bands: int) -> DataFrame:
    """key, t, license, n, size, bands: each template's distinct shingles, with the bands (and the hash) of which
    the shingle is its template's least."""

    def least(b: int) -> Column:
        return F.array_min(F.transform("own", lambda x: F.struct(F.xxhash64(x, F.lit(b)).alias("low"), x.alias("key"))))

    each = F.array(*[F.struct(F.lit(b).alias("band"), least(b).alias("least")) for b in range(bands)])
    keys = templates.select("t", "license", F.size("own").alias("n"), F.array_distinct("own").alias("own"), each.alias("each"))
    keys = keys.select("t", "license", "n", F.size("own").alias("size"), "each", F.explode("own").alias("key"))
    own = F.transform(F.filter("each", lambda e: e["least"]["key"] == F.col("key")), lambda e: F.struct(e["band"].alias("band"), e["least"]["low"].alias("low")))
    return keys.select("key", "t", "license", "n", "size", own.alias("bands"))


def _met(near: str, at: str, n: str, band: Column) -> Column:
    """from, to: the run of windows of n shingles that hold the shingle at ``at`` and nothing less in the band. ``near`` is
    a record of the shingles around and the place of the first of them; a window's length to both sides is read."""
    start = F.greatest(F.col(f"{near}.start"), F.col(at) - F.col(n) + 1)
    window = F.slice(f"{near}.h", start - F.col(f"{near}.start") + 1, F.col(at) - start + F.col(n))
    less = F.transform(window, lambda x, i: F.when(F.xxhash64(x, band["band"]) < band["low"], i + start))

    def run(less: Column) -> Column:
        before = F.array_max(F.filter(less, lambda i: i < F.col(at)))
        behind = F.array_min(F.filter(less, lambda i: i > F.col(at)))
        first = F.greatest(F.lit(0), F.col(at) - F.col(n) + 1, F.coalesce(before + 1, F.lit(0)))
        return F.struct(first.alias("from"), F.least(F.col(at), F.coalesce(behind - F.col(n), F.col(at))).alias("to"))

    return _let(less, run)


def _matches(hashed: DataFrame, known: DataFrame, reach: int, share: float) -> DataFrame:
    """doc_id, row, license, word, share, first, end of the windows of ``hashed`` (doc_id, row, h) that meet a template in a
    band and hold enough of it; first and end are the words from the first shingle found to the last.

    A shingle at p whose like was last seen at q adds one to the windows from max(p - n, q) + 1 to p, and each run that
    a band retrieves adds one to its windows. So the steps of two running sums tell which windows were retrieved and
    what each holds: a window is verified once, whatever the bands that it meets, and at no cost of its length.
    """
    own = known.groupBy("key").agg(F.max(F.when(F.size("bands") > 0, F.col("n"))).alias("reach")).collect()  # the templates' shingles
    any_key, least, wide = (", ".join(f"{r[0]}L" for r in own if (r[1] or 0) > most) or "null" for most in (-1, 0, NARROW))
    found = F.expr(f"filter(transform(h, (x, i) -> struct(i as at, x as key)), e -> e.key in ({any_key}))")
    # What lies within a window's length on both sides of a band's shingle; most templates are short.
    side = F.expr(f"transform(found, e -> CASE WHEN e.key in ({wide}) THEN {reach} WHEN e.key in ({least}) THEN {min(NARROW, reach)} END)")
    near = lambda at, n: F.when(n.isNotNull(), F.struct(F.greatest(F.lit(0), at - n + 1).alias("start"), F.slice("h", F.greatest(F.lit(1), at - n + 2), F.coalesce(2 * n, F.lit(0))).alias("h")))
    hits = hashed.where(F.expr(f"exists(h, x -> x in ({least}))")).select("doc_id", "row", "h", found.alias("found")).withColumn("side", side)
    hits = hits.select("doc_id", "row", F.explode(F.zip_with("found", "side", lambda e, n: F.struct(e["at"].alias("at"), e["key"].alias("key"), near(e["at"], n).alias("near")))).alias("x")).select("doc_id", "row", "x.*")
    runs = F.filter(F.transform("bands", lambda b: _met("near", "at", "n", b)), lambda r: r["from"] <= r["to"])
    held = hits.join(F.broadcast(known), "key").select("doc_id", "row", "t", "license", "n", "size", "at", "key", runs.alias("runs")).distinct()
    held = held.repartition("doc_id", "row")
    seen = F.lag("at").over(Window.partitionBy("doc_id", "row", "t", "key").orderBy("at"))
    begin = F.greatest(F.lit(0), F.col("at") - F.col("n") + 1)

    def event(pos: Column, held: int = 0, met: int = 0, last: Column | None = None, first: Column | None = None) -> Column:
        none = F.lit(None).cast("int")
        return F.struct(pos.cast("int").alias("pos"), F.lit(held).alias("held"), F.lit(met).alias("met"), (none if last is None else last).alias("last"), (none if first is None else first).alias("first"))

    here = F.col("at")
    events = F.concat(
        F.array(event(begin, last=here), event(F.greatest(begin, F.coalesce(F.col("seen") + 1, F.lit(0))), held=1), event(here + 1, held=-1, first=here)),
        F.transform("runs", lambda r: event(r["from"], met=1)),
        F.transform("runs", lambda r: event(r["to"] + 1, met=-1)),
    )
    steps = held.withColumn("seen", seen).select("doc_id", "row", "t", "license", "size", F.explode(events).alias("e")).select("doc_id", "row", "t", "license", "size", "e.*")
    order = Window.partitionBy("doc_id", "row", "t").orderBy("pos")
    steps = steps.withColumns({
        "n_held": F.sum("held").over(order),
        "n_met": F.sum("met").over(order),
        "to_last": F.max("last").over(order),
        "next": F.lead("pos").over(order),
        "from_first": F.expr("lead(first) IGNORE NULLS OVER (PARTITION BY doc_id, row, t ORDER BY pos)"),
    })
    part = F.col("n_held") / F.col("size")
    enough = steps.where((F.col("next") > F.col("pos")) & (F.col("n_met") > 0) & (part >= share))
    return enough.select("doc_id", "row", "license", F.explode(F.sequence("pos", F.col("next") - 1)).alias("word"), part.alias("share"), F.col("from_first").alias("first"), (F.col("to_last") + SHINGLE).alias("end")).distinct()


def _local_best(matches: DataFrame, reach: int, rounds: int) -> DataFrame:
    """``matches`` with ``kept``: true, or null if it is still open; those that a better kept one overlaps are gone.

    In each round the best of their surroundings stay. A match is shorter than ``reach`` words, and surroundings go
    twice as far, so those that stay and overlap one match have one share: it goes if theirs is better.
    """
    cell = max(1, reach // 2)
    out = matches.withColumns({"kept": F.lit(None).cast("boolean"), "cell": F.floor(F.col("first") / cell)}).repartition("doc_id", "row")
    order = Window.partitionBy("doc_id", "row").orderBy("first")
    around = Window.partitionBy("doc_id", "row").orderBy("cell").rangeBetween(-6, 6)
    for _ in range(rounds):
        open_share = F.when(F.col("kept").isNull(), F.col("share"))
        out = out.withColumn("top", F.max(open_share).over(around)).withColumn("now", F.col("kept").isNull() & (F.col("share") >= F.col("top")))
        out = out.withColumns({"a": F.when(F.col("now"), F.struct("end", "share")), "b": F.when(F.col("now"), F.struct("first", "share"))})
        out = out.withColumns({"a": F.max("a").over(order), "b": F.expr("lead(b) IGNORE NULLS OVER (PARTITION BY doc_id, row ORDER BY first)")})
        beaten = ((F.col("a.end") > F.col("first")) & (F.col("a.share") > F.col("share"))) | ((F.col("b.first") < F.col("end")) & (F.col("b.share") > F.col("share")))
        out = out.where(F.col("kept").isNotNull() | F.col("now") | ~F.coalesce(beaten, F.lit(False)))
        out = out.withColumn("kept", F.when(F.col("now"), True).otherwise(F.col("kept"))).drop("top", "now", "a", "b")
    return out.drop("cell")


def scan(docs: DataFrame, notices: list[tuple[str, str]] | None = None, share: float = 0.8, bands: int = 12, text: str = "text", key: str = "doc_id", most_templates: int = 200, rounds: int = 3) -> DataFrame:
    """doc_id, license, word (where the window begins), share: the windows that hold enough of a notice,
    without those whose notice overlaps in words with that of a better one that is kept. Most are settled in
    ``rounds`` of local comparison, the others in arrays of what overlaps."""
    notices = NOTICES if notices is None else notices
    if len(notices) > most_templates:
        raise ValueError(f"over {most_templates} templates")
    spark = docs.sparkSession
    docs = docs.select(F.col(quoted([key])[0]).alias("doc_id"), F.col(quoted([text])[0]).alias("text"))
    templates = spark.createDataFrame([(i, *x) for i, x in enumerate(notices)], "t int, license string, text string").select("t", "license", shingles_of(words_of(F.col("text"))).alias("own"))
    templates = templates.where(F.size("own") > 0)
    reach = templates.agg(F.max(F.size("own"))).first()[0]
    if reach is None:
        return docs.select("doc_id", F.lit("").alias("license"), F.lit(0).alias("word"), F.lit(1.0).alias("share")).limit(0)
    hashed = docs.select("doc_id", words_of(F.col("text")).alias("w")).select("doc_id", shingles_of(F.col("w")).alias("h"), F.xxhash64("w").alias("row"))
    matches = _local_best(_matches(hashed, _known(templates, bands), reach, share), reach + SHINGLE, rounds)
    # Runs of overlapping matches that are open; in each, from the best down, what overlaps a better kept one is left out.
    order = Window.partitionBy("doc_id", "row", "kept").orderBy("first", "end", "word", "license", "share")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.col("kept").isNotNull() | F.coalesce(F.col("first") >= before, F.lit(True))
    placed = matches.withColumn("fresh", fresh.cast("int")).withColumn("place", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = placed.groupBy("doc_id", "row", "kept", "place").agg(F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("less"), "word", "license", "first", "end", "share"))).alias("m"))

    def beaten(kept: Column, x: Column) -> Column:
        return F.exists(kept, lambda k: (k["share"] > x["share"]) & (k["first"] < x["end"]) & (x["first"] < k["end"]))

    kept = F.aggregate("m", F.slice("m", 1, 0), lambda kept, x: F.when(beaten(kept, x), kept).otherwise(F.concat(kept, F.array(x))))
    best = runs.select("doc_id", F.explode(kept).alias("k")).select("doc_id", "k.license", "k.word", "k.share").distinct()
    return best.select("doc_id", "license", "word", "share").unionByName(_spdx(docs, sorted({n for n, _ in notices})))


def _spdx(docs: DataFrame, licenses: list[str]) -> DataFrame:
    """The licenses that SPDX lines name, with the word at which the line begins."""
    parts = docs.where(F.col("text").rlike(SPDX_TAG)).select("doc_id", F.split("text", SPDX_TAG).alias("parts"))
    sized = parts.withColumn("sizes", F.transform("parts", lambda p: F.size(words_of(p))))
    tags = sized.select("doc_id", "sizes", F.posexplode("parts").alias("k", "part")).where("k > 0")
    word = F.expr("aggregate(slice(sizes, 1, k), 0, (a, x) -> a + x) + 3 * (k - 1)")
    ids = F.regexp_extract_all(F.regexp_extract("part", SPDX_EXPRESSION, 1), F.lit(f"({SPDX_ID})"), F.lit(1))
    named = tags.select("doc_id", word.alias("word"), F.explode(ids).alias("id"))
    found = named.withColumn("id", F.regexp_replace(F.lower("id"), r"(?:-only|-or-later|\+)?\.*$", ""))
    known = docs.sparkSession.createDataFrame([(n.lower(), n) for n in licenses], "id string, license string")
    return found.join(F.broadcast(known), "id").select("doc_id", "license", "word", F.lit(1.0).alias("share")).distinct()


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: the licenses it names (sorted, comma-joined) and the windows that match."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    per = scan(docs, TEMPLATES).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"), F.countDistinct("license").alias("n_licenses"), F.max("share").alias("best_share"), F.min("word").alias("first_word"))
    return docs.select("doc_id").join(per, "doc_id", "left").select("doc_id", F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("n_licenses", F.lit(0).cast("long")).alias("n_licenses"), F.coalesce("best_share", F.lit(0.0)).alias("best_share"), F.coalesce("first_word", F.lit(-1)).alias("first_word"))


_VALUES = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))
_IDS = ", ".join(f"('{i.lower()}', '{i}')" for i in sorted({n for n, _ in TEMPLATES}))
SQL = {
    "op4_license_scan": rf"""
WITH t(t, license, text) AS (VALUES {_VALUES}),
ids(id, license) AS (VALUES {_IDS}),
tw AS (SELECT t, license, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM t),
own AS (SELECT t, license, len(w) - 4 AS n, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT t, license, w, unnest(range(1, len(w) - 3)) AS i FROM tw WHERE len(w) >= 5)),
size AS (SELECT t, license, n, count(DISTINCT g) AS own FROM own GROUP BY ALL),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
g AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
m AS (SELECT doc_id, t, license, n, g, pos, unnest(range(greatest(0, pos - n + 1), pos + 1)) AS word FROM g JOIN own USING (g)),
x AS (SELECT doc_id, license, word, count(DISTINCT g) / any_value(size.own) AS share, min(pos) AS first, max(pos) + 5 AS last FROM m JOIN size USING (t, license) GROUP BY doc_id, t, license, word HAVING count(DISTINCT g) / any_value(size.own) >= 0.8),
o AS (SELECT doc_id, list_reduce(list_sort(list(DISTINCT {{'less': -share, 'word': word, 'license': license, 'first': first, 'last': last}})),
  lambda found, e: CASE WHEN len(list_filter(found, lambda f: f.less < e.less AND f.first < e.last AND e.first < f.last)) > 0 THEN found ELSE list_append(found, e) END,
  list(DISTINCT {{'less': -share, 'word': word, 'license': license, 'first': first, 'last': last}})[1:0]) AS kept FROM x GROUP BY 1),
k AS (SELECT doc_id, k.license AS license, k.word AS word, -k.less AS share FROM (SELECT doc_id, unnest(kept) AS k FROM o)),
sp AS (SELECT doc_id, regexp_split_to_array(text, '(?i)SPDX-License-Identifier:') AS parts FROM documents WHERE regexp_matches(text, '(?i)SPDX-License-Identifier:')),
sq AS (SELECT doc_id, i, parts[i + 1] AS part, list_sum(list_transform(parts[1:i], lambda p: len(regexp_extract_all(lower(p), '[\p{{L}}\p{{N}}]+')))) + 3 * (i - 1) AS word FROM (SELECT doc_id, parts, unnest(range(1, len(parts))) AS i FROM sp)),
si AS (SELECT doc_id, word, unnest(regexp_extract_all(regexp_extract(part, '{SPDX_EXPRESSION}', 1), '{SPDX_ID}')) AS id FROM sq),
sn AS (SELECT doc_id, ids.license, CAST(word AS INT) AS word, 1.0 AS share FROM si JOIN ids ON ids.id = regexp_replace(lower(si.id), '(?:-only|-or-later|\+)?\.*$', '')),
r AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, count(DISTINCT license) AS n_licenses, max(share) AS best_share, min(word) AS first_word FROM (SELECT doc_id, license, word, share FROM k UNION ALL SELECT * FROM sn) GROUP BY 1)
SELECT doc_id, coalesce(licenses, '') AS licenses, coalesce(n_licenses, 0) AS n_licenses, coalesce(best_share, 0.0)::DOUBLE AS best_share, coalesce(first_word, -1)::INT AS first_word FROM documents LEFT JOIN r USING (doc_id)"""
}
