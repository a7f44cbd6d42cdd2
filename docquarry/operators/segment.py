"""Markdown to chunks and paragraphs, as arrays of lines.

A text's lines are one array of its row; slices between page markers, headings and the first lines of paragraphs give
the page, the chunk, the paragraph and the headings above it. Nothing is dealt or sorted by line: chunks and paragraphs
are found where their text lies, in time linear in its lines (heading paths apart, which are a fold).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.functions.ids import chunk_id, paragraph_ref, sha256

# Lines that mark a page, and headings (a heading of blanks alone is an empty one).
PAGE = r"(?i)^##\s+Page\s+(\d+)\s*$"
HEADING = r"^(#{1,6})\s+(.+?)\s*$"
#: No text whose lines end in \\n holds it: what stands where a text is cut, as one character is found far faster than
#: a regular expression.
CUT = "\x0b"


def _places(items: Column, holds) -> Column:
    """The positions (from 0) of the items that hold."""
    return F.filter(F.transform(items, lambda x, i: F.when(holds(x, i), i)), lambda i: i.isNotNull())


def _cut(items: Column, at: Column) -> Column:
    """Slices of an array: each begins at its position (from 0, rising) and ends where the next begins. Both are bound."""
    return F.transform(at, lambda a, i: F.slice(items, a + 1, F.coalesce(F.get(at, i + 1), F.size(items)) - a))


def _runs(items: Column, holds) -> Column:
    """The slice before the first item that holds (may be empty), then one that begins at each item that holds."""
    return T.bound(F.concat(F.array(F.lit(0)), _places(items, holds)), lambda at: _cut(items, at))


def _page_no(line: Column) -> Column:
    page = F.regexp_extract(line, PAGE, 1)
    return F.when(line.startswith("#") & (page != ""), page.cast("int"))


def _level(line: Column) -> Column:
    """Of headings; page markers are none."""
    return F.when(line.startswith("#") & line.rlike(HEADING) & _page_no(line).isNull(), F.length(F.regexp_extract(line, HEADING, 1)))


def _title(line: Column) -> Column:
    """Of a heading, closing signs included."""
    return T.strip(F.regexp_extract(line, HEADING, 2))


def _content(lines: Column) -> Column:
    """Of a chunk's lines below its heading."""
    shown = F.filter(lines, lambda x: ~(x.contains("---") & (T.strip(x) == "---")))
    joined = F.array_join(F.transform(shown, T.rstrip), "\n")
    return T.bound(joined, lambda x: T.strip(F.when(x.contains("\n\n\n"), F.regexp_replace(x, "\n{3,}", "\n\n")).otherwise(x)))


def _section(piece: Column) -> Column:
    """The chunk of a heading and the lines below it."""
    head = F.get(piece, F.lit(0))
    shown = F.transform(F.filter(F.slice(piece, F.lit(2), F.size(piece) - 1), lambda x: ~x["mark"]), lambda x: x["line"])
    return F.struct(T.clean_heading(_title(head["line"])).alias("heading"), _content(shown).alias("content"), head["page"].alias("page_start"), F.element_at(piece, -1)["page"].alias("page_end"))


def _paged_sections(text: Column, heading_level: int) -> Column:
    marked = F.transform(T.plain_lines(text), lambda line: F.struct(line.alias("line"), _page_no(line).alias("page_no"), _level(line).alias("level")))

    def paged(piece: Column) -> Column:
        page = F.get(piece, F.lit(0))["page_no"]
        return F.transform(piece, lambda x: F.struct(x["line"].alias("line"), x["level"].alias("level"), x["page_no"].isNotNull().alias("mark"), page.alias("page")))

    lines = T.bound(marked, lambda own: F.flatten(F.transform(_runs(own, lambda x, i: x["page_no"].isNotNull()), paged)))
    pieces = T.bound(lines, lambda own: _runs(own, lambda x, i: F.coalesce(x["level"] <= heading_level, F.lit(False))))
    opened = F.filter(pieces, lambda p: F.coalesce(F.get(p, F.lit(0))["level"] == heading_level, F.lit(False)))
    return F.transform(opened, _section)


def _unpaged_sections(pieces: Column, heading_level: int) -> Column:
    """As ``_paged_sections``, of a text without page markers that is cut before headings."""
    no_page = F.lit(None).cast("int")

    def section(piece: Column) -> Column:
        below = F.coalesce(F.get(F.split(piece, "\n", 2), F.lit(1)), F.lit(""))
        heading = T.clean_heading(_title(F.substring_index(piece, "\n", 1)))
        return F.struct(heading.alias("heading"), _content(F.split(below, "\n")).alias("content"), no_page.alias("page_start"), no_page.alias("page_end"))

    return F.transform(F.filter(pieces, lambda p: p.rlike(rf"^#{{{heading_level}}}[ \t]")), section)


def _sections(text: Column, heading_level: int) -> Column:
    """Texts are cut before their headings at once; only those with page markers, or where what looks like a heading is
    none, are read line by line."""
    level = max(2, heading_level)  # page markers are of level 2

    def found(x: Column) -> Column:
        if heading_level < level:
            return _paged_sections(x, heading_level)
        marked = F.concat(F.lit("\n"), x)
        for signs in ("#" * n + blank for n in range(1, level + 1) for blank in " \t"):
            marked = F.replace(marked, F.lit(f"\n{signs}"), F.lit(f"{CUT}{signs}"))
        odd = rf"^(?:##[ \t]+(?i:page)[ \t]|#{{1,{level}}}[ \t](?:\n|$))"
        return T.bound(F.split(marked, CUT), lambda own: F.when(F.exists(own, lambda p: p.rlike(odd)), _paged_sections(x, heading_level)).otherwise(_unpaged_sections(own, heading_level)))

    return F.filter(T.bound(T.plain_ends(text), found), lambda c: F.length(c["content"]) > 0)


def header_chunks(docs: DataFrame, keys: list[str], text: str = "markdown", heading_level: int = 2) -> DataFrame:
    """keys, index, heading, content, page_start, page_end: one row for each chunk that has text.

    A heading of the level opens a chunk, one above it closes without opening; deeper headings are text.
    Page markers set the page and are dropped, ``---`` lines too; runs of blank lines become one.
    """
    found = docs.select(*keys, F.posexplode(_sections(F.col(text), heading_level)).alias("index", "__c"))
    return found.select(*keys, "index", "__c.heading", "__c.content", "__c.page_start", "__c.page_end")


def with_chunk_ids(chunks: DataFrame, document_ref: Column, version: Column) -> DataFrame:
    return chunks.withColumn("chunk_id", chunk_id(document_ref, version, F.col("index"), F.col("heading"), F.col("content")))


def heading_paths(titles: Column) -> Column:
    """The path at each of the headings (level, title) in order: each cuts the path before it to level - 1 and is
    added, so a path has six titles at most."""

    def step(paths: Column, h: Column) -> Column:
        path = F.coalesce(F.get(paths, F.size(paths) - 1), F.expr("cast(array() as array<string>)"))
        return F.concat(paths, F.array(F.concat(F.slice(path, F.lit(1), F.least(h["level"] - 1, F.size(path))), F.array(h["title"]))))

    return F.aggregate(titles, F.expr("cast(array() as array<array<string>>)"), step)


def _none() -> Column:
    return F.expr("cast(array() as array<string>)")


def _may_show(text: Column) -> Column:
    """Whether there may be references of images."""
    return text.contains("![") | (text.contains("<") & text.rlike("(?i)<img"))


#: Kinds of lines: text, what ends a paragraph, images alone, a heading (which ends one too).
_TEXT, _BREAK, _IMAGE, _HEAD = range(4)


def _kinds(text: Column) -> Column:
    """line, refs, kind of each line."""

    def refs(line: Column) -> Column:
        return F.when(_may_show(line), T.image_refs(line)).otherwise(_none())

    def kind(x: Column) -> Column:
        line = x["line"]
        image = (F.size(x["refs"]) > 0) & T.is_image_only(line)
        return F.when(_level(line).isNotNull(), _HEAD).when(_page_no(line).isNotNull(), _BREAK).when(image, _IMAGE).when(T.is_blank(line), _BREAK).otherwise(_TEXT)

    lines = F.transform(T.plain_lines(text), lambda line: F.struct(line.alias("line"), refs(line).alias("refs")))
    return F.transform(lines, lambda x: F.struct(x["line"].alias("line"), x["refs"].alias("refs"), kind(x).alias("kind")))


def _starts(lines: Column) -> Column:
    """at, heads: where paragraphs begin, and how many headings are above. A line of images alone is looked through."""
    solid = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), x["kind"].alias("kind"))), lambda x: x["kind"] != _IMAGE)

    def below(run: Column, heads: Column) -> Column:
        begins = lambda x, k: (x["kind"] == _TEXT) & ((k == 0) | (F.get(run, k - 1)["kind"] != _TEXT))
        return F.filter(F.transform(run, lambda x, k: F.when(begins(x, k), F.struct(x["at"].alias("at"), heads.alias("heads")))), lambda x: x.isNotNull())

    return F.flatten(F.transform(T.bound(solid, lambda own: _runs(own, lambda x, i: x["kind"] == _HEAD)), below))


def _refs(lines: Column) -> Column:
    return F.flatten(F.transform(lines, lambda x: x["refs"]))


def _pieces(lines: Column, starts: Column) -> Column:
    """text, own, next of each paragraph begun: its references, and those of images inside, which are the next one's."""

    def piece(p: Column, last: Column) -> Column:
        ended = F.array_position(F.transform(p, lambda x: x["kind"].isin(_BREAK, _HEAD)), F.lit(True))
        end = F.when(ended > 0, ended - 1).otherwise(F.size(p))
        return T.bound(end, lambda e: F.struct(
            F.array_join(F.transform(F.filter(p, lambda x: x["kind"] == _TEXT), lambda x: x["line"]), "\n").alias("text"),
            _refs(F.filter(p, lambda x, i: (x["kind"] == _TEXT) | ((x["kind"] == _IMAGE) & (last | (i >= e))))).alias("own"),
            _refs(F.filter(p, lambda x, i: (x["kind"] == _IMAGE) & (i < e))).alias("next"),
        ))

    at = F.transform(starts, lambda s: s["at"])
    return F.transform(T.bound(at, lambda a: _cut(lines, a)), lambda p, j: piece(p, j == F.size(starts) - 1))


def _lined_paragraphs(text: Column) -> Column:
    heads = lambda lines: F.transform(F.filter(lines, lambda x: x["kind"] == _HEAD), lambda x: F.struct(_level(x["line"]).alias("level"), _title(x["line"]).alias("title")))

    def whole(lines: Column, starts: Column, pieces: Column, paths: Column) -> Column:
        first = _refs(F.filter(F.slice(lines, F.lit(1), F.coalesce(F.get(starts, F.lit(0))["at"], F.lit(0))), lambda x: x["kind"] == _IMAGE))

        def one(p: Column, j: Column, before: Column) -> Column:
            n = F.get(starts, j)["heads"]
            path = F.when(n > 0, F.get(paths, n - 1)).otherwise(F.expr("cast(array() as array<string>)"))
            return F.struct(p["text"].alias("text"), path.alias("heading_path"), F.array_distinct(F.concat(F.coalesce(F.get(pieces, j - 1)["next"], before), p["own"])).alias("image_refs"))

        return T.bound(first, lambda before: F.transform(pieces, lambda p, j: one(p, j, before)))

    # A chunk's paths are found once, and each paragraph takes that of the last heading above it.
    return T.bound(_kinds(text), lambda x: T.bound(_starts(x), lambda s: T.bound(_pieces(x, s), lambda p: T.bound(heading_paths(heads(x)), lambda paths: whole(x, s, p, paths)))))


def _bare_paragraphs(text: Column) -> Column:
    """As ``_lined_paragraphs``, of a text without images and lines of blanks, whose first line alone may be a heading."""
    first = F.substring_index(text, "\n", 1)
    level = _level(first)
    path = F.when(level.isNotNull(), F.array(_title(first))).otherwise(_none())
    body = F.when(level.isNotNull() | _page_no(first).isNotNull(), F.coalesce(F.get(F.split(text, "\n", 2), F.lit(1)), F.lit(""))).otherwise(text)
    pieces = F.transform(F.split(F.replace(body, F.lit("\n\n"), F.lit(CUT)), CUT), lambda p: F.btrim(p, F.lit("\n")))
    return T.bound(path, lambda own: F.transform(F.filter(pieces, lambda p: p != ""), lambda p: F.struct(p.alias("text"), own.alias("heading_path"), _none().alias("image_refs"))))


def _paragraphs(text: Column) -> Column:
    """text, heading_path, image_refs of a chunk's paragraphs, in order. Texts are cut at empty lines at once; only those
    with more headings, images or lines of blanks are read line by line."""

    def found(x: Column) -> Column:
        blanks = F.exists(F.split(x, "\n"), lambda line: (line != "") & T.is_blank(line))
        return F.when(x.contains("\n#") | _may_show(x) | blanks, _lined_paragraphs(x)).otherwise(_bare_paragraphs(x))

    return T.bound(T.plain_ends(text), found)


def paragraphs(chunks: DataFrame, keys: list[str], text: str = "search_text") -> DataFrame:
    """keys, ordinal, text, heading_path, image_refs: paragraphs of each chunk.

    Page markers, headings and blank lines end a paragraph; a line of images alone ends none: it belongs
    to the paragraph before it if that has ended, else to the next one begun, else to the last. A path holds
    titles as they are written.
    """
    found = chunks.select(*keys, F.posexplode(_paragraphs(F.col(text))).alias("__i", "__p"))
    return found.select(*keys, F.col("__i").cast("long").alias("ordinal"), "__p.text", "__p.heading_path", "__p.image_refs")


def _occurrences(identities: Column) -> Column:
    """For each text of an array its number among the equal ones: sorted, cut into equal ones, counted, sorted back."""
    placed = F.array_sort(F.transform(identities, lambda d, i: F.struct(d.alias("d"), i.alias("i"))))
    groups = T.bound(placed, lambda own: _runs(own, lambda x, k: (k > 0) & (x["d"] != F.get(own, k - 1)["d"])))
    counted = F.flatten(F.transform(groups, lambda g: F.transform(g, lambda x, m: F.struct(x["i"].alias("i"), (m + 1).alias("n")))))
    return F.when(F.size(identities) == 1, F.array(F.lit(1))).otherwise(F.transform(F.array_sort(counted), lambda x: x["n"]))


def identified_paragraphs(chunks: DataFrame, keys: list[str], text: str = "search_text", chunk: str = "chunk_id") -> DataFrame:
    """``paragraphs`` with what ``with_paragraph_ids`` adds, found inside each chunk's row: one row is one chunk."""
    x = chunks.select(*keys, _paragraphs(F.col(text)).alias("__p"))
    x = x.withColumn("__d", T.identity_texts(F.col("__p.text")))
    x = x.withColumn("__n", _occurrences(F.col("__d")))
    x = x.select(*keys, F.posexplode(F.arrays_zip("__p", "__d", "__n")).alias("__i", "__x"))
    x = x.select(*keys, F.col("__i").cast("long").alias("ordinal"), "__x.__p.text", "__x.__p.heading_path", "__x.__p.image_refs", F.col("__x.__n").alias("occurrence"), sha256(F.col("__x.__d")).alias("__h"))
    reference = F.concat_ws(":", F.col(chunk), F.substring("__h", 1, 12), F.col("occurrence").cast("string"))
    return x.select("*", reference.alias("paragraph_id"), sha256(F.col("text")).alias("exact_content_hash"), F.col("__h").alias("normalized_identity_hash")).drop("__h")


def with_paragraph_ids(paras: DataFrame, chunk: str = "chunk_id", ordinal: str = "ordinal", text: str = "text", keys: list[str] | None = None) -> DataFrame:
    """occurrence (of equal identity texts in a chunk), paragraph_id and both hashes. ``keys``: what ``paragraphs`` dealt
    its rows by, if the chunk tells all of it; they are then not dealt again."""
    keyed = paras.withColumn("identity", T.identity_text(F.col(text)))
    same = Window.partitionBy(*(keys or [chunk]), "identity").orderBy(ordinal)
    keyed = keyed.withColumn("occurrence", F.row_number().over(same))
    return keyed.withColumns(
        {"paragraph_id": paragraph_ref(F.col(chunk), F.col(text), F.col("occurrence")), "exact_content_hash": sha256(F.col(text)), "normalized_identity_hash": sha256(F.col("identity"))}
    ).drop("identity")


def with_context(paras: DataFrame, chunk: str = "chunk_id", ordinal: str = "ordinal", text: str = "text") -> DataFrame:
    """previous_context and next_context: the neighbours' texts, empty at the ends."""
    order = Window.partitionBy(chunk).orderBy(ordinal)
    return paras.withColumns({"previous_context": F.lag(text, 1, "").over(order), "next_context": F.lead(text, 1, "").over(order)})


def packed(blocks: Column, sizes: Column, target: int, joint: str = "\n\n") -> Column:
    """Blocks joined greedily into parts of at most ``target`` (a part has one block at least): a fold."""
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("part"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["n"] > 0) & (acc["n"] + x["n"] <= target)
        begins = acc["n"] == 0
        return F.struct(
            F.when(fits | begins, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["part"]))).alias("done"),
            F.when(fits, F.concat(acc["part"], F.lit(joint), x["b"])).otherwise(x["b"]).alias("part"),
            F.when(fits, acc["n"] + x["n"]).otherwise(x["n"]).cast("long").alias("n"),
        )

    pairs = F.transform(F.arrays_zip(blocks.alias("b"), sizes.alias("n")), lambda z: F.struct(z["b"].alias("b"), z["n"].cast("long").alias("n")))
    return F.aggregate(pairs, start, step, lambda acc: F.when(acc["n"] > 0, F.concat(acc["done"], F.array(acc["part"]))).otherwise(acc["done"]))


def word_slices(block: Column, size: int) -> Column:
    """A block's words in slices of ``size``; an array of one binds the words, so that they are split once."""
    sliced = lambda words: F.transform(F.sequence(F.lit(1), F.size(words), F.lit(size)), lambda i: F.array_join(F.slice(words, i, size), " "))
    return F.get(F.transform(F.array(F.split(T.collapse(block), " ")), sliced), F.lit(0))


def split_oversized(rows: DataFrame, content: str = "content", limit: int = 8000, target: int = 7600) -> DataFrame:
    """Rows over ``limit`` words as parts of at most ``target``: part, parts and the part's content.

    Blocks between blank lines are packed greedily; a block over the target is cut by words first. A row has one part at
    least, so the outer form gives the same rows, without a filter that would pack all of them once more.
    """
    body = F.col(content)
    blocks = F.filter(F.split(body, r"\n\s*\n"), lambda b: ~T.is_blank(b))
    small = F.flatten(F.transform(blocks, lambda b: F.when(T.word_count(b) > target, word_slices(b, target)).otherwise(F.array(T.strip(b)))))
    x = rows.withColumn("__small", F.when(T.word_count(body) > limit, small))
    x = x.withColumn("__parts", F.when(F.col("__small").isNull(), F.array(body)).otherwise(packed(F.col("__small"), F.transform("__small", T.word_count), target)))
    x = x.withColumn("parts", F.size("__parts")).select("*", F.posexplode_outer("__parts").alias("__i", "__c"))
    return x.withColumns({"part": F.col("__i") + 1, content: F.col("__c")}).drop("__small", "__parts", "__i", "__c")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
