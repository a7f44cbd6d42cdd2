"""Near-duplicate groups by MinHash and an LSH forest.

1. Every text becomes its set of distinct shingles; equal sets are one class, so that copies cost one row each
   and no pairs. MinHash gives each class ``trees`` sequences of ``depth`` values.
2. Forest: for each tree the classes are dealt out and sorted by their sequence, over all tasks, so that a group
   of any size is many ranges. A region is a run that agrees in the first ``least_depth`` values. Inside a region
   depth follows the data: each class has as candidates the first class of the deepest run in which it is not
   the first itself, and its neighbours in the order, which share the longest common prefix with it: in a region
   of up to ``neighbours`` + 1 classes all others, in a larger one the next.
3. Links: (a) each class with the candidate of the longest prefix over all trees; (b) candidates that lie in
   different components: all in small regions, in larger ones again those of the longest prefix; (c) what the
   orders leave open, that is classes of larger regions that still hold several components, by an exact join
   on their rarest shingles (see ``_rest``). Every link is confirmed on the full sets.
4. Components of the links (see ``components``), then back to the documents.

A pair of similarity 0.85 shares a region in some tree with probability 1 - (1 - 0.85^3)^16 > 0.9999997, and is
then compared or already connected: no region is too large, and no candidate is dropped.

Defined results: null, empty and blank texts have no shingles, n_shingles 0 and no links; a text of fewer
words than a shingle is one shingle; rows that repeat a text are linked; rows that repeat a doc_id with other
texts are linked each by its own text; a row without doc_id is linked with nothing: its component_id is null
and it is kept; an empty table gives no rows. Only the id and the text are read, so other columns may have any
names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.llm.components import components
from docquarry.llm.skewed import joined
from docquarry.llm.textkeys import SPACED, keyed, mix64, quoted, shingle_keys, slices
from docquarry.session import saved, table

SHINGLE = 5


def shingle_sets(texts: list[str | None], shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle keys of each text."""
    _, _, _, words, bounds = keyed(texts, SPACED)
    out = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        own = words[a:b]
        out.append(np.unique(shingle_keys(own, min(shingle, len(own)))) if len(own) else own)
    return out


def _digest(keys: np.ndarray) -> bytes | None:
    return hashlib.blake2b(keys.tobytes(), digest_size=16).digest() if len(keys) else None


class MinHash:
    def __init__(self, n: int, seed: int = 1):
        self.a = mix64(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)
        self.b = mix64(self.a + np.uint64(77))

    def __call__(self, keys: np.ndarray, step: int = 2048) -> np.ndarray:
        low = np.full(len(self.a), 2**32 - 1, np.uint64)
        for i in range(0, len(keys), step):
            low = np.minimum(low, ((keys[i : i + step, None] * self.a + self.b) >> np.uint64(32)).min(0))
        return low.astype(">u4")


def _signatures(docs: DataFrame, trees: int, depth: int, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(trees * depth)
        for part in slices(batches, "text", 1 << 19):
            sets = shingle_sets(part.column("text").to_pylist(), shingle)
            digest = [_digest(s) for s in sets]
            sig = [minhash(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "digest", "sig"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, sig binary")


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int, most_broadcast: int = 500_000) -> DataFrame:
    """node, keys (sorted little-endian u64) of the classes ``wanted`` (node, rep, digest), read from the rows of
    their ids; a class comes as often as its id and text are repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = shingle_sets(part.column("text").to_pylist(), shingle)
            digest = [_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary()), part.column("doc_id")], names=["digest", "keys", "rep"])

    few = wanted.count() <= most_broadcast  # 24 bytes each

    def sent(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df

    some = docs.join(sent(wanted.select(F.col("rep").alias("doc_id")).distinct()), "doc_id", "left_semi").mapInArrow(run, "digest binary, keys binary, rep long")
    return some.join(sent(wanted), ["rep", "digest"]).select("node", "keys")


def _forest(signatures: DataFrame, classes: int, trees: int, depth: int, least: int, neighbours: int, rows_per_range: int) -> DataFrame:
    """The trees' sorted orders: h (region), node, parent, up (prefix shared with it), next (a list), along (prefix
    shared with the first of it) and small (whether the region has no others than these), for each class and tree
    that has neighbours."""
    spark, size, edge = signatures.sparkSession, 4 * depth, neighbours + 1
    keys = F.array(*[F.substring("sig", t * size + 1, size) for t in range(trees)])
    rows = signatures.select("node", F.posexplode(keys).alias("tree", "key")).select(F.lit(0).alias("border"), "tree", "key", "node", F.xxhash64("tree", F.substring("key", 1, 4 * least)).alias("h"))
    ranges = max(spark.sparkContext.defaultParallelism, classes * trees // rows_per_range)
    found = "h long, node long, parent long, up int, next array<long>, along int, small boolean"
    more = [("border", pa.string()), ("tree", pa.int32()), ("key", pa.binary())]

    def walk(rows: pa.Table, inside: bool) -> pa.RecordBatch:
        """``inside``: these rows are a piece of the order, which goes on before and behind them."""
        n = rows.num_rows
        values = np.frombuffer(b"".join(rows.column("key").to_pylist()), ">u4").reshape(n, depth)
        node, h, tree, border = (rows.column(c).to_numpy() for c in ("node", "h", "tree", "border"))
        same = (values[1:] == values[:-1]) & ((tree[1:] == tree[:-1]) & (border[1:] == border[:-1]))[:, None]
        lcp = np.zeros(n + 1, np.int64)  # with the row before; 0 at both ends
        lcp[1:n] = np.where(same.all(1), depth, np.argmin(same, 1))
        at, head = np.arange(n), np.zeros(n, np.int64)
        for d in range(least, depth + 1):
            first = np.maximum.accumulate(np.where(lcp[:n] < d, at, 0))
            head = np.where(lcp[:n] == d, first, head)
        begin = np.flatnonzero(lcp[:n] < least)
        count = np.diff([*begin, n])
        region, size = np.repeat(np.arange(len(begin)), count), np.repeat(count, count)
        small = (size <= edge) & (region > 0) & (region < len(begin) - 1) & inside
        some = np.flatnonzero(size > 1)
        behind = np.repeat(begin + count, count) - at - 1
        width = np.where(small, behind, np.minimum(behind, 1))[some]
        places = np.repeat(some - np.cumsum(width) + width, width) + np.arange(int(width.sum())) + 1
        out = {
            "h": pa.array(h[some], pa.int64()),
            "node": pa.array(node[some], pa.int64()),
            "parent": pa.array(node[head[some]], pa.int64(), mask=lcp[:n][some] < least),
            "up": pa.array(lcp[:n][some], pa.int32()),
            "next": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(width)]), pa.int32()), pa.array(node[places], pa.int64())),
            "along": pa.array(lcp[1:][some], pa.int32()),
            "small": pa.array(small[some]),
        }
        return pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The piece's rows, and then its first and last ones as they came, for the borders."""
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        out = walk(rows, True)
        yield pa.RecordBatch.from_arrays([*out.columns, *(pa.nulls(out.num_rows, t) for _, t in more)], names=[*out.schema.names, *(n for n, _ in more)])
        for side, ends in (("first", rows.slice(0, edge)), ("last", rows.slice(max(0, rows.num_rows - edge)))):
            for part in ends.combine_chunks().to_batches():
                n = part.num_rows
                made = {"h": part.column("h"), "node": part.column("node"), "border": pa.array([side] * n), "tree": part.column("tree"), "key": part.column("key")}
                yield pa.RecordBatch.from_arrays([made.get(f.name, pa.nulls(n, f.type)) for f in [*out.schema, *(pa.field(*m) for m in more)]], names=[*out.schema.names, *(m for m, _ in more)])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield walk(pa.Table.from_batches(held).combine_chunks(), False)

    order = ["tree", "key", "node"]
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(inner, f"{found}, border string, tree int, key binary")
    dealt = saved(dealt.withColumn("piece", F.spark_partition_id()), "orders")
    # The last rows of each piece and the first of the next one that has rows meet at a border of their own.
    ends = dealt.where("border IS NOT NULL")
    pieces = sorted(r[0] for r in ends.select("piece").distinct().collect())  # one number for each piece
    places = spark.createDataFrame(list(zip(pieces, range(len(pieces)), strict=True)), "piece int, place int")
    ends = ends.join(F.broadcast(places), "piece").select((F.col("place") - (F.col("border") == "first").cast("int")).alias("border"), *order, "h")
    ends = ends.repartition("border").sortWithinPartitions("border", *order).mapInArrow(across, found)
    names = [c.split()[0] for c in found.split(", ")]
    return dealt.where("border IS NULL").select(*names).unionByName(ends)


def _similar(common: np.ndarray, a: int | np.ndarray, b: int | np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (a + b - common)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    place = np.searchsorted(b, a)
    place[place == len(b)] = len(b) - 1
    return int((b[place] == a).sum())


def _keys(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), "<u8")


def _parts(df: DataFrame, rows: int, rows_per_part: int = 2000) -> int:
    """Partitions for ``rows`` rows that carry sets: some ten megabytes each, so that batches stay small."""
    return max(df.sparkSession.sparkContext.defaultParallelism, rows // rows_per_part + 1)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, per_salt: int = 250) -> DataFrame:
    """Of pairs (hub, doc), those whose sets are similar, as links (a, b). A hub's set is sent once for
    ``per_salt`` partners, which may go to different tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for h, role, doc, keys in zip(*(batch.column(c) for c in ("hub", "role", "doc", "keys")), strict=True):
                h, doc, keys = h.as_py(), doc.as_py(), _keys(keys)
                if role.as_py() == 0:
                    hub, own = h, keys.copy()
                elif h == hub and len(own) and len(keys) and _similar(_common(own, keys), len(own), len(keys), percent):
                    a.append(hub)
                    b.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    pairs = saved(pairs, "pairs")
    n = pairs.groupBy("hub").agg(F.ceil(F.count("*") / per_salt).cast("int").alias("salts"))
    salted = saved(joined(pairs, n, "hub").select("hub", "doc", F.pmod(F.xxhash64("doc"), F.col("salts")).cast("int").alias("salt")), "salted")
    s = sets.withColumnRenamed("node", "doc")
    members = salted.join(s, "doc").select("hub", "salt", F.lit(1).alias("role"), "doc", "keys")
    hubs = salted.select("hub", "salt").distinct().withColumn("doc", F.col("hub")).join(s, "doc").select("hub", "salt", F.lit(0).alias("role"), "doc", "keys")
    rows = hubs.unionByName(members).repartition(_parts(pairs, pairs.count()), "hub", "salt").sortWithinPartitions("hub", "salt", "role")
    return rows.select("hub", "role", "doc", "keys").mapInArrow(run, "a long, b long")


def block_links(members: list[tuple[int, int, np.ndarray]], queries: list[tuple[int, int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links between queries and members (doc, component, sorted keys) that join components, found from the
    counts of common keys of each query with all members at once."""
    if not members:
        return []
    links, root = [], {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    size = np.array([len(k) for _, _, k in members])
    keys = np.concatenate([k for _, _, k in members])
    owner = np.repeat(np.arange(len(members)), size)
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    for doc, component, own in queries:
        low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        common = np.bincount(owner[at], minlength=len(members))
        for i in np.flatnonzero(_similar(common, len(own), size, percent) & (common > 0)):
            a, b = find(component), find(members[i][1])
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((doc, members[i][0]))
    return links


def _rest(members: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links (a, b) that join components among the classes of open regions (h, node, component), by an exact join.

    In each region all but the largest component ask; so of every two classes of a region that are not connected
    one asks at least. Shingles are ordered by how many of these classes have them. The rarest
    n - ceil(percent n / 100) + 1 shingles of one that asks hold one of any set that is similar enough, so classes
    meet at those only. Shingles that one class alone has fill these places first, so classes that share no more
    than a template do not meet. Shingles of the same classes are one group. Groups that share classes are a
    cluster, compared as a whole if it has up to 16 blocks of ``block`` sets, so that a set moves once; the groups
    of larger ones are compared each.
    """

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, asks, keys in zip(batch.column("node").to_pylist(), batch.column("asks").to_pylist(), batch.column("keys"), strict=True):
                own = np.frombuffer(keys.as_buffer(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(np.full(len(own), node), pa.int64()), pa.array(np.full(len(own), asks), pa.bool_())], names=["key", "node", "asks"])

    largest = members.groupBy("h", "component").agg(F.count("*").alias("n")).groupBy("h").agg(F.max(F.struct("n", "component"))["component"].alias("top"))
    named = saved(joined(members, largest, "h").groupBy("node", "component").agg(F.max(F.col("component") != F.col("top")).alias("asks")), "named")
    few = F.broadcast(named) if named.count() <= 500_000 else named  # 17 bytes each
    tokens = saved(sets.join(few, "node").mapInArrow(exploded, "key long, node long, asks boolean"), "tokens")
    counts = tokens.groupBy("key").agg(F.count("*").alias("f"), F.max("asks").alias("asked")).where("asked AND f > 1").select("key", "f")
    shared = tokens.where("asks").select("key", "node").join(counts.hint("merge"), "key").join(sizes, "node")
    own = Window.partitionBy("node")
    places = F.col("n_shingles") - F.ceil(F.col("n_shingles") * percent / 100) + 1 - (F.col("n_shingles") - F.count("*").over(own))
    prefix = saved(shared.withColumns({"places": places, "place": F.row_number().over(own.orderBy("f", "key"))}).where("place <= places").select("key", "node"), "prefixes")
    others = tokens.where("NOT asks").select("key", "node").join(prefix.select("key").distinct().hint("merge"), "key")
    prefix = saved(prefix.unionByName(others).join(named.select("node", "component"), "node"), "prefixes")
    groups = prefix.groupBy("key").agg(F.count("*").alias("c"), F.min("component").alias("x"), F.max("component").alias("y"), F.bit_xor(F.xxhash64("node")).alias("p"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("q")).where("c > 1 AND x != y")
    groups = groups.groupBy("c", "x", "y", "p", "q").agg(F.min("key").alias("key"))
    met = saved(joined(prefix, groups.select("key"), "key").select(F.col("key").alias("h"), F.col("node").alias("doc"), "component"), "groups")
    least = met.groupBy("h").agg(F.min("doc").alias("b"))
    clusters = components(joined(met.select("h", F.col("doc").alias("a")), least, "h").select("a", "b")).select(F.col("node").alias("doc"), F.col("component").alias("cluster"))
    large = clusters.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") > 16 * block).select("cluster")
    apart = joined(saved(met.join(clusters, "doc"), "clusters"), large.withColumn("large", F.lit(True)), "cluster", "left")
    whole = apart.where("large IS NULL").select(F.col("cluster").alias("h"), "doc", "component").distinct()
    return _compared(saved(whole.unionByName(apart.where("large").select("h", "doc", "component")), "compared"), sets, percent, block)


def _compared(regions: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links in groups (h, doc, component) that hold several components: those outside the group's
    largest component against all members, in blocks of about ``block`` members."""
    per = regions.groupBy("h", "component").agg(F.count("*").alias("n"))
    top = per.groupBy("h").agg(F.sum("n").alias("c"), F.max(F.struct("n", F.col("component").alias("top"))).alias("x")).select("h", F.col("x.top").alias("top"), F.ceil(F.col("c") / block).cast("int").alias("rows"), F.greatest(F.lit(1), F.ceil((F.col("c") - F.col("x.n")) / (2 * block))).cast("int").alias("columns"))
    named = joined(regions, top, "h")
    total = named.agg(F.sum(F.col("columns") + F.when(F.col("component") != F.col("top"), F.col("rows")).otherwise(0))).first()[0] or 0

    def one(n: str) -> Column:
        return F.pmod(F.xxhash64("doc", "h"), F.col(n)).cast("int")

    def each(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    # A grid: members by row, queries by column, and each meets all of the other.
    members = named.select("h", one("rows").alias("i"), each("columns").alias("j"), F.lit(0).alias("role"), "doc", "component")
    queries = named.where("component != top").select("h", each("rows").alias("i"), one("columns").alias("j"), F.lit(1).alias("role"), "doc", "component")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, queries = None, [], []

        def links() -> pa.RecordBatch:
            found = block_links(members, queries, percent)
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            for h, i, j, role, doc, component, keys in zip(*(batch.column(c) for c in ("h", "i", "j", "role", "doc", "component", "keys")), strict=True):
                now = (h.as_py(), i.as_py(), j.as_py())
                if now != key:
                    if queries:
                        yield links()
                    key, members, queries = now, [], []
                (members if role.as_py() == 0 else queries).append((doc.as_py(), component.as_py(), _keys(keys).copy()))
                if len(queries) >= 4 * block:
                    yield links()
                    queries = []
        if queries:
            yield links()

    both = members.unionByName(queries).join(sets.withColumnRenamed("node", "doc"), "doc")
    rows = both.repartition(_parts(regions, total), "h", "i", "j").sortWithinPartitions("h", "i", "j", "role")
    return rows.select("h", "i", "j", "role", "doc", "component", "keys").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, trees: int = 16, depth: int = 6, least_depth: int = 3, neighbours: int = 3, block: int = 256, rows_per_range: int = 300_000, shingle: int = SHINGLE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``."""
    docs = docs.select(F.col(quoted([key])[0]).cast("long").alias("doc_id"), F.col(quoted([text])[0]).alias("text"))
    rows = saved(_signatures(docs, trees, depth, shingle), "signatures")
    # Rows with no id or no shingles take no part in what follows.
    full = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n_shingles"))
    classes = saved(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    found = saved(full.join(classes.select(F.col("rep").alias("doc_id"), "digest", "node"), ["doc_id", "digest"]).select("node", "sig"), "class-signatures")
    n_classes = classes.count()
    once = found.count() == n_classes  # no row repeats both id and text of a class
    forest = saved(_forest(found if once else found.dropDuplicates(["node"]), n_classes, trees, depth, least_depth, neighbours, rows_per_range), "forest")
    near = forest.select("node").distinct()
    sets = _sets(docs, classes.select("node", "rep", "digest").join(near, "node", "left_semi"), shingle)
    sets = saved(sets if once else sets.dropDuplicates(["node"]), "sets")

    ups = forest.where("parent IS NOT NULL").groupBy("node").agg(F.max(F.struct("up", (-F.col("parent")).alias("less")))["less"].alias("less"))
    parts = components(saved(_confirmed(ups.select((-F.col("less")).alias("hub"), F.col("node").alias("doc")), sets, percent), "links"))

    def more(parts: DataFrame, links: DataFrame) -> DataFrame:
        """The components after further links; those before stand for the links that made them."""
        return components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(saved(links, "links")))

    def named(df: DataFrame, column: str, name: str) -> DataFrame:
        """``df`` with the component of the class in ``column``: itself if it has no link."""
        return joined(df, parts.select(F.col("node").alias(column), F.col("component").alias(name)), column, "left").withColumn(name, F.coalesce(name, column))

    pairs = forest.select("node", F.explode("next").alias("other"), F.col("along").alias("lcp"), "small").unionByName(forest.where("parent IS NOT NULL").select("node", F.col("parent").alias("other"), F.col("up").alias("lcp"), "small"))
    pairs = saved(pairs.groupBy("node", "other").agg(F.max("lcp").alias("lcp"), F.max("small").alias("small")), "candidates")
    apart = named(saved(named(pairs, "node", "own"), "candidates"), "other", "its").where("own != its")
    apart = saved(apart, "apart")
    best = apart.where("NOT small").groupBy("node").agg(F.max(F.struct("lcp", (-F.col("other")).alias("less")))["less"].alias("less")).select("node", (-F.col("less")).alias("other"))
    chosen = apart.where("small").select("node", "other").unionByName(best).select(F.least("node", "other").alias("hub"), F.greatest("node", "other").alias("doc")).distinct()
    parts = more(parts, _confirmed(chosen, sets, percent))

    # Regions that are not small and still hold several components.
    members = saved(named(forest.where("NOT small").select("h", "node"), "node", "component"), "members")
    mixed = members.groupBy("h").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("h")
    left = saved(joined(members, mixed, "h", "left_semi"), "open")
    if not left.isEmpty():
        parts = more(parts, _rest(left, classes.select("node", "n_shingles"), sets, percent, block))
    return _assigned(rows, classes, parts)


def _assigned(rows: DataFrame, classes: DataFrame, parts: DataFrame) -> DataFrame:
    """Every row with the least doc_id of its class's component."""
    linked = saved(parts.join(classes.select("node", "rep"), "node").select("node", "component", "rep"), "linked")
    least = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    ids = joined(linked, least, "component").select("node", "component_id")
    named = classes.join(ids, "node", "left").select("digest", F.coalesce("component_id", "rep").alias("component_id"))
    some = joined(rows.where("n_shingles > 0").select("doc_id", "n_shingles", "digest"), named, "digest", "left").select("doc_id", "n_shingles", "component_id")
    found = some.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    found = found.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the rows whose group has a smaller id. Rows that repeat an id stay if one of them does."""
    found = near_duplicates(docs, text=text, key=key, **options).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    own = "id" + "_" * max(map(len, docs.columns))
    gone = found.where("NOT kept").select(F.col("doc_id").alias(own))
    return docs.join(gone, F.col(quoted([key])[0]) == F.col(own), "left_anti")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = {
    "op2_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other),
m AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)"""
}
