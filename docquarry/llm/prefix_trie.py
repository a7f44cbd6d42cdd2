"""The trie of conversations' beginnings, with sums over subtrees by an Euler tour.

A turn's key is a hash of its place, role and text; the keys of a conversation's first d turns, combined by xor, name
its node of depth d (128 bits), so prefixes are a running value over sorted ranges and no task folds a whole
conversation. Nodes are told by depth and smallest member. The tour enters and leaves each node once: children in the
order of their smallest member. It is ranked as a list: each partition first joins the arcs that follow each other
inside it into chains, then pointer jumping ranks the chains, and a node's sums are what lies between its two arcs.

Defined results: rows without a conv_id are of no conversation; a negative one has the remainder that SQL gives; turns that tie are taken by role, then text; repeated
rows are turns of their own; null roles and texts are empty; without conversations there is no root and no row. Only
the four columns are read, so others may have any names. The hash of a node's ends reads their ids as one text, by
contract, so one task holds the ids that end at one node (eight bytes each).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.mixing import WORD
from docquarry.operators.scan import Fold, numbered, running
from docquarry.session import saved, table

NODE = ["depth", "h1", "h2"]


def _skipped(conv: Column) -> Column:
    """How many first turns of its group's first conversation a conversation begins with."""
    return F.crc32(conv.cast("string").cast("binary")) % 4


def rebuilt(turns: DataFrame, group: int = 20) -> tuple[DataFrame, DataFrame]:
    """conv_id, place, t1, t2, words of every rebuilt turn, and conv_id, length of every conversation."""
    empty = F.lit("")
    named = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    placed = running(named, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], {"place": Fold("sum", F.lit(1).cast("long"))})
    placed = saved(placed.select("conv_id", (F.col("place") - 1).alias("place"), F.xxhash64(F.lit(1), "role", "text").alias("t1"), F.xxhash64(F.lit(2), "role", "text").alias("t2"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")), "turns")
    size = placed.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), _skipped(F.col("conv_id")).alias("h"))
    lengths = size.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = saved(size.join(lengths, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))), "conversations")
    # At most three turns of a base, for at most the conversations of its group.
    begin = placed.where((F.col("conv_id") % group == 0) & (F.col("place") < 3)).withColumnRenamed("conv_id", "base").join(convs.select("conv_id", "base", "h"), "base").where("place < h").select("conv_id", "place", "t1", "t2", "words")
    rest = placed.join(convs.select("conv_id", "h", "taken"), "conv_id").where("place >= h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "t1", "t2", "words")
    return begin.unionByName(rest), convs.select("conv_id", (F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length"))


def nodes(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row for each node: depth, h1, h2, conv_id, n_convs, words, p1, p2 (the parent's key) and ends_sha256."""
    keyed = turns.select("*", F.xxhash64("place", "t1").alias("x1"), F.xxhash64(F.lit(7), "place", "t2").alias("x2"))
    path = running(keyed, ["conv_id"], [F.col("place")], {"h1": Fold("xor", F.col("x1")), "h2": Fold("xor", F.col("x2"))})
    rows = saved(path.select("conv_id", (F.col("place") + 1).alias("depth"), "h1", "h2", F.col("h1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("h2").bitwiseXOR(F.col("x2")).alias("p2"), "words"), "prefixes")
    zero = F.lit(0).cast("long")
    root = lengths.select("conv_id", zero.alias("depth"), zero.alias("h1"), zero.alias("h2"), zero.alias("p1"), zero.alias("p2"), zero.alias("words"))
    all_rows = rows.unionByName(root)
    found = all_rows.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    ending = all_rows.join(lengths, "conv_id").where("depth = length")
    ends = ending.groupBy(*NODE).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    ends = ends.select(*NODE, F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
    return saved(found.join(ends, NODE, "left").withColumn("ends_sha256", F.sha2(F.coalesce("ids", F.lit("")).cast("binary"), 256)).drop("ids"), "trie-nodes")


def arcs(tree: DataFrame) -> DataFrame:
    """The tour: id (2 * node to enter, + 1 to leave), next, and what entering adds, for nodes told by number with
    parent, first child (least number) and the last of its own siblings."""
    n = F.col("node")
    enter = tree.select((2 * n).alias("id"), F.when(F.col("first_child").isNotNull(), 2 * F.col("first_child")).otherwise(2 * n + 1).alias("next"), "leaf", "saved", "conv_id", "depth")
    leave = tree.select((2 * n + 1).alias("id"), F.when(n < F.col("last_sibling"), 2 * n + 2).otherwise(2 * F.col("parent") + 1).alias("next"), F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saved"), "conv_id", "depth")
    return enter.unionByName(leave)


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arcs of a partition joined to chains: for each arc its chain's head and what lies before it in the chain; for a
    head also where the chain goes on and what all of it adds."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    whole = pa.Table.from_batches(held)
    arc, leaf, kept = (whole.column(c).to_numpy() for c in ("id", "leaf", "saved"))
    step = pc.fill_null(whole.column("next"), -1).to_numpy()
    order = np.argsort(arc)
    at = np.searchsorted(arc[order], step)
    inside = (step >= 0) & (at < len(arc))
    inside[inside] = arc[order[at[inside]]] == step[inside]
    n = len(arc)
    before = np.full(n, -1)  # the place of the arc that leads here
    before[order[at[inside]]] = np.flatnonzero(inside)
    head, leaves, saves = np.where(before < 0, np.arange(n), before), np.zeros(n, np.int64), np.zeros(n, np.int64)
    has = before >= 0
    leaves[has], saves[has] = leaf[before[has]], kept[before[has]]
    while True:  # pointer jumping back to the heads
        far = head[head]
        if (far == head).all():
            break
        leaves, saves, head = leaves + leaves[head], saves + saves[head], far
    total, rest = np.zeros((2, n), np.int64), np.full(n, -1, np.int64)
    np.add.at(total[0], head, leaf)
    np.add.at(total[1], head, kept)
    tail = ~inside
    rest[head[tail]] = step[tail]
    is_head = before < 0
    cols = [pa.array(arc), pa.array(arc[head]), pa.array(leaves), pa.array(saves), pa.array(np.where(rest < 0, 0, rest), mask=~is_head | (rest < 0)), pa.array(total[0], mask=~is_head), pa.array(total[1], mask=~is_head)]
    out = pa.RecordBatch.from_arrays(cols, names=["id", "head", "leaves", "saves", "next", "all_leaves", "all_saves"])
    for i in range(0, n, 50_000):
        yield out.slice(i, 50_000)


def subtree_sums(tree: DataFrame, arcs_per_task: int = 500_000, most_rounds: int = 64) -> DataFrame:
    """node, n_leaves, saved_tokens: the sums over each node's subtree, by ranks in the tour."""
    tour = saved(arcs(tree), "tour")
    n = max(tour.sparkSession.sparkContext.defaultParallelism, tour.count() // arcs_per_task)
    local = saved(tour.repartitionByRange(n, "conv_id", "depth", "id").select("id", "next", "leaf", "saved").mapInArrow(_chains, "id long, head long, leaves long, saves long, next long, all_leaves long, all_saves long"), "chains")
    # What follows a chain's head, itself included, until the tour's end: jumps double each round.
    ranks = saved(local.where("id = head").select("head", "next", "all_leaves", "all_saves"), "ranks")
    for _ in range(most_rounds):
        if ranks.where("next IS NOT NULL").isEmpty():
            break
        ahead = ranks.select(F.col("head").alias("next"), F.col("next").alias("far"), F.col("all_leaves").alias("l"), F.col("all_saves").alias("s"))
        going = ranks.where("next IS NOT NULL").join(ahead, "next").select("head", F.col("far").alias("next"), (F.col("all_leaves") + F.col("l")).alias("all_leaves"), (F.col("all_saves") + F.col("s")).alias("all_saves"))
        ranks = saved(going.unionByName(ranks.where("next IS NULL")), "ranks")
    else:
        raise RuntimeError("the tour has no end")
    after = local.select("id", "head", "leaves", "saves").join(ranks.select("head", "all_leaves", "all_saves"), "head")
    sign = F.when(F.col("id") % 2 == 0, 1).otherwise(-1)
    return after.groupBy(F.shiftright("id", 1).alias("node")).agg(F.sum(sign * (F.col("all_leaves") - F.col("leaves"))).alias("n_leaves"), F.sum(sign * (F.col("all_saves") - F.col("saves"))).alias("saved_tokens"))


def trie(conversations: DataFrame, group: int = 20) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    found = nodes(*rebuilt(conversations, group))
    above = found.select((F.col("depth") + 1).alias("depth"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    joined = found.join(above, ["depth", "p1", "p2"], "left").select("depth", "conv_id", "parent_conv_id", "n_convs", "words", "ends_sha256")
    # Siblings get numbers in a row, in the order of their smallest member.
    tree = saved(numbered(joined, [F.col("depth"), F.col("parent_conv_id").asc_nulls_first(), F.col("conv_id")], "node"), "trie")
    own = tree.select((F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.col("node").alias("parent"))
    placed = saved(tree.join(own, ["depth", "parent_conv_id"], "left").select("node", "parent", "depth", "conv_id", "n_convs", "words"), "placed")
    families = saved(placed.where("parent IS NOT NULL").groupBy("parent").agg(F.min("node").alias("first_child"), F.max("node").alias("last_sibling"), F.count("*").alias("n_children")), "families")
    kids = families.select(F.col("parent").alias("node"), "first_child", "n_children")
    full = placed.join(kids, "node", "left").join(families.select("parent", "last_sibling"), "parent", "left")
    full = full.select("node", "parent", "depth", "conv_id", "first_child", "last_sibling", F.col("first_child").isNull().cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"))
    full = saved(full, "linked")
    sums = subtree_sums(full)
    return tree.drop("words").join(full.select("node", "n_children"), "node").join(sums, "node").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


SQL = {
    "op12_prefix_trie": r"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
    coalesce(role, '') AS r, coalesce(text, '') AS x
  FROM conversations WHERE conv_id IS NOT NULL),
k AS (
  SELECT c, count(*) AS n, c - c % 20 AS b,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda y: ord(y)::BIGINT)),
      lambda a, y: list_reduce(list_prepend(xor(a, y), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda e, z: xor(e >> 1, 3988292384 * (e & 1)))), 4294967295) % 4 AS h
  FROM t GROUP BY c),
m AS (
  SELECT k.c, t.pos AS p, t.r, t.x FROM k JOIN t ON t.c = k.b AND t.pos < k.h
  UNION ALL
  SELECT k.c, t.pos - k.h + least(k.h, coalesce(g.n, 0)), t.r, t.x FROM k JOIN t ON t.c = k.c LEFT JOIN k g ON g.c = k.b WHERE t.pos >= k.h),
s AS (
  SELECT c, p + 1 AS d, x, string_agg(md5(r) || md5(x), '') OVER (PARTITION BY c ORDER BY p) AS path FROM m
  UNION ALL SELECT c, 0, '', '' FROM k),
e AS (SELECT *, d = max(d) OVER (PARTITION BY c) AS last FROM s),
v AS (
  SELECT d, path, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * len(regexp_extract_all(min(x), '[^\x20\x09-\x0D]+')) AS saved,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE last), '')) AS ends_sha256
  FROM e GROUP BY d, path),
w AS (
  SELECT v.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM v q WHERE q.d = v.d + 1 AND left(q.path, v.d * 64) = v.path) AS n_children
  FROM v LEFT JOIN v p ON p.d = v.d - 1 AND p.path = left(v.path, (v.d - 1) * 64)),
u AS (SELECT unnest(range(0, d + 1)) AS a, path, saved, n_children FROM w),
z AS (SELECT a, left(path, a * 64) AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens FROM u GROUP BY ALL)
SELECT conv_id, d::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM w JOIN z ON z.a = w.d AND z.path = w.path"""
}
