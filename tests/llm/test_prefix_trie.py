import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

from docquarry.llm.prefix_trie import trie


def brute(rows):
    """Nodes by dictionaries of whole prefixes."""
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    whole = {c: own.get(c - int(math.fmod(c, 20)), [])[: (h := zlib.crc32(str(c).encode()) % 4)] + v[h:] for c, v in own.items()}
    members = defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out, sums = [], {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        sums[p] = (sum(sums[k][0] for k in kids[p]) or 1, (len(members[p]) - 1) * words + sum(sums[k][1] for k in kids[p]))
        ends = ",".join(map(str, sorted(c for c in members[p] if len(whole[c]) == len(p))))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), *sums[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def nodes(spark, rows, more=()):
    df = spark.createDataFrame([(*r, *more) for r in rows], "conv_id long, turn long, role string, text string" + ", node string, `h1.x` int" * bool(more))
    return sorted(tuple(r[n] for n in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in trie(df.repartition(3)).collect())


def test_nodes_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice(["", None, "a b", "hello  there\tyou", "x"])) for c in [*range(25), *range(40, 47), 1000, 1005] for t in [None, *range(rng.randrange(6))][rng.randrange(2) :]]
    rows += [(60, t, "user", "all the same") for t in range(40)] + [(c, t, "user", "all the same") for c in (61, 62, 63, 64) for t in range(40)]  # deep, copies of a whole conversation
    rows += [(21, 2, "user", "twice"), (21, 2, "user", "twice"), (22, 2, "b", "tie"), (22, 2, "a", "tie"), (None, 1, "user", "of none"), (-7, 0, "user", "below zero"), (-40, 0, "bot", "below zero")]
    rows += [(c, 0, "user", "one first turn") for c in range(100, 300)]
    assert nodes(spark, rows, ("x", 1)) == sorted(brute(rows))


def test_turnless_conversation_is_a_member_of_the_root(spark):
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 1)
    rows = [(c, 0, "user", "its only turn is replaced, and there is no base")]
    assert nodes(spark, rows) == sorted(brute(rows)) and len(nodes(spark, rows)) == 1


def test_empty_table_gives_no_rows(spark):
    assert nodes(spark, []) == []
