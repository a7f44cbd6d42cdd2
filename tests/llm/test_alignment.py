import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from docquarry.llm.alignment import Aligner, align, merged
from docquarry.llm.packed import squeezed, unsqueezed

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "a", "Hello, World's  best\n\ttexts 123!!! it'll", "two  spaces   three    four", " leads", "trails ", "trails  ", "tab\t x\t\ty \n z", "a \nb \t\nc", "Straße ÉTÉ ŒUVRE İstanbul é x y\x85z",
    "<|endoftext|> and <s> </s> <unk> <0x41>", "a▁b", "日本語 текст 🙂🙂 ﬁ 　 x", "\x00\x01\x1c a\x1db \x7f \x1c x", "don't DON'T 's 'S''s", "ab" * 3000, "x " * 2000, "the same words the same words", "the same words the same words", "​ z ﻿ q ᠎ r",
]


def brute(texts):
    """Rows by whole texts and all pairs of tokens."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    back = {chr(x if x in own else next(rest)): x for x in range(256)}
    out, held = [], []
    for t in texts:
        ids = spans = None
        if t:
            ids = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            raw = [[bytes(back[c] for c in a.id_to_token(i)) for i in ids[0]], []]
            for i in ids[1]:
                p = b.id_to_piece(i)
                raw[1].append(bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode())
            if any(b"".join(r) != (" " + t).encode() for r in raw):
                ids = None
            else:
                spans = [list(zip(np.cumsum([0, *map(len, r)])[:-1].tolist(), np.cumsum([*map(len, r)]).tolist())) for r in raw]
        if ids is None:
            held.append(Counter())
            out.append([0, 0, 0, 0, ""])
            continue
        links, j0 = Counter(), 0
        for i, (s, e) in enumerate(spans[0]):
            while spans[1][j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(spans[1]) and spans[1][j][0] < e:
                links[ids[0][i], ids[1][j]] += 1
                j += 1
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(ids[k][n]) for n, x in enumerate(spans[k]) if low < x[1] <= e) for k in (0, 1)) if len(ends) < 500 else None)
            low = e
        if len(ends) >= 500:  # in one pass
            groups, pos = [], [0, 0]
            for e in ends:
                both = []
                for k in (0, 1):
                    n = pos[k]
                    while n < len(spans[k]) and spans[k][n][1] <= e:
                        n += 1
                    both.append(",".join(map(str, ids[k][pos[k] : n])))
                    pos[k] = n
                groups.append("|".join(both))
        held.append(links)
        out.append([len(ids[0]), len(ids[1]), len(ends), sum(links.values()), hashlib.sha256(";".join(groups).encode()).hexdigest()])
    count = Counter(p for links in held for p in links)
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    return [(*r[:4], sum(m for p, m in links.items() if count[p] == top[p[0]]), sum(m * count[p] for p, m in links.items()), r[4]) for r, links in zip(out, held, strict=True)]


def test_rows_equal_brute_force(spark):
    rng = random.Random(3)
    signs = ["a", "the", " ", " ", "  ", "\n", "\t", "é", "日", "1", "'s", "!", " ", "word", "X", "▁"]
    texts = TEXTS + ["".join(rng.choice(signs[:-1] if rng.random() < 0.9 else signs) for _ in range(rng.randrange(60))) for _ in range(300)]
    ids = [None, 7, 7, *range(3, len(texts))]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, part string, `a.b` int").repartition(5)
    got = align(df, A, B, bytes_per_pack=3000, packs_per_part=1).collect()
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted([(str(r.doc_id), *(r[n] for n in names)) for r in got]) == sorted((str(i), *r) for i, r in zip(ids, brute(texts), strict=True))


def test_empty_table_gives_no_rows(spark):
    assert align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_units_forgotten_are_learnt_again():
    import pyarrow as pa

    own, texts = Aligner(A, B, most=10), pa.array(TEXTS, pa.string())
    first, second = own.pack(texts), own.pack(texts)
    assert first[1] == second[1] and (first[0] == second[0]).all()
    assert all((x == y).all() for x, y in zip(first[2], second[2], strict=True))


def test_heap_merge_adds_counts_in_order():
    rng = np.random.default_rng(1)
    runs = []
    for n in (0, 1, 50, 1000, 20000):
        keys = np.unique(rng.integers(0, 30000, n).astype(np.uint64))
        runs.append((keys, rng.integers(1, 9, len(keys)).astype(np.uint64)))
    want = Counter()
    for keys, counts in runs:
        for k, c in zip(keys.tolist(), counts.tolist(), strict=True):
            want[k] += c
    for block in (1, 7, 4096):
        keys, counts = merged(runs, block)
        assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == want and (np.diff(keys.astype(np.int64)) > 0).all()


def test_blobs_round_trip():
    rng = np.random.default_rng(2)
    for v in (np.zeros(0, np.int64), np.array([0]), np.array([2**64 - 1], np.uint64), np.sort(rng.integers(0, 2**48, 5000)), rng.integers(0, 3, 999)):
        assert (unsqueezed(squeezed(v)) == v.astype(np.uint64)).all()
        assert (unsqueezed(squeezed(np.sort(v), True)) == np.sort(v).astype(np.uint64)).all()
