import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docquarry.llm.token_codes import Block, Encoder, pack, read, write
from docquarry.session import new_path

FILE = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Hello, World's  best\n\ttexts 123!!! it'll", "", None, "Straße ÉTÉ ŒUVRE ΣΊΣΥΦΟΣ İstanbul é  x y\x85z", "<|endoftext|> and <|startoftext|>x", "a<|endoftext|>b < | >", "日本語 текст 🙂🙂 ﬁ ǆ", "\x00\x01\x1c a\x1db \x7f", "don't DON'T l'été 's 'S''s",
    "ab" * 5000, "x " * 3000, "½ ² ³ ª º µ × ÷ ¿¡ ÿÿ Þþ", "tab\tsep\rret\x0bvt\x0cff",
]


def test_encoder_equals_the_tokenizer():
    import pyarrow as pa

    plain, code = Tokenizer.from_file(FILE), Encoder(FILE, most_words=3)
    assert code.direct
    for _ in range(2):
        ids, bounds = code.encode(pa.array(TEXTS, pa.string()))
        for i, t in enumerate(TEXTS):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == plain.encode(t or "", add_special_tokens=False).ids, t


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_codes_give_every_id_without_decoding(n):
    rng = np.random.default_rng(n)
    ids = rng.choice([3, 255, 256, 65535, 65536, 2**24, 2**32 - 1, 700], n).astype(np.uint32)
    block = Block(pack(ids, np.array([0, n // 2])))
    assert block.ids().tolist() == ids.tolist()
    assert [block[i] for i in range(n)] == ids.tolist()
    with pytest.raises(IndexError):
        block[n]


def test_files_round_trip(spark):
    plain = Tokenizer.from_file(FILE)
    rows = [(1000 - 7 * i, t) for i, t in enumerate(TEXTS * 3)] + [(None, "no id"), (5, "twice"), (5, "twice")]
    path = new_path(spark, "codes-test")
    write(spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, n_ids int, seq string"), path, FILE, block_ids=400)
    got = {}
    at = 0
    found = sorted(read(spark, path).collect(), key=lambda r: r.start)
    assert len(found) == len(rows)
    assert [r.doc_id for r in found] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k))
    for r in found:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == at and r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(r.ids)
        at += len(ids)
        got[r.doc_id] = ids
    for k, t in rows:
        assert got[k] == [*plain.encode(t or "", add_special_tokens=False).ids, 1]
    empty = new_path(spark, "codes-empty")
    write(spark.createDataFrame([], "doc_id long, text string"), empty, FILE)
    assert read(spark, empty).count() == 0
