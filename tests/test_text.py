import unicodedata

import pytest
from pyspark.sql import functions as F

from docquarry.functions import ids, text as T


def values(spark, rows, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[1] for r in df.select("i", column(F.col("x"))).orderBy("i").collect()]


SAMPLES = ["Straße", "İstanbul ſ ", "  Mélodie   HARMONIQUE ", "a\x1cb c", "ǅ ΣΊΣΥΦΟΣ", "é ẛ̣ ﬁ", "", None, "plain ASCII  text", "K Å"]


def test_case_folding_and_normal_forms(spark):
    def fold(s):
        return None if s is None else s.casefold()

    assert values(spark, SAMPLES, T.casefold) == [fold(s) for s in SAMPLES]
    for form, fn in (("NFC", T.nfc), ("NFKC", T.nfkc)):
        assert values(spark, SAMPLES, fn) == [None if s is None else unicodedata.normalize(form, s) for s in SAMPLES]


def test_keys(spark):
    def join(s):
        return " ".join(s.split())

    some = [s for s in SAMPLES if s]
    assert values(spark, some, T.concept_key) == [join(unicodedata.normalize("NFC", s)).casefold() for s in some]
    assert values(spark, some, T.identity_text) == [join(unicodedata.normalize("NFKC", s)).casefold() for s in some]
    assert values(spark, some, T.choice_key) == [join(s).casefold() for s in some]
    assert values(spark, ["  Mélodie   HARMONIQUE ", " \t", None], T.concept_key) == ["mélodie harmonique", None, None]


def test_lines_words_terms(spark):
    texts = ["a\nb", "a\r\nb\rc\n", "", "\n", "x y\x85z\x0b", "a\n\nb", None]
    assert values(spark, texts, T.lines) == [None if t is None else t.splitlines() for t in texts]
    words = ["", "  ", "one", " one  two\tthree four "]
    assert values(spark, words, T.word_count) == [len(w.split()) for w in words]
    assert values(spark, ["Hello, hello wörld-x y_z"], T.terms) == [["hello", "wörld-x", "y_z"]]


def test_images_and_headings(spark):
    line = 'see ![a](x/1.png "t") <IMG class=a src="b.jpg"> ![c](x/1.png)'
    assert values(spark, [line, "none", "![only](p.png)  <img src='q.png'/>"], T.image_refs) == [["x/1.png", "b.jpg"], [], ["p.png", "q.png"]]
    assert values(spark, [line, "![only](p.png)  <img src='q.png'/>", " "], T.is_image_only) == [False, True, True]
    assert values(spark, ["Title ##", " A # B "], T.clean_heading) == ["Title", "A # B"]
    assert values(spark, ["img/my_fig-1.v2.png", "_.png"], T.caption_fallback) == ["my fig 1.v2", "Source image"]


@pytest.mark.parametrize(
    ("fn", "good", "bad"),
    [
        (T.is_safe_document_ref, ["doc 1", "é", "a.b"], ["", " a", "a/b", "a\\b", "a:b", ".", "..", "a\x07", "é", None]),
        (T.is_safe_image_ref, ["a.png", "x/y z.png"], ["", "/a", "../a", "a/../b", "a/./b", "a//b", "a/", "http://x/a", "a\\b", " a", None]),
        (T.is_safe_artifact_ref, ["a/b.c", "con1"], ["", "a/", "a//b", "../a", "CON", "x/nul.txt", "com1.log", "a.", "a ", "a|b", "a:b", None]),
        (T.is_media_type, ["text/plain", "image/svg+xml; charset=utf-8", 'a/b; x="q; \\" z"'], ["", "text", "text/", "/x", "a b/c", "a/b;", "a/b; x", None]),
    ],
)
def test_safe_names(spark, fn, good, bad):
    assert values(spark, good, fn) == [True] * len(good)
    assert values(spark, bad, fn) == [False] * len(bad)


def test_redaction(spark):
    texts = ["api_key=abc, rest", "Password : x;y", "Authorization: Bearer abc.def", "use Bearer a-b_c now", "my s3cret and s3cret2", "nothing"]
    got = values(spark, texts, lambda c: T.redact(c, ("s3cret", "s3cret2")))
    assert got == ["api_key=[REDACTED], rest", "Password : [REDACTED];y", "Authorization: Bearer [REDACTED]", "use Bearer [REDACTED] now", "my [REDACTED] and [REDACTED]", "nothing"]
    odd = ["COOKIE=bearer  x, y", "token: Bearer", "token = BEARER\tx", "authorization:Bearer a;b"]
    assert values(spark, odd, T.redact) == ["COOKIE=Bearer [REDACTED], y", "token: [REDACTED]", "token = [REDACTED]", "authorization:Bearer [REDACTED];b"]


def test_identities(spark):
    import hashlib

    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    one = spark.range(1).select(
        ids.chunk_id(F.lit("d"), F.lit("v"), F.lit(3), F.lit("H"), F.lit("C")), ids.paragraph_ref(F.lit("c"), F.lit(" A  b"), F.lit(2)), ids.evidence_id(F.lit("web"), F.lit("title"), F.lit(None), F.lit(None), F.lit("http://u")),
        ids.evidence_id(F.lit("document"), F.lit(" "), F.lit(None), F.lit(None), F.lit(None)), ids.stale_delete_id(*[F.lit(x) for x in "abcdef"]), ids.bundle_ref(F.array(F.lit("x"), F.lit("y"))),
    ).first()
    assert list(one) == ["d:v:3:" + h("H\nC")[:16], "c:" + h("a b")[:12] + ":2", "web:" + h("web\x1f\x1f\x1f\x1fhttp://u")[:20], None, "stale-delete-" + h("\x1f".join("abcdef")), h("x\ny")[:16]]
