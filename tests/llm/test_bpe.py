import random
import sys
from itertools import groupby

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from feedloom.llm.bpe import Codec, _pieces, _sha, digests, encode_long

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABETS = ["ab", "a ", "the ing of", "é ñü\n\t", "'sre !?", "0123 a", "日本語 の", "\U0001f600 x'", "   \x1c\x85", "aaaaaab"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("leaf", [2, 5, 16])
def test_unsplit_and_joined_texts_equal_the_library(library, leaf):
    codec, draw = Codec(PATH, leaf), random.Random(leaf)
    for _ in range(400):
        letters = draw.choice(ALPHABETS)
        text = "".join(draw.choice(letters) for _ in range(draw.randrange(1, 120)))
        want = library.encode(text, add_special_tokens=False).ids
        assert codec.ids(text) == want
        cut = draw.randrange(len(text) + 1)
        assert codec.join(codec.ids(text[:cut]), codec.ids(text[cut:])) == want
        assert codec.decode(want) == library.decode(want, skip_special_tokens=False)


def test_pre_tokens_equal_the_library_on_all_code_points(library):
    codec = Codec(PATH)
    for c in [*range(0x0, 0x3100), *range(0xD7FF, 0x110000, 997)]:
        if not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)}1{chr(c)}!{chr(c)}{chr(c)} b"
            assert codec.pre_tokens(text) == [text[a:b] for _, (a, b) in codec.split(text)], hex(c)
    assert sys.maxunicode == 0x10FFFF


def test_special_string(library):
    text = "a<|endoftext|>b <|endoftext|><|endof"
    assert Codec(PATH).ids(text) == library.encode(text, add_special_tokens=False).ids


def test_rows(spark, library):
    texts = [None, "", "plain text", "x" * 5000, "<|endoftext|>" * 40, " ".join(["word'll"] * 900), "\n" * 700, "plain text"]
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)] + [(None, "no id", "y", 1)], "doc_id long, text string, ids string, n_tokens int")
    want = sorted(
        ((i, t or "") for i, t, *_ in docs.collect()),
        key=lambda x: (x[0] is None, x[0]),
    )
    for piece in (37, 1000):
        got = digests(docs, PATH, leaf=8, piece=piece).collect()
        assert len(got) == len(want)
        for (doc, text), row in zip(want, sorted(got, key=lambda r: (r.doc_id is None, r.doc_id))):
            ids = library.encode(text, add_special_tokens=False).ids
            decoded = library.decode(ids, skip_special_tokens=False)
            assert tuple(row) == (doc, len(ids), _sha(",".join(map(str, ids)).encode()), _sha(decoded.encode()))
    assert digests(docs.limit(0), PATH).count() == 0
    assert encode_long(docs.limit(0), PATH).count() == 0


WHITE = [c for c in map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])]


def test_pieces_cut_anywhere_equal_the_library(library):
    """Special strings behind and before every kind of white space, cut at every place."""
    codec, draw, mark = Codec(PATH), random.Random(8), "<|endoftext|>"
    for _ in range(600):
        gap = "".join(draw.choice(WHITE if draw.random() < 0.7 else [" ", "x", "\n", "1", "."]) for _ in range(draw.randrange(5)))
        text = draw.choice(["x ", "x", "", "word's "]) + gap + draw.choice([mark, mark[:-1], mark + mark, mark[3:]]) + gap[::-1] + draw.choice(["y", " y z", "", mark, "\u2028"])
        want = library.encode(text, add_special_tokens=False).ids
        for piece in (1, 2, 3, 5, 8, 13):
            ids = []
            for _number, stretch in groupby(_pieces(text, codec.marks, piece), key=lambda p: p[0]):
                level = [codec.ids(t) for _, t in stretch]
                while len(level) > 1:
                    joined = [codec.join(a, b) for a, b in zip(level[::2], level[1::2])]
                    level = joined + level[len(joined) * 2 :]
                ids += level[0]
            assert ids == want, (text, piece)


def test_long_texts_with_special_strings_at_borders(spark, library):
    mark = "<|endoftext|>"
    texts = ["x \x85" + " " * k + mark + " tail of the text" for k in range(14)] + ["a" * 30 + "\u2028" + mark * 3, mark * 4, "a\u2028" + mark[:-1]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for piece in (7, 16):
        got = {r.doc_id: r.ids for r in encode_long(docs, PATH, piece=piece).collect()}
        assert got == {i: library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
