import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from feedloom.llm import alignment
from feedloom.llm.alignment import CUT, Aligner, aligned, spilled
from feedloom.llm.bpe import _byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """(A ids, B ids, groups, links) of a whole text, byte offset by byte offset."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=B)
    letters = _byte_letters()

    def align(text):
        if not text:
            return [], [], "", []
        raw = (" " + text).encode()
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        x_raw = [bytes(letters[c] for c in a.id_to_token(i)) for i in x]
        y_raw = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if b"".join(x_raw) != raw or b"".join(y_raw) != raw:
            return [], [], "", []
        ends = [{}, {}]
        for side, parts in enumerate((x_raw, y_raw)):
            at = 0
            for i, part in enumerate(parts):
                at += len(part)
                ends[side][at] = i
        groups, links, last_x, last_y = [], [], 0, 0
        for at in sorted(ends[0].keys() & ends[1].keys()):
            i, j = ends[0][at], ends[1][at]
            groups.append(",".join(map(str, x[last_x : i + 1])) + "|" + ",".join(map(str, y[last_y : j + 1])))
            links.append((x[i], y[j]))
            last_x, last_y = i + 1, j + 1
        return x, y, ";".join(groups), links

    return align


ALPHABETS = ["ab ", "the ing of  ", "é ñü\n\t ", "'sre !? ", "0123 a ", "日本語 の ", "\U0001f600 x' ", "   \x1c\x85\xa0a", "▁ a", "<|endoftext|> </s> <0x41> ", "  \x00b"]


@pytest.mark.parametrize("part", [1, 7, 1 << 16])
def test_alignment_equals_a_plain_version(plain, monkeypatch, part):
    monkeypatch.setattr(alignment, "PART", part)
    aligner, draw, texts = Aligner(A, B), random.Random(part), []
    for n in range(1200):
        letters = draw.choice(ALPHABETS) + (draw.choice(ALPHABETS) if n % 2 else "")
        texts.append("".join(draw.choice(letters) for _ in range(draw.randrange(0, 60))))
    texts += ["", " ", "▁", " ▁", "\U0010ffff a", "a" * 500, " " * 12000 + "x"]
    for at in range(0, len(texts), 40):
        some = texts[at : at + 40]
        found, want = aligner.align(some), [plain(t) for t in some]
        for k, (x, y, groups, links) in enumerate(want):
            assert (found.n_a[k], found.n_b[k], found.n_links[k], found.groups[k]) == (len(x), len(y), len(links), groups), some[k]
        assert [(v & 0xFFFFFFFF, v >> 32) for v in found.links.tolist()] == [link for w in want for link in w[3]]
    assert aligner.align([]).groups == [] and aligner.align(["", "▁"]).n_a.tolist() == [0, 0]


def test_no_piece_holds_a_blank_behind_another_character():
    b = SentencePieceProcessor(model_file=B)
    assert not [p for p in map(b.id_to_piece, range(b.vocab_size())) if "▁" in p.lstrip("▁")]
    assert CUT.split("a b  c \n d") == ["a", "b  c \n d"]


@pytest.mark.parametrize("chunk, radices, fan_in", [(1 << 22, 32, 64), (300, 3, 2), (1, 7, 3)])
def test_documents_and_pairs_equal_a_plain_version(spark, plain, chunk, radices, fan_in):
    draw = random.Random(radices)
    words = ["the", "thesis", "ing", "of,", "Über", "x1", "日本", "a▁b", "two\n", "<|endoftext|>", "lynt"]
    texts = [" ".join(draw.choices(words, [9, 3, 3, 3, 2, 2, 1, 0.1, 1, 1, 2], k=draw.randrange(0, 80))) for _ in range(60)]
    texts += [None, "", " ", "a▁b", "the " * 3000, texts[1], texts[1]]
    docs = [*zip([*range(len(texts) - 3), None, 4, 4], texts)]
    found = {t: plain(t) for _, t in docs}
    count, best = Counter(link for _, t in docs for link in found[t][3]), defaultdict(int)
    for (a, b), n in count.items():
        best[b] = max(best[b], n)
    want = []
    for doc, text in docs:
        x, y, groups, links = found[text]
        tops = sum(count[link] == best[link[1]] for link in links)
        want.append((doc, len(x), len(y), len(links), len(links), groups, tops, sum(count[link] for link in links)))
    frame = spark.createDataFrame([(i, t, 1, "x", 2.0) for i, t in docs], "doc_id long, text string, chunk int, groups string, n double")
    got, pairs = aligned(frame.repartition(4), A, B, chunk_size=chunk, radices=radices, fan_in=fan_in)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(want, key=str)
    assert {((r["a_id"], r["b_id"]), r["n"], r["best"]) for r in pairs.collect()} == {(p, n, n == best[p[1]]) for p, n in count.items()}


def test_empty_table_and_runs(spark):
    frame = spark.createDataFrame([(1, "the thesis of the thing")], "doc_id long, text string")
    got, pairs = aligned(frame.limit(0), A, B)
    assert got.count() == 0 and pairs.count() == 0
    rows = spilled(frame, A, B, radices=4).collect()
    assert [r["doc_id"] for r in rows if r["doc"] is not None] == [1]
    assert all(0 <= r["radix"] < 4 for r in rows if r["doc"] is None)
