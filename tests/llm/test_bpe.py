import pytest
import regex
from hypothesis import given, settings, strategies as st

from docloom.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    t = tokenizers.Tokenizer.from_file(bpe.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return bpe.ByteBPE(), t


def ours(b, texts):
    n, ids = b.encode(texts)
    out, at = [], 0
    for k in n:
        out.append(ids[at : at + k].tolist())
        at += k
    return out


HARD = [None, "", " ", "\n\n \t", "<|endoftext|>x<|startoftext|>", "don't we'll I'M 'S", "汉字" * 400, "混合 mixed 文本 and more", "😀👩‍👩‍👧é́", "a" * 5000, "x1y2" * 700, "\x00\x1c\x85 　", "\r\n\r\n", "Ａ１", "https://a.b/c?d=e#f" * 40, "the " * 3000, "ÄÖÜ straße " * 20]


def test_same_as_the_library(both):
    b, t = both
    assert ours(b, HARD) == [t.encode(x or "", add_special_tokens=False).ids for x in HARD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=60), max_size=8))
def test_any_text(both, texts):
    b, t = both
    assert ours(b, texts) == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_round_trip_and_counts(both):
    b, t = both
    texts = [x for x in HARD if x]
    assert [t.decode(x, skip_special_tokens=False) for x in ours(b, texts)] == texts
    assert b.count(HARD).tolist() == [len(x) for x in ours(b, HARD)]


def test_long_pieces_go_both_ways(both, monkeypatch):
    b, _ = both
    text = ["thequickbrownfox" * 40]
    want = ours(bpe.ByteBPE(), text)
    monkeypatch.setattr(bpe, "LONG_PIECE", 8)
    assert ours(bpe.ByteBPE(), text) == want


def test_pieces_around_the_length_of_the_matrices(both):
    """Words of 510 to 514 bytes, merged by matrix or by heap: as the library does, alone and side by side."""
    import random

    b, t = both
    rng = random.Random(9)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(bpe.LONG_PIECE + d)) for d in (-2, -1, 0, 1, 2) for _ in range(4)]
    texts = [*words, " ".join(words), "é" * 256, "é" * 257]
    assert ours(b, texts) == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_query(spark):
    df = spark.createDataFrame([(1, "hello world", "k"), (2, None, "x"), (3, "", None), (4, "hello world", "k")], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in bpe.encode_column(df, "doc_id", "text").collect()}
    assert got == {1: [31373, 995], 2: [], 3: [], 4: [31373, 995]}
    assert bpe.encode_column(df.limit(0), "doc_id", "text").count() == 0
    assert [r.n_tokens for r in bpe.count_tokens(df, "text", ["doc_id"]).orderBy("doc_id").collect()] == [2, 0, 0, 2]
