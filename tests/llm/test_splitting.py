import pytest
from hypothesis import given, settings, strategies as st

from docloom.llm import splitting as S

CHUNK = st.sampled_from(["word ", "字", "。", ".", "\n", "\n\n", "## H\n", "x1_y", "　", "!", "  ", "é", "```\n"])


@settings(max_examples=150, deadline=None)
@given(st.lists(CHUNK, max_size=200), st.integers(2, 20), st.integers(0, 5))
def test_pieces(parts, limit, overlap):
    overlap = min(overlap, limit - 1)
    text = "".join(parts)
    got = S.split_text(text, limit, overlap)
    tokens = S.TOKEN.findall(text)
    if len(tokens) <= limit:
        assert [g[4] for g in got] == [""] and got[0][2] == len(tokens)
        return
    seen = []
    for a, b, n, o, _ in got:
        own = S.TOKEN.findall(text[a:b])
        assert len(own) == n <= limit
        assert own[:o] == seen[len(seen) - o :] and o == (overlap if seen else 0)
        seen += own[o:]
    assert seen == tokens


def test_natural_places_come_first():
    text = "aa bb cc. dd ee ff gg\n\nhh ii jj kk ll mm nn"
    got = S.split_text(text, 10, 2)
    assert got[0][4] == "" and got[1][4] == "paragraph" and text[got[0][0] : got[0][1]].endswith("gg\n\n")
    assert S.split_text("abc " * 30, 10, 0)[1][4] == "word"
    assert S.split_text("....." * 10, 8, 1)[1][4] == "character"
    with pytest.raises(ValueError):
        S.split_text("x", 4, 4)


def test_query(spark):
    df = spark.createDataFrame([("a", "w " * 3000, 1), ("b", "short", 2), ("c", None, 3), ("d", "", 4), ("e", "x" * 5000, 5), ("f", "字" * 1025, 6)], "node string, text string, piece_no long")
    rows = S.split_oversized(df).collect()
    assert {r.node for r in rows} == {"a", "f"} and max(r.n_tokens for r in rows) <= 1024
    assert [r.n_overlap for r in sorted(rows, key=lambda r: r.piece_no) if r.node == "a"][1:] == [64] * (sum(r.node == "a" for r in rows) - 1)
    assert S.split_oversized(df.limit(0)).count() == 0
