"""Splitting oversized texts at natural boundaries, with overlap.

A hierarchy of separators (section, paragraph, sentence, word, character) gives every place between two tokens a level.
Pieces are packed greedily: each takes as many tokens as the limit allows, after the overlap it repeats, and ends at the
best level found in its last ``window`` share; only if there is none of a level does the next one count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: A fixed value: what one token of the node table is.
TOKEN = re.compile(r"[一-鿿]|[A-Za-z0-9_]+|[^ \t\r\nA-Za-z0-9_一-鿿]")
#: Breaks by level, best first; a break is the place at the end of the match.
SECTION = re.compile(r"\n(?=#{1,6} )|(?<=\s)(?=#{1,6} \S)|\n-{3,}\s*\n|(?<=\s)(?=:::)|```(?=\s)")
PARAGRAPH = re.compile(r"\r?\n[ \t]*\r?\n|\r\n|\n")
SENTENCE = re.compile(r"[。！？；…]+[”’」』）]*|[.!?]+[\"')\]]*(?=\s)|<br\s*/?>|\|(?=\s)")
LEVELS = ("section", "paragraph", "sentence", "word", "character")


def token_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every token."""
    spans = [m.span() for m in TOKEN.finditer(text)]
    both = np.array(spans, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def break_levels(text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Level (0 section .. 4 character) of the place before each token; the place before the first is 0."""
    level = np.full(len(starts), 4, np.int8)
    level[1:][starts[1:] > ends[:-1]] = 3  # blanks between
    cjk = np.fromiter(("一" <= text[i] <= "鿿" for i in starts), bool, len(starts))
    level[1:][(level[1:] == 4) & (cjk[1:] | cjk[:-1])] = 3  # a single Chinese character is a word here
    for rank, pattern in ((2, SENTENCE), (1, PARAGRAPH), (0, SECTION)):
        at = np.fromiter((m.end() for m in pattern.finditer(text)), np.int64)
        hit = np.searchsorted(starts, at, "left")
        hit = hit[hit < len(starts)]
        level[hit] = np.minimum(level[hit], rank)
    level[:1] = 0
    return level


def cut_places(level: np.ndarray, limit: int, overlap: int, window: float = 0.5) -> list[tuple[int, int]]:
    """(first token that is new, end) of each piece; a piece starts ``overlap`` tokens before its first new token.

    The end lies in the last ``window`` share of the room: the latest place of the best level there.
    """
    n, begin, out = len(level), 0, []
    while begin < n:
        room = limit - (overlap if begin else 0)
        if n - begin <= room:
            out.append((begin, n))
            break
        # the first piece has at least the tokens that the second repeats
        low, high = begin + max(1, int(room * (1 - window)), 0 if begin else overlap), begin + room
        part = level[low : high + 1]
        end = low + len(part) - 1 - int(np.argmin(part[::-1]))
        out.append((begin, end))
        begin = end
    return out


def split_text(text: str, limit: int = 1024, overlap: int = 64) -> list[tuple[int, int, int, int, str]]:
    """(char_start, char_end, n_tokens, n_overlap, level of the cut before) of each piece; one piece if it fits.

    Blanks before a piece's first token belong to the piece before, so the new parts join to the whole text.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    starts, ends = token_spans(text)
    if len(starts) <= limit:
        return [(0, len(text), len(starts), 0, "")]
    level, out = break_levels(text, starts, ends), []
    for begin, end in cut_places(level, limit, overlap):
        first = max(0, begin - overlap) if begin else 0
        a = 0 if not begin else int(starts[first])
        b = len(text) if end == len(starts) else int(starts[end])
        out.append((a, b, end - first, begin - first, LEVELS[level[begin]] if begin else ""))
    return out


SCHEMA = "node string, piece_no int, n_pieces int, char_start int, char_end int, n_tokens int, n_overlap int, cut string, piece string"


def split_oversized(nodes: DataFrame, limit: int = 1024, overlap: int = 64) -> DataFrame:
    """The pieces of all nodes of ``nodes(node, text)`` whose text has more than ``limit`` tokens; other rows give none.

    Null and empty texts have no tokens. A text of one character kind without any pause is cut between tokens. ``cut`` is
    the level of the boundary before the piece. ``token_count`` is not looked at. No shuffle here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist()):
                got = split_text(text, limit, overlap)
                if len(got) > 1:
                    rows += [(node, i, len(got), a, b, n, o, cut, text[a:b]) for i, (a, b, n, o, cut) in enumerate(got, 1)]
            cols = list(zip(*rows)) or [[]] * 9
            kinds = [pa.string(), *[pa.int32()] * 6, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

    # a token has at least one character, so a short text can't be oversized
    return nodes.select("node", "text").filter(F.length("text") > limit).mapInArrow(run, SCHEMA)
