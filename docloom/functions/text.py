"""Text scalars as Column expressions; all run inside the JVM.

Blanks follow Python's idea of white space (Unicode and the separators 0x1c to 0x1f), unless a function says otherwise.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

BLANK = r"(?U)[\s\x1c-\x1f]"
#: The markers of the annotated Markdown.
BLOCK = r"(?s)(```.*?```|:::.*?:::)"
MARK = r"@@BLOCK_(\d+)@@"
ENTRY = r"\[HLINK:\s*(.*?)\]"
EXIT = r"\\?\[ANCHOR:\s*(.*?),\s*HLINK:\s*(.*?)\\?\]"
#: One token by the default counter: a Chinese character, a word or a mark.
TOKEN = r"[一-鿿]|[A-Za-z0-9_]+|[^ \t\r\nA-Za-z0-9_一-鿿]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def strip(c: Column | str) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(_col(c), rf"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def lifted_blocks(c: Column | str) -> tuple[Column, Column]:
    """(text with ``@@BLOCK_i@@`` for each fenced or ``:::`` block, the blocks from left to right)."""
    c = _col(c)
    parts = F.split(c, BLOCK, -1)
    text = F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit("@@BLOCK_"), (i - 1).cast("string"), F.lit("@@"), x))), "")
    return text, _all(c, BLOCK, 1)


def restored(text: Column | str, blocks: Column | str) -> Column:
    """Placeholders replaced by their blocks in one pass; a number without a block is an error."""
    text, blocks = _col(text), _col(blocks)
    number = _all(text, MARK, 1)
    put = lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.element_at(blocks, F.get(number, i - 1).cast("int") + 1), x))
    return F.array_join(F.transform(F.split(text, MARK, -1), put), "")


def entry_links(c: Column | str) -> tuple[Column, Column]:
    """(text without ``[HLINK: url]`` markers, stripped; the urls in order). Null gives '' and no urls."""
    c = F.coalesce(_col(c), F.lit(""))
    return strip(F.regexp_replace(c, ENTRY, "")), _all(c, ENTRY, 1)


def exit_links(c: Column | str) -> tuple[Column, Column]:
    """(text with link markers reduced to their anchor text and every blank run to one space; map of anchor text to urls).

    Line breaks go too, as in the stored texts. Urls of one anchor text are distinct, in order. Null gives '' and an empty map.
    """
    c = F.coalesce(_col(c), F.lit(""))
    name, url = F.transform(_all(c, EXIT, 1), strip), F.transform(_all(c, EXIT, 2), strip)
    pairs = F.arrays_zip(name.alias("n"), url.alias("u"))
    text = F.array_join(F.transform(F.split(c, EXIT, -1), lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit(" "), F.get(name, i - 1), F.lit(" "), x))), "")
    keys = F.array_distinct(name)
    values = F.transform(keys, lambda k: F.array_distinct(F.transform(F.filter(pairs, lambda p: p["n"] == k), lambda p: p["u"])))
    return strip(F.regexp_replace(text, rf"{BLANK}+", " ")), F.map_from_arrays(keys, values)


def merged_links(target: Column | str, source: Column | str) -> Column:
    """Union of two maps of url lists, key by key, distinct in order; null counts as empty."""
    none = F.create_map().cast("map<string,array<string>>")
    empty = F.array().cast("array<string>")
    return F.map_zip_with(F.coalesce(_col(target), none), F.coalesce(_col(source), none), lambda k, a, b: F.array_distinct(F.concat(F.coalesce(a, empty), F.coalesce(b, empty))))


def node_label(title: Column, text: Column, node_type: Column, level: Column, n: int = 10) -> Column:
    """Label of a node: title, head and tail of a text longer than three times ``n``, type and level."""
    flat = F.translate(F.regexp_replace(strip(text), "\n", " "), '"', "'")
    cut = F.when(F.length(flat) > 3 * n, F.concat(F.substring(flat, 1, n), F.lit("..."), F.right(flat, F.lit(n)))).otherwise(flat)
    return F.concat(title, F.lit("\n"), cut, F.lit("\n["), node_type, F.lit("][L"), level.cast("string"), F.lit("]"))


def token_count(c: Column | str) -> Column:
    """Number of tokens by the default counter; 0 for null."""
    return F.regexp_count(F.coalesce(_col(c), F.lit("")), F.lit(TOKEN))


@F.pandas_udf(StringType())
def _length_text(n: pd.Series) -> pd.Series:
    def one(x):
        return None if x != x else f"{int(x)} 字符" if x < 1_000 else f"{x / 1_000:.1f}千字符" if x < 1_000_000 else f"{x / 1_000_000:.2f}兆字符"

    return n.map(one)


def format_length(n: Column | str) -> Column:
    """A length in readable units; three bands, rounded as binary fractions are (Java's formatter differs on ties)."""
    return _length_text(_col(n).cast("double"))


def clean_url(c: Column | str) -> Column:
    """Stripped and without one full stop or comma at the end."""
    return F.regexp_replace(strip(c), r"[.,]\z", "")


def error_class(message: Column | str) -> Column:
    """Class of a crawl error: the first rule whose text occurs, else the message itself."""
    m = strip(message)
    out = F.when(m.contains("HTTPSConnectionPool"), "ConnectionError").when(m.contains("Read timed out"), "TimeoutError")
    return out.when(m.contains("404"), "HTTP 404").when(m.contains("SSLError"), "SSLError").otherwise(m)


def markdown_fixes(c: Column | str) -> Column:
    """The four rewrites after conversion: blanks behind fences, rules, table alignment and escaped line breaks."""
    out = F.regexp_replace(_col(c), r"```(?U)\s*\n", "```\n")
    out = F.regexp_replace(out, r"\n-{3,}\n", "\n\n")
    out = F.regexp_replace(out, r"\| :--- ", "| :--- | ")
    return F.replace(out, F.lit("&lt;br&gt;"), F.lit("<br>"))


def replace_lines(c: Column | str, pattern: str, substitute: str) -> Column:
    """Replace every match; ``^`` and ``$`` match at lines."""
    return F.regexp_replace(_col(c), f"(?m){pattern}", substitute)


def insert_before(c: Column | str, pattern: str, text: str) -> Column:
    """Insert before the first match of a multi-line pattern; unchanged without a match."""
    c = _col(c)
    at = F.regexp_instr(c, F.lit(f"(?m){pattern}"))
    return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.lit(text), F.substring(c, at, F.length(c)))).otherwise(c)


def occurrences(c: Column | str, literal: str) -> Column:
    """Array of (position from 0, text after, its length) for every non-overlapping occurrence of a literal."""
    c = _col(c)
    parts = F.split(c, r"\Q" + literal + r"\E", -1)
    ends = F.aggregate(F.slice(parts, 1, F.size(parts) - 1), F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1) + len(literal), F.lit(0)) + F.length(x))))
    after = lambda p: F.substring(c, p + 1 + len(literal), F.length(c))
    return F.transform(ends, lambda p: F.struct(p.alias("position"), F.regexp_replace(after(p), r"\n{3,}", "\n\n").alias("post_text"), F.length(after(p)).alias("post_length")))


def numbered_lines(items: Column | str) -> Column:
    """Numbered lines of an array, "None" for an empty or null one."""
    items = _col(items)
    return F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, "None").otherwise(F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n"))


def utf8(c: Column | str) -> Column:
    """Bytes as text; what isn't UTF-8 is read as the fallback code page."""
    c = _col(c)
    return F.coalesce(F.try_validate_utf8(c.cast("string")), F.decode(c, "ISO-8859-1"))


def over_limits(schema: StructType, limits: dict[str, int]) -> Column:
    """Names of the fields that exceed their limit: bytes of a text, items of a list; null exceeds none."""
    size = lambda c: F.size(c) if isinstance(schema[c].dataType, ArrayType) else F.octet_length(c)
    return F.array_compact(F.array(*(F.when(size(c) > n, c) for c, n in limits.items())))
