"""SQL functions of the engine, for use in ``spark.sql``: plain SQL bodies, so Catalyst inlines and optimises them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from docloom.functions.ids import NAMESPACE_OID, NAMESPACE_URL
from docloom.functions.text import TOKEN

_UUID = "concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-', lower(hex(cast(conv(substr(h, 17, 1), 16, 10) as int) & 3 | 8)), substr(h, 18, 3), '-', substr(h, 21, 12))"


def _uuid5(space: str) -> str:
    digest = f"sha1(concat(unhex('{space}'), encode(title, 'UTF-8')))"
    return _UUID.replace("(h,", f"({digest},")


#: name -> (parameters, result, body, what it does)
FUNCTIONS = {
    "doc_node_id": ("title STRING", "STRING", _uuid5(NAMESPACE_URL), "Id of a static node from its full title."),
    "doc_event_id": ("title STRING", "STRING", _uuid5(NAMESPACE_OID), "Id of an event from its title."),
    "doc_token_count": ("txt STRING", "INT", f"regexp_count(coalesce(txt, ''), r'{TOKEN}')", "Tokens by the default counter."),
    "doc_cosine": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE",
        "CASE WHEN size(a) <> size(b) THEN NULL WHEN aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x) = 0 THEN 0D "
        "ELSE aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / sqrt(aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x)) END",
        "Cosine of two vectors, 0 if one is all zero."),
    "doc_clean_url": ("url STRING", "STRING", r"regexp_replace(btrim(url, ' \t\r\n'), '[.,]$', '')", "Without blanks around and one mark at the end."),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions for this session; returns their names."""
    for name, (parameters, result, body, _) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)


def describe() -> str:
    """One line for each function: name, parameters, what it does."""
    return "\n".join(f"- {name}({p}): {text}" for name, (p, _, _, text) in FUNCTIONS.items())
