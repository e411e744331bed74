"""Node identity: one id per UUID, however written, else derived from the title."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The two RFC 4122 name spaces that node ids are derived in.
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"
NAMESPACE_OID = "6ba7b8129dad11d180b400c04fd430c8"

STATIC_PARTITION = "static_knowledge"
DYNAMIC_PARTITION = "dynamic_events"

_BLANKS = " \t\r\n\x0b\x0c 　﻿"
_PLAIN = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\\z"


def _dashed(h: Column) -> Column:
    first, *rest = (F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return F.concat(first, *(x for part in rest for x in (F.lit("-"), part)))


def uuid5(title: Column, namespace: str | Column) -> Column:
    """RFC 4122 version 5 id of ``title`` in a name space (32 hex digits), as a JVM expression; null for null."""
    space = F.unhex(F.lit(namespace) if isinstance(namespace, str) else namespace)
    h = F.sha1(F.concat(space, F.encode(title, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return _dashed(F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15)))


def canonical_id(raw: Column) -> Column:
    """The plain form (36 characters, lower case, hyphens) of an id in any UUID notation.

    Blanks around, braces, ``urn:uuid:``, missing hyphens and upper case make no difference. Null, '' and blanks give
    null ("no reference"). A text that is no UUID is kept, trimmed and in lower case, as an id of its own.
    """
    text = F.lower(F.btrim(raw, F.lit(_BLANKS)))
    digits = F.translate(F.regexp_replace(text, "^(urn:)?(uuid:)?", ""), "{}-", "")
    odd = F.when(digits.rlike("^[0-9a-f]{32}\\z"), _dashed(digits)).when(text != "", text)
    return F.when(raw.rlike(_PLAIN), raw).otherwise(odd)


def node_id(pk: Column, title: Column, partition: Column) -> Column:
    """Id of a delivered row: its ``pk``, or by the id rule from ``title`` where pk is absent; null if both are."""
    space = F.when(partition == DYNAMIC_PARTITION, F.lit(NAMESPACE_OID)).otherwise(F.lit(NAMESPACE_URL))
    return F.coalesce(canonical_id(pk), uuid5(title, space))


def is_version5(raw: Column) -> Column:
    """True if the text denotes a UUID of version 5, in any notation; null and other texts give false."""
    return F.coalesce(canonical_id(raw).rlike("^[0-9a-f]{8}-[0-9a-f]{4}-5[0-9a-f]{3}-[0-9a-f]{4}-[0-9a-f]{12}\\z"), F.lit(False))
