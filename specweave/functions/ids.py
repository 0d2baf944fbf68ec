"""Content-derived identities, equal to sha256 over the same bytes anywhere.

Four forms: ``discovery_id`` trims its parts and hashes the kind apart from them,
``joined_id`` hashes kind and parts in one list, ``regional_id`` leaves the kind out of
the hash, ``digest`` is the full sha256 of a text. A null part counts as an empty one;
concat_ws would drop it and so change the identity.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT, RECORD = chr(31), chr(30)
LENGTH = 20


def _parts(parts) -> list[Column]:
    return [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]


def _named(kind: str, hashed: Column) -> Column:
    return F.concat(F.lit(f"{kind}-"), F.substring(F.sha2(hashed.cast("binary"), 256), 1, LENGTH))


def discovery_id(kind: str, *parts) -> Column:
    """kind-hash of trimmed parts with / for backslashes."""
    clean = [F.replace(F.regexp_replace(p, r"^\s+|\s+$", ""), F.lit("\\"), F.lit("/")) for p in _parts(parts)]
    return _named(kind, F.concat(F.lit(kind + RECORD), F.concat_ws(UNIT, *clean)))


def joined_id(kind: str, *parts) -> Column:
    return _named(kind, F.concat_ws(UNIT, F.lit(kind), *_parts(parts)))


def regional_id(kind: str, *parts) -> Column:
    return _named(kind, F.concat_ws(UNIT, *_parts(parts)))


def rows_digest(text: Column) -> Column:
    """An aggregate: how many texts there are, and sums of pieces of their hashes; equal for equal texts in any order, and never a list of them."""
    h = F.sha2(text.cast("binary"), 256)
    part = lambda a: F.sum(F.conv(F.substring(h, a, 12), 16, 10).cast("decimal(20,0)")).cast("string")
    return F.concat_ws(":", F.count("*").cast("string"), *[F.coalesce(part(a), F.lit("0")) for a in (1, 13, 25, 37, 49)])


def digest(text) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
