"""Identifiers as Column expressions: canonical forms, stable hashes, composed ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and invisible characters, which carry no meaning in an identifier.
BLANKS = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0xAD, 0x1680, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, *range(0x205F, 0x2065), 0x3000, 0xFEFF]))
#: Marks around and within a UUID.
MARKS = "{}()-"


def bare_id(col: Column) -> Column:
    """Identifier without white space or invisible characters, lower case; blank becomes null."""
    return F.nullif(F.translate(F.lower(col), BLANKS, ""), F.lit(""))


def uuid_bytes(col: Column) -> Column:
    """The 16 bytes of a UUID in any spelling (case, braces, URN, no hyphens), else null."""
    plain = F.translate(F.lower(col), BLANKS + MARKS, "")
    digits = F.when(F.length(plain) == 32, plain).when(plain.startswith("urn:uuid:"), F.substr(plain, F.lit(10))).when(plain.startswith("uuid:"), F.substr(plain, F.lit(6)))
    return F.when(F.length(digits) == 32, F.unhex(digits))


def canonical_message_id(col: Column) -> Column:
    """UUIDs as 8-4-4-4-12 in lower case; other identifiers bare; null stays null."""
    h = F.lower(F.hex(uuid_bytes(col)))
    dashed = F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return F.when(h.isNotNull(), dashed).otherwise(bare_id(col))


def stable_hex64(prefix: str, *parts: Column) -> Column:
    """``prefix_`` and the first 16 hex digits of SHA-256 over the parts joined by NUL."""
    fed: list[Column] = []
    for i, part in enumerate(parts):
        fed += ([F.char(F.lit(0))] if i else []) + [F.coalesce(part, F.lit(""))]
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat(*fed), 256), 1, 16))
