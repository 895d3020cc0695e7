"""Text expressions: keys, plates, images, error codes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_IMAGE_CHARS = 512_000
# White space and line ends that are trimmed.
WHITE_SPACE = r"\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c) -> Column:
    return F.nullif(_col(c), F.lit(""))


def trimmed(c) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(_col(c), rf"\A[{WHITE_SPACE}]+|[{WHITE_SPACE}]+\z", "")


def person_key(person_id, person_name) -> Column:
    """P10: `id:<id>`, else `name:<lower-cased name with runs of blanks as _>`."""
    slug = F.regexp_replace(F.lower(_col(person_name)), r"(?U)\s+", "_")
    return F.when(
        F.length(_col(person_id)) > 0, F.concat(F.lit("id:"), _col(person_id))
    ).otherwise(F.concat(F.lit("name:"), slug))


def plate_key(plate_text) -> Column:
    """Letters and digits in upper case, or `plate:unknown`."""
    kept = F.upper(F.regexp_replace(_col(plate_text), "[^a-zA-Z0-9]", ""))
    return F.concat(F.lit("plate:"), F.coalesce(blank_to_null(kept), F.lit("unknown")))


def bare_plate(key) -> Column:
    """A plate key without its prefix."""
    return F.regexp_replace(_col(key), r"\Aplate:", "")


def plate_display(plate_text, key) -> Column:
    """Trimmed text, else the bare key, else `unknown`."""
    return F.coalesce(
        blank_to_null(trimmed(plate_text)), blank_to_null(bare_plate(key)), F.lit("unknown")
    )


def jpeg_base64(image) -> Column:
    """Bare base64 of a JPEG, or null when it is anything else or too long."""
    bare = F.regexp_replace(_col(image), r"(?i)\Adata:image/jpeg;base64,", "")
    ok = bare.rlike(r"\A[A-Za-z0-9+/]+={0,2}\z") & (F.length(bare) <= MAX_IMAGE_CHARS)
    return F.when(ok, bare)


def same_text(a, b) -> Column:
    """equality without regard to case."""
    return F.lower(_col(a)) == F.lower(b if isinstance(b, Column) else F.lit(b))


# Error code by message pattern, first match wins.
ERROR_CODES = [
    ("FOREIGN KEY|SQLITE_CONSTRAINT_FOREIGNKEY", "D1_FK_CONSTRAINT"),
    ("UNIQUE|SQLITE_CONSTRAINT_UNIQUE", "D1_UNIQUE_CONSTRAINT"),
    ("NOT NULL|SQLITE_CONSTRAINT_NOTNULL", "D1_NOTNULL_CONSTRAINT"),
    ("CHECK|SQLITE_CONSTRAINT_CHECK", "D1_CHECK_CONSTRAINT"),
    ("SQLITE_CONSTRAINT", "D1_CONSTRAINT"),
    ("D1_ERROR", "D1_ERROR"),
]
OTHER_ERROR = "D1_FAILURE"


def error_code_of(message: str) -> str:
    """X13 for one message, without Spark: what an error handler can still do."""
    return next((code for pattern, code in ERROR_CODES if re.search(pattern, message, re.I)), OTHER_ERROR)


def error_code(message) -> Column:
    """Stable code of a store error message."""
    code = F.lit(OTHER_ERROR)
    for pattern, name in reversed(ERROR_CODES):
        code = F.when(_col(message).rlike(f"(?i){pattern}"), F.lit(name)).otherwise(code)
    return code
