"""Making untrusted text safe to print."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values the results depend on.
CONTROL = r"[\x00-\x1f\x7f-\x9f\u2028\u2029]"
SPACES = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
FIELD_LIMIT = 160  # of the service


def plain(text: Column) -> Column:
    """Control characters and white space runs become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, CONTROL, " "), SPACES, " "))


def clean_field(text: Column, limit: int | None = None) -> Column:
    """``plain`` with angle brackets turned round, cut after ``limit`` characters if one is given."""
    cleaned = F.translate(plain(text), "<>", "()")
    return cleaned if limit is None else F.substring(cleaned, 1, limit)


def code_span(text: Column, table_cell: bool = False) -> Column:
    """Markdown code span whose fence is longer than any backtick run inside."""
    body = plain(text)
    if table_cell:
        body = F.replace(body, F.lit("|"), F.lit("\\|"))
    runs = F.transform(F.regexp_extract_all(body, F.lit("(`+)"), F.lit(1)), F.length)
    fence = F.repeat(F.lit("`"), F.coalesce(F.array_max(runs), F.lit(0)) + 1)
    pad = F.when(body.startswith("`") | body.endswith("`"), " ").otherwise("")
    return F.concat(fence, pad, body, pad, fence)
