"""Text expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Outer white space: Unicode's White_Space and the four ASCII separators.
OUTER_SPACE = r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$"


def strip(c: Column) -> Column:
    """c without outer white space (Unicode's, not only the blank)."""
    return F.regexp_replace(c, OUTER_SPACE, "")


def key_text(c: Column) -> Column:
    """A key written in any letter case and with outer white space, in one form."""
    return F.lower(strip(c))
