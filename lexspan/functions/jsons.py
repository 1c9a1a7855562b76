"""JSON texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_json(c: Column) -> Column:
    """True for a text that is one JSON value and nothing else, NULL for NULL.

    The parser stops behind the first value, so the text is tried as a member of an object and as an
    element of an array: what follows a value breaks at least one of them.
    """
    inside = [F.try_parse_json(F.concat(F.lit(a), c, F.lit(b))) for a, b in (('{"v":', "}"), ("[", "]"))]
    return F.when(c.isNotNull(), F.try_parse_json(c).isNotNull() & inside[0].isNotNull() & inside[1].isNotNull())
