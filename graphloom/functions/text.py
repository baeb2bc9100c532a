"""Column expressions on names and type references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n\f\v "


def blank_trim(c: Column) -> Column:
    """c without surrounding blanks of any kind."""
    return F.btrim(c, F.lit(BLANKS))


def reference_text(c: Column) -> Column:
    """The type a reference names: text before the first `<`, trimmed, without a closing `?`, trimmed.

    Empty text and NULL give NULL.
    """
    head = blank_trim(F.substring_index(c, "<", 1))
    return F.nullif(blank_trim(F.regexp_replace(head, r"\?\z", "")), F.lit(""))


def function_name(c: Column) -> Column:
    """A function name without blanks around it, then enclosing backticks, then a closing `()`."""
    name = blank_trim(c)
    name = F.regexp_replace(name, r"(?s)\A`(.*)`\z", "$1")
    return F.regexp_replace(name, r"\(\)\z", "")
