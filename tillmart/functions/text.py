"""Text expressions."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillmart.schemas import NULL_TOKENS

# Python's str.strip also removes the control separators and the Unicode spaces.
EDGE_SPACE = r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$"


def keep_if(value: Column, test: Callable[[Column], Column]) -> Column:
    """The value if it passes the test, else null; the value is computed once.

    A long parsing expression that is named twice is run twice, and in generated code it
    grows past what the JIT compiles. Inside a lambda it is neither.
    """
    return F.get(F.filter(F.array(value), test), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGE_SPACE, "")


def null_if_token(text: Column) -> Column:
    """Null for the exact spellings of a missing value; ``' NA'`` stays text."""
    return F.when(~text.isin(*NULL_TOKENS), text)


def or_default(text: Column, default: str) -> Column:
    """The default for null and for the empty text; blanks made of spaces stay."""
    return F.when(text.isNull() | (text == ""), F.lit(default)).otherwise(text)


def short_label(text: Column, width: int) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)
