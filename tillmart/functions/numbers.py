"""Number parsing, safe ratios and rounding."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from tillmart.functions.text import EDGE_SPACE, keep_if
from tillmart.schemas import AMOUNT, EXACT

_DIGITS = r"\d(?:_?\d)*"
_LARGEST = "9" * (EXACT.precision - EXACT.scale)
# A numeral that the store holds as it is: most amounts, once $ and commas are gone.
_PLAIN = r"^-?\d{1,14}(?:\.\d{1,4})?\z"
_PLAIN_BRACKETS = r"^\(\d{1,14}(?:\.\d{1,4})?\)\z"
_NUMBER = rf"^\s*([+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?)\s*$"


def number_text(text: Column) -> Column:
    """The plain numeral in an amount such as ``$1,234.50`` or ``(12.00)``; empty when there is none.

    A chain in which each step uses the one before once: a step used twice would be
    computed twice, and a large expression escapes the JIT compiler.
    """
    bare = F.regexp_replace(text, rf"[$,]|{EDGE_SPACE}", "")
    signed = F.regexp_replace(bare, r"(?s)^\((.*)\)$", "-$1")
    return F.translate(F.regexp_extract(signed, _NUMBER, 1), "_", "")


def parse_number(text: Column) -> Column:
    """Double value of an amount; 0.0 for null, for junk and for anything not finite."""
    finite = keep_if(number_text(text).try_cast("double"), lambda value: F.abs(value) < float("inf"))
    return F.coalesce(finite, F.lit(0.0))


def parse_amount(text: Column) -> Column:
    """Exact decimal value of an amount; 0 for null and junk. One that the store cannot hold is an error."""
    beyond = F.raise_error(F.lit(f"an amount does not fit {AMOUNT.simpleString()}")).cast(AMOUNT)
    return _unless_plain(text, AMOUNT, lambda: F.coalesce(_parse_other(text).try_cast(AMOUNT), beyond))


def parse_exact(text: Column) -> Column:
    """An amount with all its decimals; 0 for null, junk and anything not finite.

    One with more integer digits than the type holds becomes the largest, which ``fits`` refuses.
    """
    return _unless_plain(text, EXACT, lambda: _parse_other(text))


def _unless_plain(text: Column, kind: DecimalType, other: Callable[[], Column]) -> Column:
    """A plain numeral is cast at once, which saves the steps that tell and rewrite the others."""

    def value(bare: Column) -> Column:
        inner = F.translate(bare, "()", "").try_cast(kind)
        return F.when(bare.rlike(_PLAIN), bare.try_cast(kind)).when(bare.rlike(_PLAIN_BRACKETS), -inner).otherwise(other())

    return F.transform(F.array(F.trim(F.translate(text, "$,", ""))), value)[0]


def _parse_other(text: Column) -> Column:
    def value(numeral: Column) -> Column:
        size = F.abs(numeral.try_cast("double"))
        largest = F.when((size >= 1) & (size < float("inf")), F.lit(_LARGEST).cast(EXACT))
        return F.coalesce(numeral.try_cast(EXACT), largest, F.lit(0).cast(EXACT))

    return F.transform(F.array(number_text(text)), value)[0]


def fits(amount: Column) -> Column:
    """Whether the store can hold the amount, rounded."""
    return amount.try_cast(AMOUNT).isNotNull()


def ratio(part: Column, whole: Column) -> Column:
    """Double quotient, null when the divisor is zero or null."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def round2(value: Column) -> Column:
    """Two decimals, half away from zero. Rounding a decimal keeps it independent of binary noise."""
    return F.round(value.cast("decimal(38,6)"), 2)


def percent(part: Column, whole: Column) -> Column:
    return round2(ratio(part, whole) * 100)


def round_tenth(value: Column) -> Column:
    """One decimal as Python rounds a double: by its binary value, exact ties to the even tenth.

    The fraction times twenty is exact in a double for the values a score can take, and
    an odd result marks a true tie.
    """
    whole = F.floor(value).cast("double")
    twentieths = (value - whole) * 20
    lower = F.floor(twentieths / 2)
    tie = (twentieths % 2) == 1
    even = lower + F.when((lower + whole * 10) % 2 == 0, 0).otherwise(1)
    tenths = F.when(tie, even).otherwise(F.floor((twentieths + 1) / 2))
    return (whole * 10 + tenths) / 10
