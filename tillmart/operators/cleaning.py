"""From an upload with any header and untidy text to the canonical flat rows."""

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmart.functions.dates import parse_date
from tillmart.functions.numbers import parse_amount, parse_exact
from tillmart.functions.text import or_default, strip
from tillmart.schemas import AMOUNT, CANONICAL_COLUMNS, COLUMN_ALIASES, EXACT, GENERATED_IDS, NUMERIC_DEFAULTS, TEXT_DEFAULTS

# The days that stand for an unreadable date.
UPLOAD_DATE = dt.date(2024, 1, 1)
BULK_ORDER_DATE = dt.date(2014, 1, 1)
BULK_SHIPPING_DAYS = 4

# Columns of our own that pass through cleaning untouched.
ROW_COLUMNS = ("batch_key", "row_no")

UNMAPPED_SHOWN = 5


class UnknownLayout(ValueError):
    """No column of the upload is recognised."""


@dataclass(frozen=True)
class ColumnMapping:
    """``sources``: canonical name to position in the header; ``unmapped``: other header names in input order."""

    header: list[str]
    sources: dict[str, int]
    unmapped: list[str]

    def source_names(self) -> dict[str, str]:
        return {name: self.header[position] for name, position in self.sources.items()}


def map_columns(header: list[str]) -> ColumnMapping:
    """Match header names, trimmed and in lower case, with the alias lists.

    Of a name that is repeated as it is written the first counts; of names that differ in
    case only, the last. The others are unmapped.
    """
    written: dict[str, int] = {}
    for position, name in enumerate(header):
        written.setdefault(name, position)
    found = {name.strip().lower(): position for name, position in written.items()}
    sources = {}
    for canonical, aliases in COLUMN_ALIASES.items():
        hit = next((alias for alias in aliases if alias in found), None)
        if hit is not None:
            sources[canonical] = found[hit]
    used = set(sources.values())
    again = [position for position, name in enumerate(header) if written[name] != position]
    unmapped = [header[position] for position in sorted([*found.values(), *again]) if position not in used]
    return ColumnMapping(list(header), sources, unmapped)


def select_canonical(upload: DataFrame) -> tuple[DataFrame, ColumnMapping]:
    """Recognised columns as text under their canonical names, plus our row columns."""
    own = [name for name in ROW_COLUMNS if name in upload.columns]
    header = [name for name in upload.columns if name not in ROW_COLUMNS and not name.startswith("_")]
    mapping = map_columns(header)
    if not mapping.sources:
        raise UnknownLayout("no column of the upload is recognised: " + ", ".join(header))
    # Address columns by position: header names may differ in case only.
    places = iter(range(len(header)))
    by_place = upload.toDF(*[f"c{next(places)}" if name in header else name for name in upload.columns])
    chosen = [F.col(f"c{position}").cast("string").alias(name) for name, position in mapping.sources.items()]
    return by_place.select(*chosen, *own), mapping


def clean_date_columns(rows: DataFrame, as_of: dt.datetime) -> tuple[DataFrame, list[str]]:
    """Unreadable dates become 2024-01-01; an absent order date the submission day, an absent ship date the order date."""
    notes = []
    if "order_date" in rows.columns:
        rows = rows.withColumn("order_date", F.coalesce(parse_date(F.col("order_date")), F.lit(UPLOAD_DATE)))
    else:
        rows = rows.withColumn("order_date", F.lit(as_of.date()))
        notes.append("order_date is missing: the submission day is used")
    if "ship_date" in rows.columns:
        rows = rows.withColumn("ship_date", F.coalesce(parse_date(F.col("ship_date")), F.lit(UPLOAD_DATE)))
    else:
        rows = rows.withColumn("ship_date", F.col("order_date"))
        notes.append("ship_date is missing: the order date is used")
    return rows, notes


def bulk_dates(rows: DataFrame) -> DataFrame:
    """Bulk files: an unreadable order date is 2014-01-01, an unreadable ship date four days after the order."""
    order_date = F.coalesce(parse_date(F.col("order_date")), F.lit(BULK_ORDER_DATE))
    rows = rows.withColumn("order_date", order_date)
    late = F.date_add("order_date", BULK_SHIPPING_DAYS)
    return rows.withColumn("ship_date", F.coalesce(parse_date(F.col("ship_date")), late))


def clean_amount_columns(rows: DataFrame, exact: bool = False) -> tuple[DataFrame, list[str]]:
    """Exact decimals; an absent column becomes 0, an absent quantity 1.

    With ``exact`` amounts keep all their decimals and none is refused yet.
    """
    parse, kind = (parse_exact, EXACT) if exact else (parse_amount, AMOUNT)
    notes = []
    for name, default in NUMERIC_DEFAULTS.items():
        if name in rows.columns:
            rows = rows.withColumn(name, parse(F.col(name)))
        else:
            rows = rows.withColumn(name, F.lit(default).cast(kind))
            if name in ("sales", "profit"):
                notes.append(f"{name} is missing: 0 is used")
    return rows, notes


def fill_text(rows: DataFrame) -> DataFrame:
    for name, default in TEXT_DEFAULTS.items():
        filled = or_default(F.col(name), default) if name in rows.columns else F.lit(default)
        rows = rows.withColumn(name, filled)
    return rows


def fill_ids(rows: DataFrame, number: str = "row_no", scope: Column | None = None) -> DataFrame:
    """Blank customer and product ids become CUST-<n> and PROD-<n> by row number.

    Numbers restart in each batch, so blank ids of different batches coincide; pass a
    ``scope`` text to put in front of the number where that is not wanted.
    """
    row_text = F.col(number).cast("string") if scope is None else F.concat_ws("-", scope, F.col(number).cast("string"))
    for name, prefix in GENERATED_IDS.items():
        generated = F.concat(F.lit(prefix), row_text)
        if name in rows.columns:
            blank = F.col(name).isNull() | (strip(F.col(name)) == "")
            generated = F.when(blank, generated).otherwise(F.col(name))
        rows = rows.withColumn(name, generated)
    return rows


def fill_order_ids(rows: DataFrame, as_of: dt.datetime, number: str = "row_no") -> tuple[DataFrame, list[str]]:
    """An absent order id column becomes ORD-<submission minute>-<n>; a null in a present one stays."""
    if "order_id" in rows.columns:
        return rows, []
    prefix = as_of.strftime("ORD-%Y%m%d%H%M-")
    rows = rows.withColumn("order_id", F.concat(F.lit(prefix), F.col(number).cast("string")))
    return rows, ["order_id is missing: ids are generated"]


@dataclass(frozen=True)
class CleanBatch:
    rows: DataFrame
    mapping: ColumnMapping
    warnings: list[str] = field(default_factory=list)


def clean_batch(upload: DataFrame, as_of: dt.datetime, exact: bool = False) -> CleanBatch:
    """All cleaning steps. The upload carries ``row_no``, its rows numbered from 1 in each batch.

    With ``exact`` amounts are as written, so that rules judge them before they are rounded.
    """
    rows, mapping = select_canonical(upload)
    rows, date_notes = clean_date_columns(rows, as_of)
    rows, amount_notes = clean_amount_columns(rows, exact)
    rows = fill_ids(fill_text(rows))
    rows, id_notes = fill_order_ids(rows, as_of)
    warnings = date_notes + amount_notes + id_notes
    if mapping.unmapped:
        warnings.append("columns not recognised: " + ", ".join(mapping.unmapped[:UNMAPPED_SHOWN]))
    own = [name for name in ROW_COLUMNS if name in rows.columns]
    return CleanBatch(rows.select(*CANONICAL_COLUMNS, *own), mapping, warnings)


def clean_bulk(upload: DataFrame) -> DataFrame:
    """Cleaning of a bulk file: dates and amounts as above, a blank postal code N/A, other text as it is."""
    rows, mapping = select_canonical(upload)
    absent = [name for name in CANONICAL_COLUMNS if name not in mapping.sources]
    if absent:
        raise UnknownLayout("the bulk file lacks " + ", ".join(absent))
    rows, _ = clean_amount_columns(bulk_dates(rows))
    return rows.withColumn("postal_code", F.coalesce("postal_code", F.lit(TEXT_DEFAULTS["postal_code"])))
