"""Keys, normalisers and predicates of sample metadata (all native column expressions unless said otherwise)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that mean "no identifier", "control" (two families), DMSO, and DMSO's compound id.
BLANK_WORDS = ["", "nan", "none", "<na>"]
CONTROL_WORDS = {"overlap": ["true", "1", "yes"], "replicate": ["1", "true", "t", "yes", "y", "dmso", "control"]}
DMSO_WORDS = ["dmso", "dimethyl sulfoxide"]
DMSO_CID = "679"

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def clean_text(c: Column) -> Column:
    """Null becomes the empty text; spaces, tabs and line ends are trimmed."""
    return F.btrim(F.coalesce(c.cast("string"), F.lit("")), F.lit(" \t\r\n"))


def blanked(c: Column) -> Column:
    """clean_text(), with words that stand for no value made empty."""
    t = clean_text(c)
    return F.when(F.lower(t).isin(BLANK_WORDS), F.lit("")).otherwise(t)


def first_non_empty(*cs: Column) -> Column:
    """The first text that is neither blank nor `nan`, else empty."""
    return F.coalesce(*[F.when((clean_text(c) != "") & (F.lower(clean_text(c)) != "nan"), clean_text(c)) for c in cs], F.lit(""))


def number(c: Column) -> Column:
    """A number from text, null if it isn't one or isn't finite."""
    t = clean_text(c)
    x = F.when(t.rlike(_NUMBER), t.try_cast("double"))
    return F.when(finite(x), x)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def finite_or_null(c: Column) -> Column:
    return F.when(finite(c), c)


@F.pandas_udf(StringType())
def significant(x: pd.Series, digits: pd.Series) -> pd.Series:
    """`%.<digits>g` of a number, as C prints it; null for null and non-finite numbers."""
    return pd.Series([None if v is None or not math.isfinite(v) else format(v, f".{int(d)}g") for v, d in zip(x, digits)])


@F.pandas_udf(StringType())
def near_integer_key(x: pd.Series) -> pd.Series:
    """The integer that a number is close to (relative 1e-5, absolute 1e-8), else 12 significant digits."""

    def key(v):
        if v is None or not math.isfinite(v):
            return None
        r = round(v)
        return str(int(r)) if abs(v - r) <= 1e-8 + 1e-5 * abs(r) else format(v, ".12g")

    return x.map(key)


@F.pandas_udf(StringType())
def joined_numbers(x: pd.Series) -> pd.Series:
    """Sorted numbers as a list with semicolons, to 6 significant digits, each text once."""
    return x.map(lambda vs: "; ".join(dict.fromkeys(format(v or 0.0, ".6g") for v in vs)))


def number_key(c: Column, family: str = "overlap") -> Column:
    """Text key of a number: 6 significant digits (inventory), 12 (overlap), or near-integers first (replicate)."""
    if family == "replicate":
        return near_integer_key(c)
    return significant(c, F.lit(6 if family == "inventory" else 12))


def compound_id(c: Column) -> Column:
    """Normalised compound id: blank words empty, integral numbers without a fraction, others as they are."""
    t = blanked(c)
    x = F.when(t.rlike(_NUMBER), t.try_cast("double"))
    whole = finite(x) & (x == F.floor(x)) & (F.abs(x) < 9e18)
    return F.when(whole, x.cast("bigint").cast("string")).otherwise(t)


def is_control(c: Column, family: str = "overlap") -> Column:
    return F.lower(clean_text(c)).isin(CONTROL_WORDS[family])


def is_dmso(control: Column, cid: Column, *names: Column) -> Column:
    """A control that one of its names or its compound id says is DMSO."""
    named = [F.lower(clean_text(n)).contains(w) for n in names for w in DMSO_WORDS]
    hit = compound_id(cid) == DMSO_CID
    for x in named:
        hit = hit | x
    return control & hit


def eligible(control: Column, cell_type: Column, cid: Column, time: Column, dose: Column) -> Column:
    """Not a control, cell type and compound known, time finite, dose finite and above 0."""
    return ~control & (cell_type != "") & (cid != "") & finite(time) & finite(dose) & (dose > 0)


def valid(cid: Column, time: Column, dose: Column) -> Column:
    """Compound not null, time and dose finite; doses of 0 and below and controls count."""
    return cid.isNotNull() & finite(time) & finite(dose)


def condition_key(*cs: Column) -> Column:
    return F.concat_ws("|", *cs)


def replicate_id(path: Column, row: Column) -> Column:
    return F.concat_ws("::", path, row.cast("string"))


def slug(c: Column) -> Column:
    """Runs of characters other than letters, digits, dot, underscore and hyphen become one underscore."""
    return F.btrim(F.regexp_replace(clean_text(c), r"[^A-Za-z0-9._-]+", "_"), F.lit("_"))


def padded(c: Column, width: int = 6) -> Column:
    return F.lpad(c.cast("string"), width, "0")


def mean_available(*cs: Column) -> Column:
    """Mean of the columns that aren't null; null if none is."""
    n = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in cs), F.lit(0))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cs), F.lit(0.0))
    return F.when(n > 0, total / n)


def strict_mean(*cs: Column) -> Column:
    """Mean of the columns; null if any is."""
    return sum(cs[1:], cs[0]) / len(cs)


def difference(a: Column, b: Column) -> Column:
    return a - b
