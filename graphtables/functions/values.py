"""Cell values as column expressions: missing, numbers, dates, identifiers, text for output, and name tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?$|^[+-]?(?i:nan|inf|infinity)$"


def stripped(c: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")


def present(c: Column) -> Column:
    """Neither null nor blank; zero and false are present."""
    return c.isNotNull() & c.cast("string").rlike(r"\S")


def value(c: Column) -> Column:
    """The value, null if missing."""
    return F.when(present(c), c)


def first_present(columns: Sequence[Column]) -> Column:
    return F.coalesce(*(value(c).cast("string") for c in columns))


def plain_integer(c: Column) -> Column:
    """Whether a text is an integer of up to 18 digits as it is written: no sign but a minus, no leading zero or white
    space. One short pattern, so that the others here are tried on the rest alone."""
    return c.cast("string").rlike(r"^(0|-?[1-9][0-9]{0,17})\z")


def number(c: Column) -> Column:
    """A double where the whole text is a number, else null; `1_000` counts, `1.0d` does not."""
    text = stripped(c)
    return F.when(plain_integer(c), c.cast("string").cast("double")).when(text.rlike(NUMBER), F.regexp_replace(text, "_", "").try_cast("double"))


def iso_date(c: Column) -> Column:
    """A date where the whole text is yyyy-mm-dd, else null; texts with a time part are none."""
    text = stripped(c)
    return F.when(~plain_integer(c) & text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def identifier(columns: Sequence[Column]) -> Column:
    """Parts joined by a bar, null as soon as one is missing."""
    sound = F.lit(True)
    for c in columns:
        sound = sound & present(c)
    return F.when(sound, F.concat_ws("|", *(stripped(c) for c in columns)))


def rendered_key(columns: Sequence[Column]) -> Column:
    """Parts joined by a bar, null as empty text."""
    return F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))


def shown(c: Column, kind: str) -> Column:
    """Text for output: null empty, booleans lower case, whole doubles without a fraction."""
    if kind in ("double", "float"):
        whole = (c == F.floor(c)) & (F.abs(c) < 9e15)
        return F.coalesce(F.when(whole, c.cast("long").cast("string")).otherwise(c.cast("string")), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def snake_case(c: Column) -> Column:
    cut = F.regexp_replace(F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1_$2"), r"[^A-Za-z0-9]+", "_")
    return F.lower(F.regexp_replace(cut, r"^_+|_+$", ""))


def name_tokens(c: Column) -> Column:
    """Distinct lower-case tokens of a name, cut at case changes and non-alphanumerics."""
    return F.array_distinct(F.filter(F.split(snake_case(c), "_"), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token arrays, rounded to four digits; empty against empty is 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.round(F.size(F.array_intersect(a, b)) / union, 4)).otherwise(F.lit(0.0))


def is_identifier(c: Column) -> Column:
    """Whether a text is a plain name: a letter or an underscore, then letters, digits and underscores."""
    return F.coalesce(c.rlike(r"^[A-Za-z_][A-Za-z0-9_]*\z"), F.lit(False))


def truth(c: Column) -> Column:
    """A boolean that is held as text: `true`, `1`, `yes` and `y` in any case are true, other texts false, missing is null."""
    return F.when(present(c), F.lower(stripped(c)).isin("true", "1", "yes", "y"))


def padded_id(prefix: str, separator: str, n: Column, width: int) -> Column:
    return F.concat(F.lit(prefix + separator), F.lpad(n.cast("string"), width, "0"))
