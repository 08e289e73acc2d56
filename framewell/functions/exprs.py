"""Column expressions: colour, text and number helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def share(condition: Column) -> Column:
    """An aggregate: the share of rows where the condition holds."""
    return F.avg(condition.cast("int"))


def avg_where(x: Column, condition: Column, empty: float | None = None) -> Column:
    """An aggregate: the mean of x where the condition holds, `empty` where it holds nowhere."""
    value = F.avg(F.when(condition, x))
    return value if empty is None else F.coalesce(value, F.lit(empty))


def ratio(x: Column, y: Column) -> Column:
    """x / y, null where y is 0 or null."""
    return F.try_divide(x, F.nullif(y, F.lit(0.0)))


def finite_or_null(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def green_dominance(r: Column, g: Column, b: Column) -> Column:
    return (g - F.greatest(r, b)) / F.greatest(g, F.lit(1 / 255))


def luma601(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def luma709(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def chroma_range(r: Column, g: Column, b: Column) -> Column:
    return F.greatest(r, g, b) - F.least(r, g, b)


def key_ramp(score: Column, floor: Column, foreground: float = 0.025) -> Column:
    """Alpha of a colour key: a gamma ramp from the floor down to the foreground score, snapped at both ends."""
    a = F.pow(clamp((floor - score) / F.greatest(floor - foreground, F.lit(1e-6))), F.lit(1.22))
    return F.when(a < 0.035, 0.0).when(a > 0.995, 1.0).otherwise(a)


def recover(c: Column, a: Column, key: Column) -> Column:
    """A foreground colour without the key's part, blended in by how transparent the pixel is."""
    clean = clamp((c - (1 - a) * key) / F.greatest(a, F.lit(0.055)))
    w = clamp(1.8 * (1 - a))
    return c * (1 - w) + clean * w


def spill_cap(r: Column, g: Column, b: Column) -> Column:
    return F.least(g, F.greatest(r, b) + 0.006)


def odds_contrast(p: Column, k: float) -> Column:
    """Contrast in the odds domain: 0, 0.5 and 1 stay where they are."""
    o = F.pow(p / (1 - p), F.lit(k))
    return F.when(p <= 0, 0.0).when(p >= 1, 1.0).otherwise(o / (1 + o))


def over_grey(c: Column, a: Column) -> Column:
    return c * a + 0.5 * (1 - a)


def quantise(x: Column) -> Column:
    return F.floor(x * 255 + 0.5).cast("long")


def quantise_even(x: Column) -> Column:
    return F.rint(x * 255).cast("long")


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("0x%02X%02X%02X", *(quantise(c).cast("int") for c in (r, g, b)))


def l1_mean(a: Column, b: Column) -> Column:
    """The mean absolute difference of two arrays of one length."""
    total = F.aggregate(F.zip_with(a, b, lambda p, q: F.abs(p - q)), F.lit(0.0), lambda s, x: s + x)
    return total / F.size(a)


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9._-]+", "-"), "^-+|-+$", "")


def fixed(x: Column, places: int = 4) -> Column:
    """A number with fixed decimals, `-` for null."""
    return F.coalesce(F.format_string(f"%.{places}f", x), F.lit("-"))


def free_name(columns: list[str], name: str) -> str:
    """name, longer by underscores where columns have it in upper or lower case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(c: Column) -> Column:
    """c percent-encoded for a URL path: letters, digits, `_.-~` and `/` stay."""
    out = F.url_encode(c)
    for form, path in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(form), F.lit(path))
    return out


def compact(parameters: Column) -> Column:
    """A map's entries as `key=value, key=value`, in its order; `default` for an empty or null one. A null value shows as None."""
    shown = F.transform(F.map_entries(parameters), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"].cast("string"), F.lit("None"))))
    return F.coalesce(F.nullif(F.array_join(shown, ", "), F.lit("")), F.lit("default"))
