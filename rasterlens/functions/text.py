"""Column functions over names, categories, annotation text and schedule cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Image suffixes in the order in which a lookup prefers them.
IMAGE_SUFFIXES = [".bmp", ".jpeg", ".jpg", ".png", ".tif", ".tiff", ".webp"]


def strip(s: Column) -> Column:
    """Trim all Unicode white space, not only spaces."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def normal_category(s: Column) -> Column:
    """Lower case, spaces to underscores, none repeated or at the edges; null is ``none``."""
    parts = F.split(F.replace(F.lower(strip(s)), F.lit(" "), F.lit("_")), "_")
    return F.coalesce(F.array_join(F.filter(parts, lambda x: x != ""), "_"), F.lit("none"))


def suffix_of(name: Column) -> Column:
    return F.regexp_extract(name, r"(\.[^./]+)$", 1)


def renamed(stem: Column, old_name: Column) -> Column:
    """New stem with the suffix of the old name; no suffix where there is no old name."""
    return F.concat(stem, F.coalesce(suffix_of(old_name), F.lit("")))


def augmentation(stem: Column) -> dict[str, Column]:
    """Source, angle and flip of an augmented name; null where the name is of another form."""
    pattern = r"^(\d{3})_aug_r(\d{3})(?:_(vflip|hflip))?$"
    part = lambda i: F.nullif(F.regexp_extract(stem, pattern, i), F.lit(""))
    angle = F.try_element_at(F.array(part(2)), F.lit(1)).cast("int")
    return {"source": part(1), "angle": angle, "flip": part(3), "valid": (angle <= 360) & (angle % 20 == 0)}


def augmented_name(stem: Column, angle: Column, flip: Column, suffix: Column) -> Column:
    return F.concat(stem, F.format_string("_aug_r%03d", angle), F.coalesce(F.concat(F.lit("_"), flip), F.lit("")), suffix)


def log_field(s: Column) -> Column:
    """Escape tabs and line ends; null is empty."""
    out = F.coalesce(s, F.lit(""))
    for raw, shown in (("\t", "\\t"), ("\r", "\\r"), ("\n", "\\n")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    return out


def is_blank(s: Column) -> Column:
    return s.isNull() | (strip(s) == "")


def schedule_date(s: Column, year: int) -> Column:
    """End date of ``m.d``, ``m.d-m.d`` or ``m.d-d``; null where the text is none of these."""
    text = strip(s)
    start, end = F.split_part(text, F.lit("-"), F.lit(1)), F.split_part(text, F.lit("-"), F.lit(2))
    month = F.when(F.contains(end, F.lit(".")), F.split_part(end, F.lit("."), F.lit(1))).otherwise(F.split_part(start, F.lit("."), F.lit(1)))
    day = F.when(end == "", F.split_part(start, F.lit("."), F.lit(2))).when(F.contains(end, F.lit(".")), F.split_part(end, F.lit("."), F.lit(2))).otherwise(end)
    whole = F.concat_ws("-", F.lit(str(year)), F.lpad(strip(month), 2, "0"), F.lpad(strip(day), 2, "0"))
    return F.when(F.regexp_like(text, F.lit(r"^\d{1,2}\.\d{1,2}(-\d{1,2}(\.\d{1,2})?)?$")), F.try_to_date(whole, "yyyy-MM-dd"))


def status_action(a: Column, d: Column, fill: Column) -> Column:
    """``fill`` a blank cell that is not red, ``clear`` a red one that has text, else null."""
    red = F.coalesce(fill == 255, F.lit(False))
    return F.when(~is_blank(a), F.when(is_blank(d) & ~red, "fill").when(~is_blank(d) & red, "clear"))


def display_category(normal: Column, names: dict[str, str] | None = None) -> Column:
    """Display name of a normalised category, null for others."""
    names = names or {"scratch": "Scratch", "pit": "Pit", "stain": "Stain"}
    return F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), normal)


def output_stem(stem: Column, text: Column) -> Column:
    """A stem with ``_text`` behind it where there is a text."""
    return F.concat_ws("_", stem, F.nullif(text, F.lit("")))


def flag_of(category: Column, flags: dict[str, bool]) -> Column:
    """A category's flag, false where none is given."""
    if not flags:
        return F.lit(False)
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in flags.items() for x in pair)), category), F.lit(False))
