"""Path segments: which there are, and what each is in a signature."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from surfaceloom import lists
from surfaceloom.functions.text import lower
from surfaceloom.options import SurfaceOptions

_INDEX = r"(?i)^(?:index\.(?:html?|php)|default\.html?)\z"
_TWO_HYPHENS = "^[^-]*-[^-]*-"
_MIXED = r"^([^.]+)[-_]([A-Za-z0-9]+)\z"
_HASHED = r"^([A-Z]+[G-Z])(?=[0-9]*[A-Fa-f])([0-9A-Fa-f]{8,})(?=[-_]|\z)"


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def is_index(segment: Column) -> Column:
    return segment.rlike(_INDEX)


def kept_segments(all_: Column) -> Column:
    """Without a directory's index document at the end."""
    return F.when(F.coalesce(is_index(F.get(all_, F.size(all_) - 1)), F.lit(False)), F.slice(all_, 1, F.size(all_) - 1)).otherwise(all_)


def is_section(segment: Column) -> Column:
    return F.coalesce(lower(segment).isin(lists.SECTIONS), F.lit(False))


def is_number(s: Column) -> Column:
    return s.rlike(r"^[0-9]+\z")


def is_uuid(s: Column) -> Column:
    return s.rlike(r"^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\z")


def is_hex(s: Column) -> Column:
    return s.rlike(r"^[0-9A-Fa-f]{12,}\z")


def is_text_slug(s: Column) -> Column:
    return (F.octet_length(s) >= 12) & s.rlike(r"^[^.A-Z]*\z") & s.rlike(_TWO_HYPHENS)


def is_numbered_slug(s: Column) -> Column:
    return is_text_slug(s) & s.rlike(r"-[0-9]+\z")


def id_stem(s: Column) -> Column:
    """What stands before a number at the end; empty if the segment is nothing of the kind."""
    stem = F.regexp_extract(s, r"^([^.]+)[-_][0-9]+\z", 1)
    return F.when(stem.rlike("[A-Za-z]"), stem).otherwise("")


def mixed_id_stem(s: Column) -> Column:
    """The same before an id of letters and five digits in a row or more."""
    stem, mark = F.regexp_extract(s, _MIXED, 1), F.regexp_extract(s, _MIXED, 2)
    good = (F.octet_length(s) >= 7) & stem.rlike("[A-Za-z]") & mark.rlike("[A-Za-z]") & mark.rlike("[0-9]{5}")
    return F.when(good, stem).otherwise("")


def is_hashed(s: Column) -> Column:
    return s.rlike(_HASHED)


def hash_label(s: Column) -> Column:
    return F.regexp_extract(s, _HASHED, 1)


def hash_suffix(s: Column) -> Column:
    return F.regexp_replace(s, _HASHED, "")


def token(s: Column, before: Column, last: Column, options: SurfaceOptions = SurfaceOptions()) -> Column:
    """A segment in a signature. before: the segment before it, last: whether it ends the path."""
    fold = (lambda c: c) if options.case_sensitive else lower
    if options.raw_segments:
        return fold(s)
    section = is_section(before)
    out = F.when(is_number(s) & (F.lit(True) if options.fold_ids else section), "N")
    if options.fold_ids:
        out = out.when(is_uuid(s), "U").when(is_hex(s), "H")
    out = out.when(last & (is_numbered_slug(s) | (section & is_text_slug(s))), "S")
    if options.fold_ids:
        stem = F.coalesce(F.nullif(id_stem(s), F.lit("")), mixed_id_stem(s))
        out = out.when(stem != "", F.concat(fold(stem), F.lit("-#")))
    return out.when(is_hashed(s), F.concat(fold(hash_label(s)), F.lit("#"), fold(hash_suffix(s)))).otherwise(fold(s))


def tokens(all_: Column, kept: Column, options: SurfaceOptions = SurfaceOptions()) -> Column:
    return F.transform(kept, lambda s, i: token(s, F.get(kept, i - 1), i == F.size(all_) - 1, options))
