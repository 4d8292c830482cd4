"""ASCII case, and fields of a URL line: column in, column out."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

from surfaceloom import lists


def lower(c: Column) -> Column:
    return F.translate(c, ascii_uppercase, ascii_lowercase)


def after(c: Column, mark: str) -> Column:
    """What follows the first mark; the mark has to be there."""
    return F.substring(c, F.instr(c, mark) + len(mark), F.length(c))


def scheme_split(line: Column) -> tuple[Column, Column]:
    """Scheme and rest, cut at the first ://, wherever it is; without one there is no scheme."""
    found = F.instr(line, "://") > 0
    return F.when(found, F.substring_index(line, "://", 1)).otherwise(""), F.when(found, after(line, "://")).otherwise(line)


#: Schemes before another ://, one after the other; the group is the last.
_REPEATED = r"(?i)^(?:(https?)(?=[:/])[^:]*(?::(?!//)[^:]*)*://)+"


def scheme_repair(line: Column) -> tuple[Column, Column]:
    """Scheme and rest once the schemes of URLs within the URL's front are taken off; to any depth."""
    scheme, rest = scheme_split(line)
    again = (F.instr(line, "://") > 0) & rest.rlike(_REPEATED)
    return F.when(again, F.regexp_extract(rest, _REPEATED, 1)).otherwise(scheme), F.when(again, F.regexp_replace(rest, _REPEATED, "")).otherwise(rest)


def authority(rest: Column) -> Column:
    return F.regexp_extract(rest, "^[^/?#]*", 0)


def host(authority: Column) -> Column:
    return F.regexp_replace(authority, r":[0-9]*\z", "")


def port(authority: Column) -> Column:
    """Null: there is none; empty: a colon without digits."""
    return F.when(authority.rlike(r":[0-9]*\z"), F.regexp_extract(authority, r":([0-9]*)\z", 1))


def default_port(scheme: Column, port: Column) -> Column:
    return F.coalesce(((lower(scheme) == "http") & (port == "80")) | ((lower(scheme) == "https") & (port == "443")), F.lit(False))


def unfragmented(tail: Column) -> Column:
    return F.substring_index(tail, "#", 1)


def path(tail: Column) -> Column:
    return F.substring_index(unfragmented(tail), "?", 1)


def query(tail: Column) -> Column:
    """Null: there is no question mark."""
    whole = unfragmented(tail)
    return F.when(F.instr(whole, "?") > 0, after(whole, "?"))


def valid_host(host: Column) -> Column:
    return host.rlike(r"\.[A-Za-z]{2,}\z")


def clean_host(host: Column) -> Column:
    """A lower-cased host without percent-code remnants in front.

    Taking one off never changes whether the host is a valid one, as none has a dot, so all go at once.
    """
    remnants = "^(?:" + "|".join(lists.REMNANTS) + ")+"
    return F.when(valid_host(host), F.regexp_replace(host, remnants, "")).otherwise(host)


def first_segment(path: Column) -> Column:
    return F.regexp_extract(path, "^/*([^/]+)", 1)


def last_segment(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/*\z", 1)
