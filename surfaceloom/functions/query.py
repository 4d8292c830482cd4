"""Query strings: parameter names, junk, payloads, and what is left of a query."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from surfaceloom import lists
from surfaceloom.functions.text import after
from surfaceloom.options import SurfaceOptions

_GRAPH = r"(?:\{|%7[bB])"


def name(token: Column) -> Column:
    return F.substring_index(token, "=", 1)


def has_value(token: Column) -> Column:
    return F.instr(token, "=") > 0


def value(token: Column) -> Column:
    return F.when(has_value(token), after(token, "=")).otherwise("")


def is_junk(token: Column) -> Column:
    return token.rlike(r"^(?:[0-9]+|[A-Za-z0-9]{5,64})\z")


def holds_url(value: Column) -> Column:
    return value.rlike("^//|://|%2[fF]%2[fF]")


def is_graph_query(query: Column) -> Column:
    cheap = F.contains(query, F.lit("{")) | F.contains(query, F.lit("%7"))
    return F.coalesce(cheap & query.rlike("(?:^|&)query=" + _GRAPH), F.lit(False))


def is_payload(value: Column) -> Column:
    blank = F.contains(value, F.lit("+")) | F.contains(value, F.lit("%20"))
    return (
        F.when((value == "") | holds_url(value), False)
        .when(F.octet_length(value) > lists.VALUE_BYTES, True)
        .when(value.rlike(r"""(?s)[\x00-\x1f\x7f<>"'`\\]|%[01].|%2[27]|%3[cCeE]"""), True)
        .when(blank & value.rlike("(?i)" + lists.any_of(lists.BLANK_WORDS)), True)
        .otherwise(value.rlike("(?i)" + lists.any_of(lists.PAYLOADS)))
    )


def _wanted(t: Column, options: SurfaceOptions) -> Column:
    return F.lit(True) if options.keep_invalid else ~(~has_value(t) & is_junk(t))


def keys(query: Column, options: SurfaceOptions = SurfaceOptions()) -> Column:
    """The names in byte order, repeated ones too; what follows a value with a URL is that URL's."""
    all_ = F.split(query, "&")
    stop = F.array_position(F.transform(all_, lambda t: has_value(t) & holds_url(value(t))), F.lit(True))
    own = F.when(stop > 0, F.slice(all_, 1, stop.cast("int"))).otherwise(all_)
    return F.array_sort(F.transform(F.filter(own, lambda t: (name(t) != "") & _wanted(t, options)), name))


def clean(query: Column, options: SurfaceOptions = SurfaceOptions()) -> Column:
    """The query without junk, payloads blanked, in its own order."""

    def one(t: Column) -> Column:
        v = value(t)
        graph = (name(t) == "query") & v.rlike("^" + _GRAPH)
        return F.when(has_value(t), F.concat(name(t), F.lit("="), F.when(graph | ~is_payload(v), v).otherwise(""))).otherwise(t)

    return F.array_join(F.transform(F.filter(F.split(query, "&"), lambda t: (t != "") & _wanted(t, options)), one), "&")


def tagged(keys: Column) -> Column:
    """A multiset as a set: each name with its running number among equal ones. keys are sorted."""
    return F.transform(keys, lambda k, i: F.concat(k, F.lit("\x01"), (i - F.array_position(keys, k) + 1).cast("string")))
