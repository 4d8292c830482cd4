"""The garbage gate: predicates on the parts of a URL, each of them a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from surfaceloom import lists
from surfaceloom.functions.query import is_graph_query
from surfaceloom.functions.text import first_segment, last_segment, lower

_TLDS, _STATIC = lists.any_of(lists.TLDS), lists.any_of(lists.STATIC)
_TAIL = r"\.(?![0-9.]+\z)"
_MANGLED = "(?i)" + "|".join(
    [rf"\.php(?!\z|[s5]\z|{_TAIL})", rf"\.asp(?!\z|x\z|net\z|{_TAIL})", rf"\.jsp(?!\z|x\z|{_TAIL})", rf"\.htm(?!\z|l\z|{_TAIL})", rf"\.(?:cgi|pl)(?!\z|{_TAIL})"]
)
#: Chunks of 2 to 24 bytes, four times and 24 bytes at least.
_REPEATED = r"(?s)(.{6,24})\1{3}|(.{5})\2{4}|(.{4})\3{5}|(.{3})\4{7}|(.{2})\5{11}"


def yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def bad_path_bytes(path: Column) -> Column:
    return path.rlike(r"""[\x00-\x20\x7f{}"<>\\^`|\[\]'*()$,&!]|[^\x00-\x7f]|^[^;]*=""")


def bad_query_bytes(query: Column) -> Column:
    return yes(query.rlike(r"""[\x00-\x20\x7f"<>\\^`|]""") | (query.rlike("[{}]") & ~is_graph_query(query)))


def leading_comma(query: Column) -> Column:
    return yes(F.startswith(query, F.lit(",")))


def marked(text: Column) -> Column:
    return yes(text.rlike("(?i)" + lists.any_of(lists.MARKS)))


def path_marked(path: Column) -> Column:
    return path.rlike("(?i)" + lists.any_of(lists.PATH_MARKS))


def clock(text: Column) -> Column:
    return yes(text.rlike(r"\[[0-9]{1,2}:[0-9]{2}:[0-9]{2}"))


def bad_name(query: Column) -> Column:
    return yes(
        query.rlike(
            r"(?:^|&)[^&=]*[%+][^&=]*=|(?:^|&)[^&=A-Za-z0-9_]+=|(?:^|&)(?=[^&=]*%)[%0-9A-Fa-f]{1,8}(?=&|\z)|(?:^|&)[^&=A-Za-z0-9]{1,8}(?=&|\z)"
        )
    )


def embedded_domain(segment: Column) -> Column:
    return segment.rlike(rf"(?i)^[a-z0-9-][a-z0-9.-]*\.{_TLDS}\z")


def glued_domain(text: Column) -> Column:
    return text.rlike(rf"(?i)\.(?!{_TLDS}(?![A-Za-z0-9-])){_TLDS}[A-Za-z0-9]")


def schema_file(segment: Column) -> Column:
    return segment.rlike(r"(?i)\.(?:dtd|xsd)\z")


def mangled_script(segment: Column) -> Column:
    return segment.rlike(_MANGLED)


def static_kind(segment: Column) -> Column:
    """1: a static file, 2: a static ending with something glued to it, 0: neither."""
    return F.when(segment.rlike(rf"(?i)\.{_STATIC}\z"), 1).when(segment.rlike(rf"(?i)\.(?!{_STATIC}(?:\.|\z)){_STATIC}(?!\.|\z)"), 2).otherwise(0)


def cut_ending(segment: Column) -> Column:
    ending = lower(F.substring_index(segment, ".", -1))
    return F.contains(segment, F.lit(".")) & ((ending == "") | ending.isin(lists.CUT_ENDINGS))


def scanner_tag(segment: Column) -> Column:
    return segment.rlike(r"^[^.]*[a-z]Show\z|[Aa]0[0-9]\z|^[0-9]{1,3}[A-Z]\z")


def header_line(segment: Column) -> Column:
    return segment.rlike(rf":\z|(?i)\.(?:{'|'.join(lists.HEADER_ENDINGS)}):")


def hash_junk(segment: Column) -> Column:
    return segment.rlike("(?s)^[A-Z]+[G-Z](?=[0-9]*[A-Fa-f])[0-9A-Fa-f]{8,}[-_].*[0-9][A-Za-z]")


def repeated_segment(path: Column) -> Column:
    return path.rlike(r"(?:^|/)([^/]{2,})/+\1(?:/|\z)")


def repeated_chunk(path: Column) -> Column:
    return (F.octet_length(path) >= 40) & path.rlike(_REPEATED)


def empty_port(port: Column) -> Column:
    return yes(port == "")


def shallow(tail: Column) -> Column:
    """Path, query and fragment: nothing, a slash, or a file that crawlers ask for."""
    return tail.rlike(rf"(?i)^(?:/+|/{lists.any_of(lists.ROOT_FILES)}/*)?\z")


def host_embeds(host: Column) -> Column:
    labels = F.split(lower(host), r"\.")
    n = F.size(labels)
    name = F.get(labels, n - 4)
    front = F.slice(labels, 1, F.greatest(n - 4, F.lit(0)))
    return yes((n >= 4) & F.get(labels, n - 3).isin(lists.SUFFIXES) & name.rlike("[a-z]") & ~name.rlike("[0-9]") & F.forall(front, lambda x: x == "www"))


def bad_host(authority: Column, host: Column, port: Column, tail: Column) -> Column:
    return empty_port(port) | glued_domain(authority) | (host_embeds(host) & shallow(tail))


def reasons(path: Column, query: Column, last: Column | None = None) -> list[tuple[str, Column]]:
    """Every predicate on path and query, cheap ones first."""
    first, last = first_segment(path), last_segment(path) if last is None else last
    return [
        ("bad_path_bytes", bad_path_bytes(path)),
        ("leading_comma", leading_comma(query)),
        ("bad_query_bytes", bad_query_bytes(query)),
        ("marked_path", marked(path)),
        ("path_marked", path_marked(path)),
        ("marked_query", marked(query)),
        ("clock", clock(path) | clock(query)),
        ("bad_name", bad_name(query)),
        ("embedded_domain", embedded_domain(first) | embedded_domain(last)),
        ("glued_domain", glued_domain(first)),
        ("schema_file", schema_file(last)),
        ("mangled_script", mangled_script(last)),
        ("mangled_static", static_kind(last) == 2),
        ("cut_ending", cut_ending(last)),
        ("scanner_tag", scanner_tag(last)),
        ("header_line", header_line(last)),
        ("hash_junk", hash_junk(last)),
        ("repeated_segment", repeated_segment(path)),
        ("repeated_chunk", repeated_chunk(path)),
    ]


def garbage(path: Column, query: Column, last: Column | None = None) -> Column:
    out = F.lit(False)
    for _, c in reasons(path, query, last):
        out = out | c
    return out


def reason_names(path: Column, query: Column) -> Column:
    return F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in reasons(path, query))), lambda x: x.isNotNull())


def noise(path: Column) -> Column:
    return path.rlike(rf"(?i)\.{lists.any_of(lists.NOISE)}\z")
