"""A table of URLs for the queries: edge cases, the pages table, and shapes filled from the events table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

EDGES = r"""
http://a.example.com/
https://a.example.com:443/x
http://a.example.com:80/x
https://a.example.com:080/x
http://a.example.com:8080/x
http://a.example.com:/x
http://a.example.com:abc/x
HTTP://A.Example.COM/Path/Index.HTML
https://https://b.example.com/x?y=1
https://http/http://b.example.com/x
http://https:http://b.example.com/a
https://httpx://b.example.com/x
no-scheme.example.com/path
://odd.example.com/x
user:pw@c.example.com/x
http://2f2fd.example.com/
http://25252f3ad.example.com/x
http://23andme.com/x
http://3d.example.com/x
http://5c2fq/x
http://plain/x
http://e.example.com//a///b//
http://e.example.com/a/b#frag?x=1
http://e.example.com/?
http://e.example.com/?#
http://e.example.com/a?b?c=1
http://e.example.com/d/index.html/
http://e.example.com/d/default.htm
http://e.example.com/d/index.php?x=1
http://e.example.com/index.html/x
http://e.example.com/users/1001
http://e.example.com/category/99
http://e.example.com/Category/100
http://e.example.com/item/00000000-0000-4000-8000-000000000001
http://e.example.com/o/5e6f7a8b-9c0d-4e1f-a2b3-c4d5e6f7a8b9
http://e.example.com/o/DEADBEEFDEADBEEF
http://e.example.com/blog/how-to-write-a-parser
http://e.example.com/blog/How-To-Write-A-Parser
http://e.example.com/x/how-to-write-a-parser
http://e.example.com/x/how-to-write-parsers-2024
http://e.example.com/x/how-to-write-parsers-2024/y
http://e.example.com/news/a-b-c
http://e.example.com/x/product-name_12345
http://e.example.com/x/Product-Name-77
http://e.example.com/x/item-ab12345
http://e.example.com/x/item_A12345b
http://e.example.com/x/TIP14995B514_P1
http://e.example.com/x/TIP14995B514_P1cIt
http://e.example.com/x/IMGDEADBEEF
http://e.example.com/x/DOCABCDEF12
http://e.example.com/x/INV00012345
http://e.example.com/x/DEADBEEF12
http://e.example.com/x/N
http://e.example.com/search?q=1&role=2
http://e.example.com/search?role=2&q=5
http://e.example.com/search?q=7
http://e.example.com/search?q=7&q=8
http://e.example.com/search?debug
http://e.example.com/search?ssl
http://e.example.com/search?12345&x=1
http://e.example.com/search?=v&x=1
http://e.example.com/search?&&x=1&
http://e.example.com/go?next=//evil.example/z&after=1
http://e.example.com/go?next=http://evil.example/z?a=1&b=2
http://e.example.com/go?next=%2F%2fevil.example&b=2
http://e.example.com/graphql
http://e.example.com/graphql?query={me}
http://e.example.com/graphql?query=%7Bme%7D&x=1
http://e.example.com/graphql?Query={me}
http://e.example.com/p?id=1+union+select
http://e.example.com/p?id=../../x
http://e.example.com/p?id=%0g
http://e.example.com/p?id=%0
http://e.example.com/p?id=a--b
http://e.example.com/p?id=nothing+here
http://e.example.com/p?id=or%20not
http://e.example.com/p?id=0x7f&name=ok
http://e.example.com/p?id=aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa
http://e.example.com/a.js.map?x=1
http://e.example.com/a.txt?x=1
http://e.example.com/a.tar.gz
http://e.example.com/a.css
http://e.example.com/a.PNG?x=1
http://e.example.com/a.png/
http://e.example.com/x.woff2
http://e.example.com/notes.md7%5E2044
http://e.example.com/fit.txtFoo
http://e.example.com/a.txt-b
http://e.example.com/web.config
http://e.example.com/a.c
http://e.example.com/a.ph
http://e.example.com/login.
http://e.example.com/api/v1.7
http://e.example.com/a.php.9.2.5
http://e.example.com/a.php.bak
http://e.example.com/a.php5
http://e.example.com/a.php8
http://e.example.com/a.aspnet
http://e.example.com/a.aspx.cs
http://e.example.com/a.jspx
http://e.example.com/x.jsp;jsessionid=AA11
http://e.example.com/x;jsessionid=AA11
http://e.example.com/x
http://e.example.com/x;v=1/y
http://e.example.com/a.html.bak
http://e.example.com/a.plist
http://e.example.com/a.cgi.
http://e.example.com/listShow
http://e.example.com/q/xA01
http://e.example.com/q/11H
http://e.example.com/q/3LL
http://e.example.com/Connection:
http://e.example.com/a.js:202
http://e.example.com/loose.dtd
http://e.example.com/v/loose.XSD
http://e.example.com/foo/foo
http://e.example.com/foo//foo/x
http://e.example.com/f/f/x
http://e.example.com/abcdefabcdefabcdefabcdefabcdefabcdefabcdefabcdef
http://e.example.com/x/ababababababababababababababababababababab
http://e.example.com/x/aabaabaabaabaabaabaabaab/1234567890123456789
http://e.example.com/a{b}
http://e.example.com/a b
http://e.example.com/a=b
http://e.example.com/a;b=c
http://e.example.com/a,b
http://e.example.com/café
http://e.example.com/x?name=café
http://e.example.com/x?a="b"
http://e.example.com/x?a={b}
http://e.example.com/x?,a=1
http://e.example.com/x?a=%3Cscript%3E
http://e.example.com/x?a=fuzzing
http://e.example.com/..%2fetc/passwd
http://e.example.com/x/https3A2F2Fq
http://e.example.com/a[12:30:45
http://e.example.com/x?t=q[1:02:03
http://e.example.com/x?%3Fid=1
http://e.example.com/x?a+b=1
http://e.example.com/x?-=1
http://e.example.com/x?_=1
http://e.example.com/x?%2F
http://e.example.com/x?--
http://e.example.com/bit.ly/x
http://e.example.com/x/evil.com
http://e.example.com/x/.com
http://e.example.com/Hostphp.vulnweb.comServer/x
http://www.company.com/x
http://a.network.com/x
http://x.com.example.org/x
http://www.evil.com.example.org/
http://www.evil.com.example.org/deep/x
http://www.evil.com.example.org/robots.txt
http://www.evil.com.example.org/Robots.TXT/
http://a.evil.com.example.org/
http://ev1l.com.example.org/
http://evil.io.example.org//
http://evil.io.example.org/?x=1
http://f.example.com/b?z=1&a=2
http://f.example.com/b?a=9&z=3&m=1
http://f.example.com/b
http://f.example.com/b/
http://f.example.com/c?a=1&a=2
http://f.example.com/c?a=1
http://f.example.com/c?a=1&token=2
ftp://f.example.com/d
http://
?
/
""".strip().split("\n")  # noqa: E501

#: <u>: a user's number, <e>: an event's, <t>: its kind.
SHAPES = """
https://s<u>.example.com/users/<e>
https://s<u>.example.com/users/<e>/
https://S<u>.example.com/Users/<e>/index.html
https://s<u>.example.com:443/<t>?id=<e>
https://s<u>.example.com/<t>?id=<e>&ref=<u>
https://s<u>.example.com/<t>?ref=<u>&id=<e>
https://s<u>.example.com/<t>?id=<e>&id=<u>
https://s<u>.example.com/<t>
http://s<u>.example.com:80/<t>/<e>
http://s<u>.example.com:8080/<t>/<e>
https://s<u>.example.com/blog/why-<t>-matters-today
https://s<u>.example.com/blog/why-<t>-matters-<e>
https://s<u>.example.com/x/<t>-and-more-news-<e>
https://s<u>.example.com/product/<e>
https://s<u>.example.com/o/0000<u><e>-abcd
https://s<u>.example.com/a;jsessionid=<e>
https://s<u>.example.com/static/<t>.css?v=<e>
https://s<u>.example.com/files/<t><e>.pdf?x=1
https://s<u>.example.com/<t>.php?page=<e>
https://s<u>.example.com/<t>.php<e>
https://s<u>.example.com/p?q=<e>+or+1--
https://s<u>.example.com/p?next=//h<e>.example.com/x&y=1
https://s<u>.example.com/p?<e>
https://s<u>.example.com/p?tok<e>&a=1
https://https://s<u>.example.com/<t>/<e>
s<u>.example.com/<t>
https://2f2fs<u>.example.com/<t>
https://s<u>.example.com/<t>/<t>/<e>
https://s<u>.example.com/x/<t>-item-<e>
https://s<u>.example.com/graphql?query={<t>}
https://s<u>.example.com/m?a=<e>&b=<u>&c=<t>
https://s<u>.example.com/m?a=<e>&c=<t>
https://s<u>.example.com/m?c=<t>
https://s<u>.example.com/q/<e>L
https://www.s<t>.com.example.org/
https://s<u>.example.com//<t>//<e>#top
https://s<u>.example.com/x?a=%3c<e>
https://s<u>.example.com/<t>.ph
https://s<u>.example.com/KEY0000AB<e>99_<t>
https://s<u>.example.com/x/Ref-<t>-ab<e>12345
""".strip().split("\n")


def _pieces(shape: str, cast: str) -> str:
    """A shape as an SQL expression."""
    holes = {"<u>": f"CAST(user_id AS {cast})", "<e>": f"CAST(event_id AS {cast})", "<t>": "event_type"}
    return "concat(" + ", ".join(holes.get(p) or f"'{p}'" for p in re.split("(<[uet]>)", shape) if p) + ")"


def events_sql(cast: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {_pieces(s, cast)}" for i, s in enumerate(SHAPES))
    return f"CASE event_id % {len(SHAPES)} {cases} END"


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord (long) and line."""
    edges = spark.createDataFrame(list(enumerate(EDGES)), "ord long, line string")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("1000000000000 + page_id AS ord", "url AS line")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("2000000000000 + event_id AS ord", f"{events_sql('STRING')} AS line")
    return edges.unionAll(pages).unionAll(events).where("octet_length(line) > 0")
