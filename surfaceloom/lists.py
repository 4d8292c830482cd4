"""Words, endings and markers that decide what a URL is. They have to be these for the results to be right."""

from __future__ import annotations

import re

# Endings of stylesheets, images, fonts, sound and films.
NOISE = (
    "css png jpg jpeg gif svg ico bmp webp tif tiff woff woff2 ttf eot otf mp4 mp3 avi mov webm wav ogg m4a m4p m4b m4v aac wma aiff aif opus "
    "mid midi oga ogv weba amr caf ac3 mpg mpeg m2v wmv f4v f4a 3gp 3g2 vob asf flac mkv"
).split()
# Further endings of files that a server hands out as they are.
PLAIN = "map txt csv md ini log conf yaml yml pdf doc docx xls xlsx ppt pptx zip rar gz tar 7z bz2 sql bak old swp phps".split()
STATIC = [*NOISE, *PLAIN]
# Media endings that are too new to count as known, and endings of scripts and markup that do.
UNKNOWN_MEDIA = "m4p m4b m4v aac wma aiff aif opus mid midi oga ogv weba amr caf ac3 mpg mpeg m2v wmv f4v f4a 3gp 3g2 vob asf".split()
MARKUP = "php asp aspx asmx jsp jspx html htm js json xml xsl xsd dtd swf fla cgi pl py do dwt class iml exe dll dat rs name tn".split()
KNOWN = [*(x for x in STATIC if x not in UNKNOWN_MEDIA), *MARKUP]
# Sections whose entries are content.
SECTIONS = (
    "blog blogs post posts article articles news story stories tag tags category categories cat cats catalog product products item items "
    "topic topics thread threads forum forums comment comments review reviews page pages section sections listing listings"
).split()
# Top-level domains, and more public suffixes that hosts may hold.
TLDS = "com net org info biz co us ee ly ye tr ru ua uk".split()
SUFFIXES = [
    *TLDS,
    *(
        "in io id me de cn tv cc ai sh gg ws bz pe to nu la fm im st ca es fr it nl pl se ch at dk cz jp kr br mx za au nz sg hk tw th vn ph my ae sa il ir pk ng "
        "xyz top icu vip cyou sbs online site shop app"
    ).split(),
]
# Files that crawlers ask every host for.
ROOT_FILES = (
    "robots.txt favicon.ico sitemap.xml sitemap_index.xml humans.txt security.txt ads.txt crossdomain.xml clientaccesspolicy.xml apple-touch-icon.png "
    "apple-touch-icon-precomposed.png index.html index.htm index.php index.asp index.aspx index.jsp default.html default.htm default.asp default.aspx"
).split()
# Remnants of percent codes in front of hosts, in the order in which they are tried.
REMNANTS = "25252f 2528 253d 2532 252f 2f 2e 3a 3d 23 3f 25 3b 40 5c 5c2f".split()
# Marks of injections and fragments, in paths and queries.
MARKS = [
    "%3c", "%3e", "%22", "%27", "%00", "%0a", "%0d", "%09", "<script", "</script", "javascript:", "onerror", "onload=", "onmouseover", "alert(", "prompt(", "confirm(",
    "union select", "union%20select", "unionselect", "order by", "order%20by", "information_schema", "xp_cmdshell", "sleep(", "benchmark(", "waitfor delay", "pg_sleep",
    "extractvalue(", "updatexml(", "concat(", "char(", "0x3c", "%252e", "&quot", "&gt;", "&lt;", "&amp;", " http/", "%20http/", "http/1.", "user-agent:", "host:", "cookie:",
    "referer:", "x-forwarded", "accept-encoding", "fuzz", "%cb%93", "%e2%86%92", "inexistent", "%c2%a0", "%c2%ad", "%ef%bb%bf", "%e2%80", "%e2%81", "%2525", "%25%25", "%252f",
    "%ef%ac", "%e3%80", "%e5%ad", "%d0%", "%d1%", "%d8%", "%d9%",
]
# The same, in paths only.
PATH_MARKS = [
    "http:", "https:", "://", "..", "%2e%2e", "%20", "%09", "%00", "%3f", "%5b", "%5c", "%5d", "%5e", "%60", "%7b", "%7c", "%7d", "%25",
    "etc/passwd", "etc%2fpasswd", "/etc/shadow", "boot.ini", "win.ini", "3a2f2f",
]
# Marks of payloads in parameter values, and words that are ones next to a blank.
PAYLOADS = [
    "union", "select", "sleep(", "benchmark(", "concat(", "information_schema", "xp_cmdshell", "waitfor", "pg_sleep", "extractvalue", "updatexml", "cast(", "having ",
    "procedure analyse", "dbms_pipe", "utl_inaddr", "load_file", "<script", "javascript:", "onerror", "onload=", "onmouseover", "alert(", "prompt(", "confirm(", "fromcharcode",
    "%3cscript", "../", "..%2f", "..%5c", "%2e%2e", "etc/passwd", "etc%2fpasswd", "/etc/shadow", "boot.ini", "win.ini", "${", "#{", "{{", "<%", "0x7", "0x3", "--", "%23", "/*",
    "%2f%2a", "javascript%3a", "data%3atext", "%26%26", "%7c%7c", "%60", "%3bls", "+ls+", "+ls%20", "%20ls%20", "%20ls+",
]
BLANK_WORDS = "union select sleep benchmark and or".split()
# Endings that a colon follows in leaked header lines.
HEADER_ENDINGS = "js css php asp aspx html htm json xml jsp".split()
# Longest values that are taken as they are, in bytes.
VALUE_BYTES = 96


def any_of(words: list[str]) -> str:
    """A pattern for any of the words, longer ones first where one begins another."""
    return "(?:" + "|".join(re.sub(r"([^A-Za-z0-9_ /<&%:=#-])", r"\\\1", w) for w in sorted(words, key=lambda w: (-len(w), w))) + ")"


#: What is no ending of its own but begins one: at most three characters.
CUT_ENDINGS = sorted({k[:n] for k in KNOWN for n in (1, 2, 3) if n < len(k)} - set(KNOWN))
