"""Block and allow decisions for urls, carried to aliases.

A page's own rule decides first. Redirects and canonical links are edges between urls; their connected components are classes of
aliases. A page without a rule takes over what the rules say of its aliases: allow if one of them is allowed explicitly, else block if
one is blocked, else allow.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentry.llm.common import fresh, store, without
from incidentry.llm.components import connected

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NAMES_LINKS = r"(?i)<(link|meta)[\s/]"
COMMENT = re.compile(r"(?s)<!--.*?(?:-->|\Z)")
TAG = re.compile(r"""(?is)<(link|meta|base)(?=[\s/>])((?:"[^"]*"|'[^']*'|[^>"'])*)>""")
ATTRIBUTE = re.compile(r"""(?s)([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
REFRESH_NAMED = re.compile(r"""(?is)\burl\s*=\s*["']?\s*([^"'\s]+)""")
REFRESH_PLAIN = re.compile(r"""(?s)\s*[\d.]+\s*[;,]\s*["']?([^"'\s]+)""")

SCHEME, END = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:"), re.compile(r"[?#]")
PARTS = re.compile(r"(?s)(.*?:)(//[^/?#]*)([^?#]*)(\?[^#]*)?")


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty for null or without ``://``."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), CAPITALS, SMALL)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(rules: Sequence[Rule], host: Column, path: Column, value: str) -> Column:
    """The text or verdict of the longest rule that fits; null if none does. Equally long rules: allow before block."""
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r.verdict == "allow")):
        inside = (host == rule.host) | host.endswith(f".{rule.host}")
        answer = rule.verdict if value == "verdict" else rule.host + rule.path
        chosen = F.when(inside & path.startswith(rule.path), F.lit(answer)).otherwise(chosen)
    return chosen


def node(url: Column) -> Column:
    """A url without fragment, scheme and host in lower case; null without ``://``."""
    plain = F.regexp_replace(url, r"(?s)#.*$", "")
    head = F.regexp_extract(plain, r"(?s)^(.*?://[^/?]*)", 1)
    rest = F.regexp_replace(plain, r"(?s)^.*?://[^/?]*", "")
    return F.when(F.instr(url, "://") > 0, F.concat(F.translate(head, CAPITALS, SMALL), rest))


def without_dots(path: str) -> str:
    """A path that starts with a slash or is empty, without its ``.`` and ``..`` parts."""
    parts, kept = path.split("/")[1:], []
    for part in parts:
        if part == "..":
            del kept[-1:]
        elif part != ".":
            kept.append(part)
    if parts and parts[-1] in (".", ".."):
        kept.append("")
    return "/" + "/".join(kept) if path else ""


def resolved(link: str, base: str) -> str | None:
    """A link as an absolute url, as in RFC 3986; with a scheme of its own it is taken as it is. Null if ``base`` has no ``://``."""
    if SCHEME.match(link):
        return link
    if (parts := PARTS.match(base)) is None:
        return None
    scheme, site, path, query = parts.groups("")
    if link.startswith("//"):
        scheme, site, path, query = PARTS.match(scheme + link).groups("")
        return scheme + site + without_dots(path) + link[len(site) + len(path) :]
    own = END.split(link, maxsplit=1)[0]
    rest = link[len(own) :]
    if not own:
        return scheme + site + path + (rest if rest.startswith("?") else query + rest)
    return scheme + site + without_dots(own if own.startswith("/") else (path[: path.rfind("/") + 1] or "/") + own) + rest


def tags(text: str) -> Iterator[tuple[str, dict[str, str]]]:
    """(name, attributes) of the link, meta and base tags outside comments; of attributes that repeat the first counts."""
    for tag in TAG.finditer(COMMENT.sub("", text)):
        found: dict[str, str] = {}
        for name, *values in ATTRIBUTE.findall(tag[2]):
            found.setdefault(name.lower(), unescape("".join(values)))
        yield tag[1].lower(), found


def targets(text: str, own: str) -> list[str]:
    """Where a page's canonical links and refresh tags lead, all of them, resolved against its first base or else its own url."""
    base, links = None, []
    for name, found in tags(text):
        if name == "base":
            base = base or found.get("href", "").strip() or None
        elif name == "link":
            if "canonical" in found.get("rel", "").lower().split():
                links.append(found.get("href", "").strip())
        elif found.get("http-equiv", "").strip().lower() == "refresh":
            content = found.get("content", "")
            if hit := REFRESH_NAMED.search(content) or REFRESH_PLAIN.match(content):
                links.append(hit[1])
    start = resolved(base, own) if base else None
    start = start if start and "://" in start else own
    return [url for link in links if link and (url := resolved(link, start)) is not None]


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(u, v): a page's url and each url that its canonical links and refresh tags name.

    ``rel`` is a list of words, a refresh may leave out ``url=``, and what stands in comments does not count. Relative links are resolved
    against the page's url, or against that of its first ``<base href>``.
    """

    @F.arrow_udf("array<string>")
    def found(text: pa.Array, own: pa.Array) -> pa.Array:
        return pa.array([targets(a, b) for a, b in zip(text.to_pylist(), own.to_pylist())], pa.list_(pa.string()))

    text, own = F.col(f"`{html}`"), F.col(f"`{url}`")
    rows = pages.select(node(own).alias("u"), own.alias("own"), text.alias("text")).where(F.col("u").isNotNull() & F.col("text").rlike(NAMES_LINKS))
    ends = rows.select("u", F.explode(found("text", "own")).alias("link")).select("u", node(F.col("link")).alias("v"))
    return ends.where("v is not null and u != v")


def judge(
    pages: DataFrame,
    rules: Sequence[Rule],
    redirects: DataFrame | None = None,
    id: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """All rows of ``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``redirects`` (source, target) adds observed redirects to the links found in the pages. ``rules`` is a list held by the caller. A url
    that is null or has no ``://`` has no aliases. Repeated urls share a class. Columns with the name of a result column are replaced.
    """
    pages = without(pages, "host", "path", "rule", "verdict")
    own = F.col(f"`{url}`")
    edges = page_links(pages, url, html)
    if redirects is not None:
        edges = edges.union(redirects.select(node(F.col("source")).alias("u"), node(F.col("target")).alias("v")))
    classes = store(connected(edges), "aliases")
    # a class is judged by all its urls, pages or not
    members = classes.union(classes.select(F.col("root").alias("node"), "root")).distinct()
    said = fitting(rules, host(F.col("node")), path(F.col("node")), "verdict")
    decided = members.select("root", said.alias("said")).groupBy("root").agg(
        F.max((F.col("said") == "allow").cast("int")).alias("allowed"), F.max((F.col("said") == "block").cast("int")).alias("blocked")
    )
    key, inherited = fresh(pages, "_node", "_inherited")
    passed = members.join(decided, "root").select(
        F.col("node").alias(key), F.when((F.col("blocked") == 1) & (F.coalesce("allowed", F.lit(0)) == 0), "block").alias(inherited)
    )
    rows = pages.withColumns({"host": host(own), "path": path(own), key: node(own)})
    rows = rows.withColumn("rule", fitting(rules, F.col("host"), F.col("path"), "rule"))
    rows = rows.withColumn("verdict", fitting(rules, F.col("host"), F.col("path"), "verdict"))
    rows = rows.join(passed.where(f"{inherited} is not null"), key, "left")
    return rows.withColumn("verdict", F.coalesce("verdict", inherited, F.lit("allow"))).drop(key, inherited)
