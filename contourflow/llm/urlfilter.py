"""URL rules, and block decisions that reach every alias of a page through redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that name a visit and not a page.
TRACKING = r"(?:utm_[a-z]+|gclid|fbclid|ref|source|sessionid|sid)"
_HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
_URL = r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)"""
_CANONICAL = r"""(?i)\brel\s*=\s*["']?canonical\b"""
_REFRESH = r"""(?is)http-equiv\s*=\s*["']?refresh\b(.*)"""


def lower_ascii(x: Column) -> Column:
    return F.translate(x, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest of rules (verdict, host, path) that fits, as a struct (rule, verdict); null if none does.

    A rule fits its host and all subdomains, if the path starts with the rule's. Of equally long ones the first counts.
    """
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def normal_form(url: Column) -> Column:
    """One spelling for addresses that a site redirects to each other.

    Scheme, www., m. or amp. before the host, default port, fragment, tracking parameters, a trailing slash and .html are
    left out; the remaining parameters are kept in order. Null and what has no :// gives null.
    """
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^(?:www|m|amp)\.", ""), r":(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"(?:index)?\.html?$", ""), r"/+$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(rf"(?i)^{TRACKING}(?:=|$)")), "&")
    return F.when(url.contains("://"), F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def absolute(link: Column, base: Column) -> Column:
    """A link of a page as a whole address."""
    scheme, host = F.regexp_extract(base, r"(?s)^(.*?)://", 1), host_of(base)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(scheme, F.lit("://"), host, link))
        .when(link != "", F.concat(scheme, F.lit("://"), host, F.regexp_replace(path_of(base), r"[^/]*$", ""), F.when(path_of(base) == "", "/").otherwise(""), link))
    )


def _tags(html: Column, name: str) -> Column:
    """What follows <name in each stretch between two >, one step for each character however long a tag is."""
    return F.transform(F.filter(html, lambda x: x.rlike(rf"(?i)<{name}\b")), lambda x: F.regexp_extract(x, rf"(?is)<{name}\b(.*)", 1))


def links(pages: DataFrame) -> DataFrame:
    """Rows (url, to): each page's address with that of its canonical link and of its meta redirect, tags of any length."""
    head, parts = F.coalesce(F.col("html"), F.lit("")), F.split("html", ">")
    closed = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    canonical = F.regexp_extract(F.get(F.filter(_tags(closed, "link"), lambda x: x.rlike(_CANONICAL)), F.lit(0)), _HREF, 1)
    refresh = F.filter(F.transform(_tags(parts, "meta"), lambda x: F.regexp_extract(F.regexp_extract(x, _REFRESH, 1), _URL, 1)), lambda x: x != "")
    found = F.array(
        F.when(F.lower(head).contains("canonical"), absolute(canonical, F.col("url"))),
        F.when(F.lower(head).contains("refresh"), absolute(F.get(refresh, F.lit(0)), F.col("url"))),
    )
    return pages.where("url is not null").select("url", F.explode(F.filter(found, lambda x: x.isNotNull() & (x != ""))).alias("to")).distinct()


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """A row for each page: page_id, host, path, rule and verdict (allow or block).

    A page that a rule fits has the rule's verdict, whatever its aliases say. Any other page has that of its aliases:
    allowed if a rule allows one of them, else blocked if a rule blocks one, else allowed. Aliases are the pages of one
    connected component over normal forms, canonical links, meta redirects and, if given, redirects (a, b: addresses) from outside.
    A null url, or one without ://, has empty host and path, no aliases, and is allowed. Null and empty pages link to
    nothing; tags and pages may be of any length. Of two links of one kind the first in the page counts, of equally long
    rules the first in the list. Repeated rows each get a row, rows of one url are one address whatever they hold; other
    columns of pages don't matter, whatever their names. An empty table gives none.
    Groups are aggregated before they are shuffled; rules are expressions, their number is the list's.
    """
    x = pages.select("page_id", "url", "html").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    x = x.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules)).withColumn("_n", normal_form(F.col("url")))
    linked = links(pages)
    if redirects is not None:
        linked = linked.union(redirects.select("a", "b"))
    linked = checkpointed(linked)
    edges = linked.select(normal_form(F.col("url")).alias("a"), normal_form(F.col("to")).alias("b")).where("a is not null and b is not null")
    # Addresses that pages only link to count as aliases too.
    ends = linked.select(F.explode(F.array("url", "to")).alias("u"))
    ends = ends.select(normal_form(F.col("u")).alias("_n"), rule_of(host_of(F.col("u")), path_of(F.col("u")), rules)["verdict"].alias("verdict"))
    own = checkpointed(x.select("page_id", "host", "path", "_r", "_n"))
    roots = components(edges, "string")
    said = own.select("_n", "_r.verdict").union(ends).where("_n is not null")
    said = said.groupBy("_n").agg(F.bool_or(F.col("verdict") == "allow").alias("allows"), F.bool_or(F.col("verdict") == "block").alias("blocks"))
    said = said.join(roots, said["_n"] == roots["node"], "left").select("_n", "allows", "blocks", F.coalesce("root", "_n").alias("root"))
    by_root = said.groupBy("root").agg(F.bool_or("allows").alias("allows"), F.bool_or("blocks").alias("blocks"))
    verdicts = said.select(F.col("_n").alias("_k"), "root").join(by_root, "root").select("_k", F.when(F.col("allows"), "allow").when(F.col("blocks"), "block").otherwise("allow").alias("_v"))
    out = own.join(verdicts, own["_n"] == verdicts["_k"], "left")
    return out.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce("_r.verdict", "_v", F.lit("allow")).alias("verdict"))
