"""URL filter with redirect equivalence. DataFrame functions only.

Pages whose url a rule fits take the verdict of the longest such rule. The others take the verdict of their
redirect class: the connected component, over canonical links and refresh redirects found in the html, of
urls in normal form (scheme, fragment, tracking parameters, a final slash and index pages put aside).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical["']?[^>]*>"""
REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh["']?[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH_URL = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z in lower case; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def normal_form(url: Column) -> Column:
    """One text for spellings of a url that servers redirect to one another."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))
    query = F.regexp_replace(query, r"(?i)(^|&)(utm_\w+|ref|fbclid|gclid)=[^&]*", "")
    path = F.regexp_replace(path_of(url), r"(/index\.html?|/)$", "")
    return F.when(url.contains("://"), F.concat(host_of(url), path, F.lit("?"), F.regexp_replace(query, r"^&", "")))


#: Character references with names that links hold.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0"}


def decoded(link: Column) -> Column:
    """The link as its markup means it: named and numeric character references resolved, once; unknown ones stay."""

    def piece(x: Column, i: Column) -> Column:
        digits, hexed = F.regexp_extract(x, r"^#0*([0-9]{1,5});", 1), F.regexp_extract(x, r"(?i)^#x0*([0-9a-f]{1,4});", 1)
        code = F.when(digits != "", digits.cast("int")).when(hexed != "", F.conv(hexed, 16, 10).cast("int"))
        fits = (code > 0) & (code < 65536) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 4, "0")), "UTF-16BE")
        out = F.when(F.coalesce(fits, F.lit(False)), F.concat(char, F.regexp_replace(x, "^[^;]*;", ""))).otherwise(F.concat(F.lit("&"), x))
        for name, raw in NAMED.items():
            out = F.when(x.startswith(f"{name};"), F.concat(F.lit(raw), F.substr(x, F.lit(len(name) + 2)))).otherwise(out)
        return F.when(i == 0, x).otherwise(out)

    return F.when(link.contains("&"), F.array_join(F.transform(F.split(link, "&", -1), piece), "")).otherwise(link)


def _without_dots(path: Column) -> Column:
    """A path that begins with /, its . and .. segments worked off."""
    parts = F.slice(F.split(path, "/"), F.lit(2), F.size(F.split(path, "/")))
    none = F.array().cast("array<string>")
    step = lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    done = F.aggregate(parts, none, step)
    ends = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(none)
    return F.concat(F.lit("/"), F.array_join(F.concat(done, ends), "/"))


def resolved(url: Column, link: Column) -> Column:
    """The link as a whole url, seen from a page's url; null for other schemes, bare fragments and pages without ://."""
    root = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    scheme = F.regexp_extract(url, r"(?s)^(.*?:)//", 1)
    folder = F.regexp_replace(F.concat(F.when(path_of(url) == "", "/").otherwise(path_of(url))), r"[^/]*$", "")
    path, rest = F.regexp_extract(link, r"(?s)^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), link)
        .when(link.rlike(r"^(?:$|#|[A-Za-z][A-Za-z0-9+.\-]*:)") | F.coalesce(root == "", F.lit(True)), F.lit(None).cast("string"))
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("?"), F.concat(root, path_of(url), link))
        .when(link.startswith("/"), F.concat(root, _without_dots(path), rest))
        .otherwise(F.concat(root, _without_dots(F.concat(folder, path)), rest))
    )


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits; of equally long ones an allow comes first."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = F.when(fits, F.lit(rule_host + rule_path)).otherwise(text)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, class_allows, class_blocks: one row for each row of pages.

    rules: (allow or block, host, path prefix), a short list held by the driver. A page without a fitting rule
    is allowed if its class holds an explicit allow, else blocked if its class holds a block, else allowed.
    Links count relative to the page's url, with their character references resolved. Null urls and urls without :// have no class and are allowed; null html has no links; repeated rows are judged alike; empty
    tables give no rows; further columns, whatever their names, are left out.
    """
    url, html = F.col("url"), F.coalesce(F.col("html"), F.lit(""))
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    links = F.concat(
        F.transform(F.regexp_extract_all(html, F.lit(CANONICAL), 0), lambda t: F.regexp_extract(t, HREF, 1)),
        F.transform(F.regexp_extract_all(html, F.lit(REFRESH), 0), lambda t: F.regexp_extract(t, REFRESH_URL, 1)),
    )
    links = F.when(F.lower(html).contains("canonical") | F.lower(html).contains("refresh"), links).otherwise(F.array().cast("array<string>"))
    absolute = F.filter(F.transform(links, lambda t: resolved(url, decoded(t))), lambda t: t.isNotNull())
    p = p.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"), absolute.alias("links"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    p = p.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("own"), F.md5(normal_form(url).cast("binary")).alias("node"), "links")
    p = written(p, "judged-pages")

    ends = p.where(F.size("links") > 0).select("node", F.explode("links").alias("link")).distinct()
    ends = ends.select("node", F.md5(normal_form(F.col("link")).cast("binary")).alias("target"), host_of(F.col("link")).alias("host"), path_of(F.col("link")).alias("path"))
    ends = written(ends.withColumn("own", fitting_rule(F.col("host"), F.col("path"), rules)[1]), "links")
    facts = p.where("own is not null and node is not null").select("node", "own")
    facts = facts.unionByName(ends.where("own is not null").select(F.col("target").alias("node"), "own"))
    facts = facts.groupBy("node").agg(F.max(F.col("own") == "allow").alias("class_allows"), F.max(F.col("own") == "block").alias("class_blocks"))
    classes = connected_components(ends, "node", "target")
    joined = facts.join(classes, "node", "left").select(F.coalesce("component", "node").alias("component"), "class_allows", "class_blocks")
    joined = joined.groupBy("component").agg(F.max("class_allows").alias("class_allows"), F.max("class_blocks").alias("class_blocks"))
    # Classes of one node name themselves; the others hand their facts to every member.
    of_node = joined.join(classes, "component", "left").select(F.coalesce("node", "component").alias("node"), "class_allows", "class_blocks")
    out = p.join(of_node, "node", "left")
    none = F.lit(False)
    allows, blocks = F.coalesce("class_allows", none), F.coalesce("class_blocks", none)
    method = F.when(blocks & ~allows, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", method).alias("verdict"), allows.alias("class_allows"), blocks.alias("class_blocks"))
