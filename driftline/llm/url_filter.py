"""URL block rules that follow redirects and canonical links.

A rule (action, host, path) fits a url of its host or a subdomain whose path
starts with the rule's; the longest rule wins.  Urls without a rule take the
decision of their aliases: pages are linked to the urls they redirect to (meta
refresh) or name as canonical, and the connected components of those links are
classes of aliases.  A class with an explicit allow is allowed; else a class
with an explicit block is blocked; else the url is allowed.

Scale: rules are joined on the host's suffixes (at most one per label), so a
long list costs a lookup per label.  Only pages that carry a link, and the
urls they name, enter the components; page texts are read once and never
shuffled.

Links are resolved against the page's own url (``base`` elements are not
read); only path-relative ones have their dot segments carried out.

Defined results: a null url, or one without ``://``, has an empty host and
path, no rule and no aliases; null html has no links; a link to a url that no
page has still joins the pages that name it; repeated rows are judged one by
one; all canonical and refresh tags of a page are read; other columns are not
read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, connected_components, save


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://", "")
    return F.when(F.contains(url, F.lit("://")), ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://", "")
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def alias_key(url: Column) -> Column:
    """A url without scheme and fragment: what redirects and canonical links
    name.  Null where there is no ``://``."""
    rest = F.regexp_replace(url, r"(?s)^.*?://", "")
    query = F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)?", 1)
    path = path_of(url)
    return F.when(F.contains(url, F.lit("://")) & (host_of(url) != ""), F.concat(host_of(url), F.when(path == "", F.lit("/")).otherwise(path), query))


def without_dots(path: Column) -> Column:
    """A path from ``/`` with its ``.`` and ``..`` segments carried out."""
    up = lambda out: F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(1)))
    step = lambda out, s: F.when(s == ".", out).when(s == "..", up(out)).otherwise(F.concat(out, F.array(s)))
    kept = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.array_join(kept, "/"), F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit("")))


def resolve(url: Column, link: Column) -> Column:
    """The absolute url that ``link`` names on the page ``url``; null for no
    link and for schemes without ``://`` (``mailto:``)."""
    site = F.concat(F.regexp_extract(url, r"(?s)^(.*?)://", 1), F.lit("://"), host_of(url))
    path = F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url))
    folder = F.regexp_extract(path, r"(?s)^.*/", 0)
    relative = without_dots(F.concat(folder, F.regexp_extract(link, r"^[^?#]*", 0)))
    return (
        F.when(link == "", F.lit(None).cast("string"))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(F.regexp_extract(url, r"(?s)^(.*?)://", 1), F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(site, link))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None).cast("string"))
        .when(F.startswith(link, F.lit("#")), url)
        .when(F.startswith(link, F.lit("?")), F.concat(site, path, link))
        .otherwise(F.concat(site, relative, F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)))
    )


def linked_urls(url: Column, html: Column) -> Column:
    """Absolute urls that a page redirects to or names as canonical."""
    tag = r"(?is)<link\b(?=[^>]*\brel\s*=\s*(?:\"(?:[^\">]*\s)?canonical[\s\"]|'(?:[^'>]*\s)?canonical[\s']|canonical[\s/>]))[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"
    refresh = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\bcontent\s*=\s*[\"']?[^\"'>]*?url\s*=\s*[\"']?([^\"'\s>]+)"
    none = F.array().cast("array<string>")
    found = [F.coalesce(F.when(F.contains(F.lower(html), F.lit(word)), F.regexp_extract_all(html, F.lit(pattern), F.lit(1))), none) for word, pattern in (("canonical", tag), ("refresh", refresh))]
    plain = lambda f: F.replace(f, F.lit("&amp;"), F.lit("&"))
    return F.array_compact(F.transform(F.array_distinct(F.concat(*found)), lambda f: resolve(url, plain(f))))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: id, host, path, rule, verdict.  ``rules`` has action
    (allow or block), host and path."""
    u = F.col(url)
    slim = pages.select(F.col(id_col).alias("id"), host_of(u).alias("host"), path_of(u).alias("path"), alias_key(u).alias("node"), F.transform(linked_urls(u, F.col(html)), alias_key).alias("links"))
    slim = save(slim.withColumn("uid", F.monotonically_increasing_id()), "url-pages")

    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    # each (host, path) once: a site's common urls are looked up once
    urls = slim.where("host <> ''").select("host", "path").distinct()
    rule = rules.select(F.col("host").alias("at"), F.concat("host", "path").alias("rule"), F.col("path").alias("start"), "action")
    fits = urls.withColumn("at", F.explode(F.array_distinct(suffixes))).join(rule, "at").where(F.startswith("path", "start"))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "action"), F.struct(F.char_length("rule"), "rule", F.col("action") == "allow")).alias("best"))
    best = save(best.select(F.col("host").alias("h"), F.col("path").alias("p"), "best.*"), "url-rules")
    ruled = slim.join(best, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    ruled = save(ruled.select("uid", "id", "host", "path", "node", "links", "rule", "action"), "url-ruled")

    edges = ruled.where("node is not null").select(F.col("node").alias("src"), F.explode("links").alias("dst"))
    classes = save(connected_components(edges, "url"), "url-classes")
    members = classes.join(ruled.select("node", "action").where("action is not null"), "node")
    decided = members.groupBy("component").agg(F.max(F.col("action") == "allow").alias("allowed"))
    decided = classes.join(decided, "component").select(F.col("node").alias("alias"), F.when(F.col("allowed"), "allow").otherwise("block").alias("by_class"))
    out = ruled.join(decided, F.col("node") == F.col("alias"), "left")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("action", "by_class", F.lit("allow")).alias("verdict"))
