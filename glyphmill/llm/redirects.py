"""URL rules, and block decisions that follow redirects and canonical links to aliases."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from . import common as C


class Rule(NamedTuple):
    """`verdict` is allow or block, for a host with its subdomains and paths that start so."""

    verdict: str
    host: str
    path: str = "/"


RULES = (
    Rule("allow", "org"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"),
)

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
# Parameters that say where a visitor came from, not which page it is.
_TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid|mc_[a-z]+)(=|$)"


def host(url: Column) -> Column:
    """What stands between the first `://` and the next `/`, `?` or `#`, in lower case; else empty."""
    return F.coalesce(C.lower_ascii(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to `?` or `#`; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def ruled(urls: DataFrame, rules: Sequence[Rule] = RULES, url: str = "url") -> DataFrame:
    """All columns with host, path, rule and ruling of the longest rule that fits; the last two are null
    when none fits. Of equally long rules an allowing one wins. Rules are few and travel in the plan."""
    rows = urls.withColumn("host", host(F.col(f"`{url}`"))).withColumn("path", path(F.col(f"`{url}`")))
    ordered = sorted(rules, key=lambda r: (-len(r.host + r.path), r.verdict != "allow"))
    table = F.array(*[
        F.struct(*[F.lit(v).alias(n) for n, v in zip(("verdict", "host", "path"), r)]) for r in ordered
    ]) if ordered else F.array().cast("array<struct<verdict:string,host:string,path:string>>")
    fits = F.filter(table, lambda r: F.endswith(F.concat(F.lit("."), "host"), F.concat(F.lit("."), r["host"]))
                    & F.startswith("path", r["path"]))
    return rows.withColumn("_rule", F.get(fits, F.lit(0))).withColumn(
        "rule", F.concat("_rule.host", "_rule.path")
    ).withColumn("ruling", F.col("_rule.verdict")).drop("_rule")


# The character references that addresses are written with, beside numbers.
_REFERENCES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def decoded(text: Column) -> Column:
    """Text of an attribute with its references by number, and those of `_REFERENCES`, as characters. What
    names no character stays as it is."""
    def one(part: Column) -> Column:
        digits = F.regexp_extract(part, r"(?i)^#(x?[0-9a-f]{1,8});", 1)
        code = F.when(F.rlike(digits, F.lit("^[0-9]{1,7}$")), digits.cast("bigint")).when(
            F.rlike(digits, F.lit("(?i)^x[0-9a-f]{1,6}$")), F.conv(F.substring(digits, 2, 6), 16, 10).cast("bigint")
        )
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        number = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code)), 8, "0")), "UTF-32")
        name = F.regexp_extract(part, "^([a-z]{2,4});", 1)
        named = F.get(F.array(*map(F.lit, _REFERENCES.values())), F.array_position(
            F.array(*map(F.lit, _REFERENCES)), name).cast("int") - 1)
        rest = F.regexp_replace(part, "^[^;]*;", "")
        return F.coalesce(F.concat(F.coalesce(number, named), rest), F.concat(F.lit("&"), part))

    parts = F.split(text, "&")
    return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), one), ""))


def without_dots(path_: Column) -> Column:
    """A path with its `.` and `..` parts resolved; one that ends in such a part ends in `/`."""
    def step(done: Column, part: Column) -> Column:
        # The first part is what stands before the first slash.
        return F.when(part == ".", done).when(
            part == "..", F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
        ).otherwise(F.concat(done, F.array(part)))

    parts = F.split(F.regexp_replace(path_, r"(^|/)(\.{1,2})$", "$1$2/"), "/")
    return F.when(F.rlike(path_, F.lit(r"(^|/)\.{1,2}(/|$)")), F.array_join(
        F.aggregate(parts, F.array().cast("array<string>"), step), "/"
    )).otherwise(path_)


def alias_key(url: Column) -> Column:
    """What is the same for trivial variants of an address: no scheme, fragment, tracking
    parameters, closing slash, index page, dot parts or default port. Null for what is no address."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(
        F.split(query, "&"), lambda p: (p != "") & ~F.rlike(F.lower(p), F.lit(_TRACKING))
    )), "&")
    page = F.regexp_replace(without_dots(path(url)), r"(?i)/(index\.[a-z]+)?$", "")
    named = F.regexp_replace(host(url), r":(80|443)$", "")
    return F.when(named != "", F.concat(named, page, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def declared_targets(html: Column) -> Column:
    """Addresses a page names as its own: canonical links and refreshing redirects, references decoded."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    canonical = F.transform(
        F.filter(tags, lambda t: F.rlike(t, F.lit(r"(?is)\brel\s*=\s*[\"']?canonical\b"))),
        lambda t: F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1),
    )
    refresh = F.transform(
        F.filter(tags, lambda t: F.rlike(t, F.lit(r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b"))),
        lambda t: F.regexp_extract(t, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1),
    )
    return F.transform(F.filter(F.concat(canonical, refresh), lambda u: u != ""), decoded)


def absolute(target: Column, base: Column) -> Column:
    """A target as written on the page `base`. Relative ones are taken from its host or folder, those of a query or a
    fragment alone from the page itself; dot parts are resolved."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    root = F.concat(scheme, F.lit("://"), host(base))
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    whole = (
        F.when(F.rlike(target, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://")), target)
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(root, target))
        .when(F.rlike(target, F.lit("^[?#]")), F.concat(root, path(base), target))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), target))
    )
    cut = r"(?s)^([^?#]*?://[^/?#]*)([^?#]*)(.*)$"
    return F.when(F.rlike(whole, F.lit(cut)), F.concat(
        F.regexp_extract(whole, cut, 1), without_dots(F.regexp_extract(whole, cut, 2)), F.regexp_extract(whole, cut, 3)
    )).otherwise(whole)


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst) addresses from the pages' own canonical links and redirects."""
    return pages.select(
        F.col(f"`{url}`").alias("src"), F.explode_outer(declared_targets(F.col(f"`{html}`"))).alias("target")
    ).where("target is not null").select("src", absolute(F.col("target"), F.col("src")).alias("dst"))


def judge(urls: DataFrame, edges: DataFrame, rules: Sequence[Rule] = RULES, url: str = "url",
          default: str = "allow") -> DataFrame:
    """All columns of `urls` with host, path, rule and verdict (and `via`: rule, alias or default).

    A url's own rule decides. Without one, the verdict comes from the urls it is equal to: those with the
    same `alias_key`, and all that redirect or canonical edges (src, dst) reach from there in any direction.
    An allow among them wins over a block. Edge ends that are not in `urls` count too, by their own rules.
    Without any, `default`. Null urls and edges with a null end have no aliases; repeated rows get
    the same verdict; columns named like the results are replaced, all others keep their values.
    """
    results = ("host", "path", "rule", "verdict", "via")
    inner = {c: f"_given{i}" for i, c in enumerate(urls.columns)}
    rows = ruled(urls.toDF(*inner.values()), rules, inner[url])
    key = alias_key(F.col(inner[url]))
    rows = rows.withColumn("_key", F.when(key.isNotNull(), F.xxhash64(key)))
    ends = ruled(edges.select(F.explode(F.array("src", "dst")).alias("url")), rules).select(
        F.when(alias_key(F.col("url")).isNotNull(), F.xxhash64(alias_key(F.col("url")))).alias("_key"), "ruling"
    )
    links = edges.select(
        F.xxhash64(alias_key(F.col("src"))).alias("a"), F.xxhash64(alias_key(F.col("dst"))).alias("b")
    ).where(alias_key(F.col("src")).isNotNull() & alias_key(F.col("dst")).isNotNull())
    roots = C.components(links, "aliases").withColumnRenamed("node", "_key")
    rulings = rows.select("_key", "ruling").unionByName(ends).where("_key is not null and ruling is not null")
    by_key = rulings.groupBy("_key").agg(F.min("ruling").alias("ruling"))
    by_root = by_key.join(roots, "_key", "left").groupBy(F.coalesce("root", "_key").alias("_root")).agg(
        F.min("ruling").alias("inherited")
    )
    # A ruled key without edges answers for itself; one with edges, for all keys of its root.
    to_key = by_root.join(roots, by_root["_root"] == roots["root"], "left").select(
        F.coalesce("_key", "_root").alias("_key"), "inherited"
    )
    judged = rows.join(to_key, "_key", "left")
    return judged.select(
        *[F.col(given).alias(c) for c, given in inner.items() if c not in results], "host", "path", "rule",
        F.coalesce("ruling", "inherited", F.lit(default)).alias("verdict"),
        F.when(F.col("ruling").isNotNull(), "rule").when(F.col("inherited").isNotNull(), "alias")
        .otherwise("default").alias("via"),
    )
