"""URL filters over classes of equivalent addresses.

Addresses are normalised (scheme, ``www.``, default port, fragment, tracking
parameters and trailing slash don't tell pages apart).  Canonical links and
refresh redirects of the pages, and any table of redirects, are edges between
addresses; connected components of them are aliases of each other.

A page's decision is, in this order: ``allow`` where a rule allows its own
address explicitly, ``block`` where a rule blocks its address or that of an
alias, else ``pass``.  An allowance isn't inherited: a page doesn't get off a
block list by naming an allowed page as its canonical address.

Rules are a table of any size: each address has some ten keys (itself, its host,
the host's suffixes and names), which meet the rules in an equi-join.
"""

from __future__ import annotations

import html
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sampleloom.llm.components import connected_components
from sampleloom.llm.storage import materialize
from sampleloom.shipping import ship

#: The rules of the query, (rule, decision).  A rule is a domain, which holds for all its hosts; with ``=`` before it
#: a host and no other below it; with ``.*`` after it that name under any suffix; or with a path a single address.
RULES = (
    ("adult-x.*", "block"),
    ("spam-farm.*", "block"),
    ("cheap-pills.*", "block"),
    ("=ads-track.*", "block"),
    ("casino-win.*", "block"),
    ("free-bets.*", "block"),
    ("ads-track.example.org", "allow"),
    ("free-bets.example.com", "allow"),
)
#: Query parameters that don't tell pages apart.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid|mc_[a-z]+|sessionid"

_STEPS = (
    (r"^\s+|\s+$", ""),
    (r"#.*$", ""),
    (r"^[A-Za-z][A-Za-z0-9+.-]*://", ""),
    (rf"([?&])({TRACKING})=[^&]*", r"$1"),
    (r"[?&]+$", ""),
    (r"\?&+", "?"),
    (r"&&+", "&"),
    (r"/(index\.html?)?$", ""),
)


def normalised(url: str, duck: bool = False) -> str:
    """SQL for an address without what doesn't tell pages apart; ``url`` is an expression."""
    e = url
    for pattern, to in _STEPS:
        if duck:
            e = f"regexp_replace({e}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
        else:
            e = f"regexp_replace({e}, r'{pattern}', r'{to}')"
    host = "regexp_extract({0}, '{1}', 0)"
    bare = host.format("x", "^[^/?]*")
    clean = f"lower({bare})"
    for pattern in ("^www[.]", ":(80|443)$"):
        clean = f"regexp_replace({clean}, '{pattern}', '')"
    # x is bound once
    if duck:
        return f"list_transform([{e}], lambda x: {clean} || substr(x, length({bare}) + 1))[1]"
    return f"transform(array({e}), x -> concat({clean}, substr(x, length({bare}) + 1)))[0]"


def rule_keys(address: str) -> str:
    """SQL for the array of the rules that would hold for a normalised address."""
    host = f"regexp_extract({address}, '^[^/?]*', 0)"
    return f"""transform(array(split({host}, '[.]')), p -> array_distinct(concat(
        array({address}, concat('=', array_join(p, '.')), concat('=', p[0], '.*')),
        transform(sequence(1, size(p)), i -> array_join(slice(p, i, size(p)), '.')),
        transform(p, x -> concat(x, '.*')))))[0]"""


def _ruled(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """(address, blocked, allowed) of the distinct ``addresses`` that a rule holds for."""
    keyed = addresses.where("address IS NOT NULL").distinct().select("address", F.explode(F.expr(rule_keys("address"))).alias("rule"))
    says = rules.select(F.lower(F.trim("rule")).alias("rule"), F.lower("decision").alias("decision"))
    says = says.where("rule IS NOT NULL").groupBy("rule").agg(*(F.coalesce(F.max(F.col("decision") == d), F.lit(False)).alias(n) for d, n in (("block", "blocked"), ("allow", "allowed"))))
    return keyed.join(says, "rule").groupBy("address").agg(F.max("blocked").alias("blocked"), F.max("allowed").alias("allowed"))


def service_redirects(pages: DataFrame) -> DataFrame:
    """(src, dst): pages on a site's mobile or blog host redirect to the site's own host."""
    url = F.col("url").cast("string")
    return pages.select(url.alias("src"), F.regexp_replace(url, _SERVICE, "$1").alias("dst")).where("src <> dst")


_SERVICE = r"(?i)^(https?://)(?:m|blog)[.]"
_CANONICAL = r"""(?i)<link\s[^>]*rel=["']?canonical["']?[^>]*>"""
_REFRESH = r"""(?i)<meta\s[^>]*http-equiv=["']?refresh["']?[^>]*>"""


_BASE = r"""(?i)<base\s[^>]*href=["']?([^"'\s>]+)"""
_HREF = r"""(?i)\shref\s*=\s*["']?([^"'\s>]+)"""
_URL = r"""(?i)url\s*=\s*["']?([^"'\s>]+)"""


def _resolve(urls: pd.Series, bases: pd.Series, targets: pd.Series) -> pd.Series:
    """The targets as a browser at those URLs takes them, null where that is no address of a host."""

    def one(url, base, target):
        try:
            at = url.strip() if "://" in url else "http://" + url.strip()
            full = urljoin(urljoin(at, html.unescape(base)) if base else at, html.unescape(target))
            return full if urlsplit(full).netloc else None
        except ValueError:  # such as a bracket in a host
            return None

    return pd.Series([one(*x) for x in zip(urls, bases, targets)], dtype=object)


def page_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) of normalised addresses: from pages to the target of each of their canonical links and refresh redirects.

    Relative targets are resolved against the page's ``base href``, where it has one, and its URL.
    """
    text = F.col("html").cast("string")
    marked = pages.where(F.lower(text).contains("canonical") | F.lower(text).contains("refresh"))
    tags = F.concat(
        F.transform(F.regexp_extract_all(text, F.lit(_CANONICAL), F.lit(0)), lambda t: F.regexp_extract(t, _HREF, 1)),
        F.transform(F.regexp_extract_all(text, F.lit(_REFRESH), F.lit(0)), lambda t: F.regexp_extract(t, _URL, 1)),
    )
    found = marked.select(F.col("url").cast("string").alias("url"), F.regexp_extract(text, _BASE, 1).alias("base"), F.explode(tags).alias("to"))
    resolve = F.pandas_udf(_resolve, "string")
    found = found.where("to <> '' AND url IS NOT NULL").select("url", resolve("url", "base", "to").alias("to")).where("to IS NOT NULL")
    return found.select(F.expr(normalised("url")).alias("src"), F.expr(normalised("to")).alias("dst"))


def decide(pages: DataFrame, redirects: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """(page_id, url_key, decision) of every page, the decision being ``allow``, ``block`` or ``pass``.

    ``redirects`` has src and dst addresses, in any form.  ``rules`` has rule and decision (see RULES, which hold
    where none are given); a rule that says both counts as both, and null rules and other decisions as none.  Only page_id, url and
    html are read.  A null url is in no class and passes, with a null url_key;
    a null html has no links.  Repeated rows are decided alike, each on its
    own; an empty table gives no rows.
    """
    spark = pages.sparkSession
    ship(spark)
    if rules is None:
        rules = spark.createDataFrame(list(RULES), "rule string, decision string")
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(F.expr(normalised("CAST(src AS STRING)")).alias("src"), F.expr(normalised("CAST(dst AS STRING)")).alias("dst")))
    classes = connected_components(edges)
    keyed = pages.select("page_id", F.expr(normalised("CAST(url AS STRING)")).alias("url_key"))
    # Addresses that only edges name may be blocked, too.
    ruled = materialize(_ruled(keyed.select(F.col("url_key").alias("address")).unionByName(classes.select(F.col("node").alias("address"))), rules), "ruled-addresses")
    hit = classes.join(ruled.where("blocked"), classes["node"] == ruled["address"], "left_semi").select("component").distinct()
    tainted = classes.join(hit, "component", "left_semi").select(F.col("node").alias("address"), F.lit(True).alias("blocked"), F.lit(False).alias("allowed"))
    said = ruled.unionByName(tainted).groupBy("address").agg(F.max("blocked").alias("blocked"), F.max("allowed").alias("allowed"))
    joined = keyed.join(said, keyed["url_key"] == said["address"], "left")
    return joined.select("page_id", "url_key", F.expr("CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' ELSE 'pass' END").alias("decision"))


def _holds(key: str, decision: str) -> str:
    """DuckDB SQL: whether one of RULES with this decision holds for an address."""
    host = f"regexp_extract({key}, '^[^/?]*', 0)"
    tests = []
    for rule, what in RULES:
        if what == decision:
            name = rule.removeprefix("=").removesuffix(".*").replace(".", "[.]")
            before = "^" if rule.startswith("=") else "(^|[.])"
            tests.append(f"regexp_matches({host}, '{before}{name}{'([.]|$)' if rule.endswith('.*') else '$'}')")
    return "(" + " OR ".join(tests) + ")"


def decide_sql() -> str:
    """DuckDB SQL for the query over a table ``pages``; of links it takes a page's first of each kind, if absolute or from the root."""
    link = f"regexp_extract(html, '{_CANONICAL.replace(chr(39), chr(39) * 2)}', 0)"
    meta = f"regexp_extract(html, '{_REFRESH.replace(chr(39), chr(39) * 2)}', 0)"
    value = r"""=["'']?([^"''\s>]+)"""
    service = "regexp_replace(url, '^(https?://)(m|blog)[.]', '\\1', 'i')"
    return rf"""
WITH RECURSIVE t AS (SELECT url, unnest([regexp_extract({link}, '(?i)href{value}', 1), regexp_extract({meta}, '(?i)url{value}', 1)]) AS target FROM pages WHERE url IS NOT NULL),
f AS (SELECT url, CASE WHEN starts_with(target, '//') THEN 'http:' || target
                       WHEN starts_with(target, '/') THEN regexp_extract(url, '^([A-Za-z]+://)?[^/?#]*', 0) || target ELSE target END AS target FROM t WHERE target <> ''
      UNION ALL SELECT url, {service} FROM pages WHERE url <> {service}),
e AS (SELECT {normalised('url', True)} AS src, {normalised('target', True)} AS dst FROM f WHERE regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://')),
b AS (SELECT src AS u, dst AS v FROM e UNION SELECT dst, src FROM e),
bad AS (SELECT u AS node FROM b WHERE {_holds('u', 'block')} UNION SELECT b.v FROM bad JOIN b ON b.u = bad.node),
k AS (SELECT page_id, {normalised('url', True)} AS url_key FROM pages)
SELECT page_id, url_key, CASE WHEN {_holds('url_key', 'allow')} THEN 'allow'
  WHEN url_key IN (SELECT node FROM bad) OR {_holds('url_key', 'block')} THEN 'block' ELSE 'pass' END AS decision FROM k
"""
