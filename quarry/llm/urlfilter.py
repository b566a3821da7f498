"""URL filter: host and path rules, and block decisions that follow redirects.

A rule (host, path, verdict) fits its host and all subdomains where the url's
path starts with the rule's path; the longest rule (host and path) that fits
wins, and of equally long ones an allow. A url without a rule takes the
method's verdict: redirect and canonical-link edges join urls to components,
and a component with a blocked url and no explicitly allowed one is blocked;
everything else is allowed. A url is a node by host, path and query, without
scheme and fragment; an empty path is a node of its own.

Null urls, and urls without ``://``, have an empty host and path; no rule and
no edge touches them. Repeated rows get a row each. Rules are a list (at most
``MAX_RULES``, else an error); a very long url is a string like any other.
"""

from __future__ import annotations

import html
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import base
from quarry.llm.components import connected_components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules travel inside the plan; beyond this many the table of rules should be split by host.
MAX_RULES = 10_000


def host_path(df: DataFrame, url: str) -> DataFrame:
    """Adds _rest, _host and _path."""
    u = F.col(url)
    at = F.locate("://", u)
    df = df.withColumn("_rest", F.coalesce(F.when(at > 0, u.substr(at + 3, F.length(u))), F.lit("")))
    return df.withColumn("_host", F.translate(F.regexp_extract("_rest", r"^[^/?#]*", 0), _UPPER, _LOWER)).withColumn("_path", F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1))


def node() -> Column:
    """Name of the url in _rest, _host and _path as a node; null without host."""
    query = F.regexp_extract("_rest", r"^[^?#]*(\?[^#]*)", 1)
    return F.when(F.col("_host") != "", F.concat("_host", F.lit("//"), "_path", query))  # a host holds no slash


def ruled(df: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds _rule (like ``net/``) and _verdict of the rule, null without one; needs _host and _path."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    if not rules:
        return df.withColumn("_rule", F.lit(None).cast("string")).withColumn("_verdict", F.lit(None).cast("string"))
    by_host: dict[str, list[Column]] = {}
    for host, path, verdict in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"a verdict is allow or block, not {verdict}")
        by_host.setdefault(host, []).append(F.struct(F.lit(len(host + path)).alias("n"), F.lit(verdict == "allow").alias("ok"), F.lit(host + path).alias("rule"), F.lit(path).alias("path")))
    table = F.create_map(*(x for h, r in by_host.items() for x in (F.lit(h), F.array(*r))))
    labels = F.split("_host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    fits = F.flatten(F.transform(tails, lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<struct<n:int,ok:boolean,rule:string,path:string>>"))))
    best = F.array_max(F.filter(fits, lambda r: F.startswith(F.col("_path"), r["path"])))
    df = df.withColumn("_best", best)
    return df.withColumn("_rule", F.col("_best.rule")).withColumn("_verdict", F.when(F.col("_best.ok"), "allow").when(~F.col("_best.ok"), "block")).drop("_best")


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(src, dst): targets with entities decoded, resolved against the page's url; what is no url leads nowhere."""
    for batch in batches:
        src, dst = [], []
        for url, to in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
            try:
                dst.append(urljoin(url, html.unescape(to).strip()))
                src.append(url)
            except ValueError:  # such as an unbalanced bracket in the host
                continue
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(dst, pa.string())], names=["src", "dst"])


def html_edges(pages: DataFrame) -> DataFrame:
    """(src url, dst url) of canonical links and of refresh redirects in ``html``; only pages that hold one go to Python."""
    base.ship(pages.sparkSession)
    tag = r"(?is)<(?:link\b[^>]*\brel\s*=\s*[\"']?canonical\b|meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*>"
    target = r"(?is)(?:\bhref\s*=\s*[\"']?|\burl\s*=\s*[\"']?)([^\"'>\s]+)"
    p = pages.select("url", "html").where("url IS NOT NULL AND html IS NOT NULL AND (contains(lower(html), 'canonical') OR contains(lower(html), 'refresh'))")
    t = p.select("url", F.explode(F.regexp_extract_all("html", F.lit(tag), F.lit(0))).alias("tag")).select("url", F.regexp_extract("tag", target, 1).alias("to"))
    return t.where("to <> ''").mapInArrow(_resolve, "src string, dst string")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], edges: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict of each row of ``pages``; edges(src, dst) are urls that lead to each other."""
    p = ruled(host_path(pages.select(F.col(id_col), F.col(url_col).alias("_url")), "_url"), rules).withColumn("_node", node())
    if edges is not None:
        e = host_path(edges.select("src", "dst"), "src").select(node().alias("n_src"), "dst")
        e = host_path(e, "dst").withColumn("n_dst", node()).select("n_src", "n_dst").where("n_src IS NOT NULL AND n_dst IS NOT NULL")
        e = base.materialize(e.distinct())
        labels = connected_components(e, "n_src", "n_dst")
        # every end of an edge is judged, whether it is a row of pages or not
        named = ruled(labels.withColumn("_host", F.substring_index("node", "/", 1)).withColumn("_path", F.regexp_extract("node", r"^[^/]*//([^?#]*)", 1)), rules)
        said = named.groupBy("component").agg(F.max(F.when(F.col("_verdict") == "block", 1).otherwise(0)).alias("b"), F.max(F.when(F.col("_verdict") == "allow", 1).otherwise(0)).alias("a"))
        blocked = base.materialize(labels.join(said.where("b = 1 AND a = 0"), "component").select(F.col("node").alias("_node"), F.lit("block").alias("_alias")))
        p = p.join(base.small(blocked, (blocked.agg(F.sum(F.length("_node") + 64)).first()[0] or 0)), "_node", "left")
    else:
        p = p.withColumn("_alias", F.lit(None).cast("string"))
    return p.select(id_col, F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.coalesce("_verdict", "_alias", F.lit("allow")).alias("verdict"))
