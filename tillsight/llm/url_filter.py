"""URL filters: a trie over reversed host labels and path segments, broadcast to the tasks; the
longest fitting entry decides between allow and block. Rule tables beyond a fixed size are not
broadcast: they are joined by the hosts and path prefixes that a url has."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import MAX_BROADCAST_BYTES, ascii_lower

_MOST_RULES = MAX_BROADCAST_BYTES // 256
ALLOW, BLOCK = "allow", "block"


def url_parts(url: str):
    """(host, path): host after the first :// up to / ? # or end, A-Z lower-cased; path from there up
    to ? # or end. Null urls and urls without :// have both empty."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def build_trie(rules) -> dict:
    """Nested dicts: host labels from the last to the first, then under "" the path's segments; an
    entry stands at the node before its last segment, by what that segment must start with."""
    root: dict = {}
    for verdict, host, path in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault(None, {})       # paths of this host
        *whole, last = path.split("/")
        for segment in whole:
            node = node.setdefault(segment, {})
        ends = node.setdefault(None, {})
        if ends.get(last, ("", ""))[0] != BLOCK:    # the same entry twice: block wins
            ends[last] = (verdict, host + path)
    return root


def _path_match(node: dict, segments: list[str]):
    best = None
    for i, segment in enumerate(segments):
        fits = [(len(s), e) for s, e in node.get(None, {}).items() if segment.startswith(s)]
        best = max(fits)[1] if fits else best
        node = node.get(segment) if i + 1 < len(segments) else None
        if node is None:
            break
    return best


def longest_match(root: dict, host: str, path: str):
    """(verdict, rule) of the fitting entry with the longest host, then the longest path; or None."""
    best, node, segments = None, root, path.split("/")
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        if None in node:
            best = _path_match(node[None], segments) or best
    return best


def filter_urls(pages: DataFrame, rules, default: str = ALLOW, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (text of the deciding entry, or null), verdict.

    ``rules``: (verdict, host, path prefix) as a list, or a DataFrame verdict, host, path. An entry fits
    its host and all subdomains of it whose path starts with its path; longer hosts win over shorter
    ones and then longer paths; of equal entries block wins. Null urls and urls without :// have
    empty parts, fit nothing and get the default. Repeated rows and null ids stay; an empty table
    gives no row; other columns are not read."""
    host, path = url_parts("url")
    parts = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    if isinstance(rules, DataFrame):
        head = rules.select("verdict", "host", "path").limit(_MOST_RULES + 1)
        if head.count() > _MOST_RULES or (head.agg(F.sum(F.length("host") + F.length("path"))).first()[0] or 0) > MAX_BROADCAST_BYTES:
            return _joined(parts, rules, default)
        rules = [tuple(r) for r in head.collect()]
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

    def run(batches):
        root = trie.value
        for batch in batches:
            found = [longest_match(root, h, p) or (default, None)
                     for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c) for c in ("page_id", "host", "path")), pa.array([r for _, r in found], pa.string()),
                pa.array([v for v, _ in found], pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return parts.withColumn("page_id", F.col("page_id").cast("long")).mapInArrow(
        run, "page_id long, host string, path string, rule string, verdict string")


def _joined(parts: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same result with the rules as a table: every distinct (host, path) looks up its host's
    suffixes and its path's prefixes."""
    own = (rules.groupBy("host", "path").agg(F.max("verdict").alias("v"))
           .select(F.col("host").alias("h"), F.col("path").alias("p"), "v"))
    urls = parts.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    asked = (urls.withColumn("i", F.explode(F.sequence(F.lit(1), F.size(labels))))
             .select("host", "path", F.array_join(F.slice(labels, F.col("i"), F.size(labels)), ".").alias("h"))
             .withColumn("k", F.explode(F.sequence(F.lit(0), F.length("path"))))
             .select("host", "path", "h", F.expr("substring(path, 1, k)").alias("p")))
    best = asked.join(own, ["h", "p"]).groupBy("host", "path").agg(
        F.max(F.struct(F.length("h"), F.length("p"), F.concat("h", "p").alias("rule"), "v")).alias("m"))
    return parts.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("m.rule").alias("rule"), F.coalesce("m.v", F.lit(default)).alias("verdict"))


def oracle(rules, default: str = ALLOW) -> str:
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    return f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
p AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
k(verdict, h, q) AS (VALUES {values}),
m AS (SELECT p.page_id, p.host, p.path, k.verdict, k.h || k.q AS rule, row_number() OVER (PARTITION BY p.page_id ORDER BY length(h) DESC, length(q) DESC) AS n
  FROM p LEFT JOIN k ON (p.host = k.h OR ends_with(p.host, '.' || k.h)) AND starts_with(p.path, k.q))
SELECT page_id, host, path, rule, coalesce(verdict, '{default}') AS verdict FROM m WHERE n = 1
"""
