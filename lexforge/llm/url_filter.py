"""URL filter: a trie over reversed host labels and path segments."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import BROADCAST_BYTES

#: (entry, action): a host, which also stands for its subdomains, with the first segments of a path or without.
RULES: tuple[tuple[str, str], ...] = (
    ("cheap-pills.example.com", "block"),
    ("cheap-pills.example.com/de", "allow"),
    ("www.cheap-pills.example.com/de", "block"),
    ("spam-farm.example.org", "block"),
    ("spam-farm.example.org/en", "allow"),
    ("blog.example.net", "block"),
    ("casino.example.com", "block"),
    ("malware.example.net", "block"),
    ("phishing.example.org", "block"),
    ("adult.example.com", "block"),
    ("tracker.example.net", "block"),
    ("mirror.example.org", "block"),
    ("example.com/admin", "block"),
    ("example.net/tmp", "block"),
    ("example.org/private", "block"),
    ("blog.ththan.example.net", "block"),
    ("blog.ththan.example.net/en/369", "allow"),
    ("ththan.example.net", "allow"),
)

_URL = re.compile(r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^?#]*)")


def split(url: str | None) -> tuple[str, list[str]]:
    """Host, in lower case and without user, port and final dot, and the segments of the path; no host, no match."""
    found = _URL.match(url or "")
    if not found:
        return "", []
    host = re.sub(r":[0-9]*$", "", found[1].rpartition("@")[2].lower()).rstrip(".")
    return host, [s for s in found[2].split("/") if s]


def normal(rules: Iterable[tuple[str, str]]) -> dict[tuple[str, str], str]:
    """Actions by host and path; of an entry with both actions, allow holds."""
    out: dict[tuple[str, str], str] = {}
    for entry, action in rules:
        if action not in ("allow", "block"):
            raise ValueError(f"unknown action {action!r}")
        entry = re.sub(r"^\*\.", "", re.sub(r"^[A-Za-z][A-Za-z0-9+.\-]*://", "", entry))
        host, segments = split("x://" + entry)
        if host:
            key = host, "/".join(segments)
            out[key] = "allow" if "allow" in (action, out.get(key)) else action
    return out


_PATH, _ENTRY = "/", ""  # keys that are no host label and no segment


def trie(rules: dict[tuple[str, str], str]) -> dict:
    root: dict = {}
    for (host, path), action in rules.items():
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault(_PATH, {})
        for segment in path.split("/") if path else ():
            node = node.setdefault(segment, {})
        node[_ENTRY] = (action, host + ("/" + path if path else ""))
    return root


def match(root: dict, host: str, segments: list[str]) -> tuple[str, str] | None:
    """Action and entry of the longest match: the entry of most host labels, among those of most segments."""
    best = None
    node = root
    for label in reversed(host.split(".")) if host else ():
        node = node.get(label)
        if node is None or not label:
            break
        path = node.get(_PATH)
        if path is not None:
            best = path.get(_ENTRY, best)
            for segment in segments:
                path = path.get(segment)
                if path is None:
                    break
                best = path.get(_ENTRY, best)
    return best


def filtered(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES) -> DataFrame:
    """Decision on every page: page_id, url, action (allow or block) and rule, the entry that decided, null if none did.

    More host labels go before more path segments. A URL that no entry
    matches, a null one and one without a host are allowed. Repeated rows are
    decided each; a null ``page_id`` is kept; an empty table gives an empty
    result; other columns are ignored. Without rules everything is allowed.

    The trie is broadcast; rules beyond ``BROADCAST_BYTES`` are joined instead
    (:func:`filtered_by_join`), with the same result.
    """
    rules = normal(rules)
    if 200 * len(rules) + sum(len(h) + len(p) for h, p in rules) > BROADCAST_BYTES:
        return filtered_by_join(pages, rules)
    shared = pages.sparkSession.sparkContext.broadcast(trie(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = shared.value
        for batch in batches:
            found = [match(root, *split(u)) or ("allow", None) for u in batch.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())], ["page_id", "url", "action", "rule"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(run, "page_id long, url string, action string, rule string")


def host_of(url: Column) -> Column:
    """The host as :func:`split` has it; empty if there is none."""
    host = F.lower(F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), r"^.*@", ""))
    return F.coalesce(F.regexp_replace(F.regexp_replace(host, r":[0-9]*$", ""), r"\.+$", ""), F.lit(""))


def filtered_by_join(pages: DataFrame, rules: dict[tuple[str, str], str]) -> DataFrame:
    """The same decisions by an equi-join of every page's host suffixes and path prefixes with the rules."""
    spark = pages.sparkSession
    table = spark.createDataFrame([(h, p, a) for (h, p), a in rules.items()], "rule_host string, rule_path string, rule_action string")
    urls = pages.select(F.col("url").cast("string").alias("url")).distinct().where("url is not null")
    labels, segments = F.split(host_of(F.col("url")), r"\."), F.filter(F.split(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), "/"), lambda s: s != "")
    urls = urls.select("url", labels.alias("labels"), segments.alias("segments"))
    keys = urls.select("url", F.explode(F.expr("sequence(1, size(labels))")).alias("i"), "labels", "segments").select("url", F.expr("array_join(slice(labels, i, size(labels) - i + 1), '.')").alias("rule_host"), (F.size("labels") - F.col("i") + 1).alias("wide"), F.explode(F.expr("sequence(0, size(segments))")).alias("deep"), "segments")
    keys = keys.withColumn("rule_path", F.expr("array_join(slice(segments, 1, deep), '/')"))
    entry = F.when(F.col("rule_path") == "", F.col("rule_host")).otherwise(F.concat_ws("/", "rule_host", "rule_path"))
    best = keys.join(table, ["rule_host", "rule_path"]).groupBy("url").agg(F.max(F.struct("wide", "deep", F.col("rule_action").alias("action"), entry.alias("rule"))).alias("m"))
    out = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).join(best, "url", "left")
    return out.select("page_id", "url", F.coalesce("m.action", F.lit("allow")).alias("action"), F.col("m.rule").alias("rule"))


def url_sql(rules: Iterable[tuple[str, str]] = RULES) -> str:
    values = ", ".join(f"('{h}', '{p}', '{a}')" for (h, p), a in normal(rules).items())
    return rf"""
WITH rules(h, p, a) AS (VALUES {values}),
page AS (SELECT DISTINCT url, rtrim(regexp_replace(lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', '')), ':[0-9]*$', ''), '.') AS host,
  '/' || array_to_string(list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> ''), '/') || '/' AS path FROM pages WHERE url IS NOT NULL),
hit AS (SELECT url, a, h || CASE WHEN p = '' THEN '' ELSE '/' || p END AS rule,
  row_number() OVER (PARTITION BY url ORDER BY len(string_split(h, '.')) DESC, CASE WHEN p = '' THEN 0 ELSE len(string_split(p, '/')) END DESC) AS r
  FROM page JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND (p = '' OR starts_with(path, '/' || p || '/')))
SELECT page_id, pages.url AS url, coalesce(a, 'allow') AS action, rule FROM pages LEFT JOIN (SELECT * FROM hit WHERE r = 1) hit ON pages.url = hit.url"""
