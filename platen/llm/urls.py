"""Allow and block rules on URLs: a trie over reversed host labels and path segments, longest match first."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platen.llm.common import LOWER, UPPER


def split_urls(pages: DataFrame) -> DataFrame:
    """(page_id, host, path). Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: then up to ?, # or the end; both empty without ://."""
    part = lambda pattern: F.coalesce(F.regexp_extract("url", pattern, 1), F.lit(""))
    return pages.select("page_id", F.translate(part(r"(?s)^.*?://([^/?#]*)"), UPPER, LOWER).alias("host"), part(r"(?s)^.*?://[^/?#]*([^?#]*)").alias("path"))


@dataclass
class Node:
    """A host label or a path segment. tails: rules that end within the next segment, by the part of it they ask for."""

    below: dict[str, Node] = field(default_factory=dict)
    paths: Node | None = None
    tails: dict[str, tuple[str, str]] = field(default_factory=dict)


def build(rules: list[tuple[str, str, str]]) -> Node:
    """Rules (host, path, allow or block) to a trie; of a rule that is given both ways, block holds."""
    root = Node()
    for host, path, verdict in rules:
        node = root
        for label in reversed(host.split(".")) if host else ():
            node = node.below.setdefault(label, Node())
        node.paths = at = node.paths or Node()
        *whole, tail = path.split("/")
        for segment in whole:
            at = at.below.setdefault(segment, Node())
        if at.tails.get(tail, ("", "allow"))[1] != "block":
            at.tails[tail] = (host + path, verdict)
    return root


def _in_path(node: Node, path: str) -> tuple[str, str] | None:
    """The longest rule of a path trie that the path starts with."""
    best, segments = None, path.split("/")
    for depth, segment in enumerate(segments):
        for n in range(len(segment), -1, -1) if len(node.tails) > len(segment) else sorted((len(t) for t in node.tails), reverse=True):
            if n <= len(segment) and (found := node.tails.get(segment[:n])):
                best = found
                break
        if depth + 1 == len(segments) or not (node := node.below.get(segment)):
            return best
    return best


def match(root: Node, host: str, path: str) -> tuple[str, str] | None:
    """The longest rule (host and path together; then the longer host) that fits, and its verdict."""
    best, node = None, root
    for label in [None, *(reversed(host.split(".")) if host else ())]:
        if label is not None and not (node := node.below.get(label)):
            return best
        if node.paths and (found := _in_path(node.paths, path)) and (best is None or len(found[0]) >= len(best[0])):
            best = found
    return best


def _joined(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The same by a join, for rules beyond the bound of the broadcast: on host suffix and whole leading path segments."""
    rules = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
    rules = rules.withColumn("r_lead", F.expr("substring(r_path, 1, length(r_path) - length(substring_index(r_path, '/', -1)))"))
    labels = F.split("host", r"\.")
    suffixes = F.when(F.col("host") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))))
    parts = F.split("path", "/")
    leads = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))))
    spread = urls.distinct().withColumn("r_host", F.explode(suffixes)).withColumn("r_lead", F.explode(leads))
    fits = spread.join(rules, ["r_host", "r_lead"]).where(F.col("path").startswith(F.col("r_path")))
    name = F.concat("r_host", "r_path")
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct(name.alias("rule"), F.col("r_verdict").alias("verdict")), F.struct(F.length(name), F.length("r_host"), F.col("r_verdict") == "block")).alias("best"))
    return best.select("host", "path", "best.rule", "best.verdict")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", max_rules: int = 500_000) -> DataFrame:
    """A row for each row of pages (page_id, url): page_id, host, path, rule, verdict.

    rules: (host, path, verdict), verdict allow or block. A rule fits its host and all subdomains if the url's path starts with the
    rule's; the longest rule wins. Without one, rule is null and the verdict is the default. A null url or one
    without :// has an empty host and path. A trie of up to max_rules rules is broadcast; more are joined.
    Rules with a null are passed over; repeated rows stay; other columns are ignored.
    """
    urls = split_urls(pages)
    clean = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").where("host is not null and path is not null and verdict in ('allow', 'block')").distinct()
    given = clean.limit(max_rules + 1).collect()
    if len(given) > max_rules:
        found = _joined(urls.select("host", "path"), clean)
        return urls.join(found, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
    trie = pages.sparkSession.sparkContext.broadcast(build([tuple(r) for r in given]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = trie.value
        for batch in batches:
            found = [match(root, h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f and f[0] for f in found], pa.string()), pa.array([f[1] if f else default for f in found], pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    page_type = dict(urls.dtypes)["page_id"]
    return urls.mapInArrow(run, f"page_id {page_type}, host string, path string, rule string, verdict string")
