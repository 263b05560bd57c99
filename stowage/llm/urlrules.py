"""URL rules by a sort-merge range join.

A host becomes a key of its labels in reverse, each followed by a dot, so that a rule for a host
and its subdomains is the interval of keys that begin with the rule's key.  Rules and pages
are sorted together range by range; a sweep keeps the stack of rules whose interval is open, which
are nested, and takes the longest of them whose path fits.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import pick
from stowage.llm.ranges import RANGE_ROWS, first_keys, range_of

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LAST = (1 << 63) - 1

#: A rule: block or allow, host, path.
Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    """Behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """Behind the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """The labels in reverse, each followed by a dot; empty for an empty host."""
    labels = F.array_join(F.reverse(F.split(host, r"\.")), ".")
    return F.when(host == "", F.lit("")).otherwise(F.concat(labels, F.lit(".")))


def _deal(batches, firsts: list[tuple]):
    for batch in batches:
        keys = zip(batch["key"].to_pylist(), batch["tie"].to_pylist(), strict=True)
        ranges = [range_of(firsts, k) for k in keys]
        yield pa.record_batch(
            [pa.array(ranges, pa.int32()), *batch.columns], ["_range", *batch.schema.names]
        )


def _deal_rules(batches, firsts: list[tuple]):
    """A rule goes to every range that its interval touches."""
    for batch in batches:
        take, ranges = [], []
        for i, key in enumerate(batch["key"].to_pylist()):
            end = key[:-1] + "/"  # follows the dot
            first, last = range_of(firsts, (key, -_LAST - 1)), range_of(firsts, (end, -_LAST - 1))
            take += [i] * (last - first + 1)
            ranges += range(first, last + 1)
        dealt = batch.take(pa.array(take, pa.int64()))
        yield pa.record_batch(
            [pa.array(ranges, pa.int32()), *dealt.columns], ["_range", *batch.schema.names]
        )


def _sweep(batches, default: str):
    """Rows sorted by range, key and kind: rules (kind 0) open, pages (kind 1) are judged."""
    at: int | None = None
    stack: list[tuple[str, str, str, str]] = []  # key, path, rule, verdict
    for batch in batches:
        rows = batch.to_pylist()
        out: dict[str, list] = {n: [] for n in ("page_id", "host", "path", "rule", "verdict")}
        for r in rows:
            if r["_range"] != at:
                at, stack = r["_range"], []
            while stack and not r["key"].startswith(stack[-1][0]):
                stack.pop()
            if r["kind"] == 0:
                stack.append((r["key"], r["path"], r["rule"], r["verdict"]))
                continue
            fit = [s for s in stack if r["path"].startswith(s[1])]
            best = max(fit, key=lambda s: (len(s[2]), len(s[0]), s[3] == "block"), default=None)
            out["page_id"].append(r["page_id"])
            out["host"].append(r["host"])
            out["path"].append(r["path"])
            out["rule"].append(best[2] if best else None)
            out["verdict"].append(best[3] if best else default)
        kinds = [pa.int64()] + [pa.string()] * 4
        yield pa.record_batch(
            [pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out)
        )


def judge(
    pages: DataFrame,
    rules: DataFrame,
    key: str = "page_id",
    url: str = "url",
    default: str = "allow",
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Every page's host, path, the longest rule that fits (``host`` + ``path``) and verdict.

    ``rules`` has columns verdict, host, path; a rule fits its host and all subdomains, if the
    path starts with its path.  Of rules of equal length the one with the longer host wins, then
    one that blocks.  A page that no rule fits gets ``default`` and a null rule.  Null urls and
    those without ``://`` have an empty host and path, which no rule fits.  Hosts of any share of
    the rows spread over ranges by a hash of the row; a page without an id and
    repeated rows come back like any others; an empty table gives no rows; without rules
    every page gets the default; other columns are not looked at.  Urls may have any length.
    """
    pages = pick(pages, key, url).toDF("page_id", "url")
    page = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        F.xxhash64("page_id", "url").alias("tie"),
    ).withColumn("key", host_key(F.col("host")))
    firsts = first_keys(page, ["key", "tie"], range_rows) or [("", 0)]

    fields = "_range int, page_id long, host string, path string, tie long, key string"
    dealt = page.mapInArrow(lambda b: _deal(b, firsts), fields)
    rule = pick(rules, "verdict", "host", "path").filter("host <> '' and path is not null").distinct()
    rule = rule.withColumn("key", host_key(F.translate("host", _UPPER, _LOWER)))
    ruled = rule.mapInArrow(
        lambda b: _deal_rules(b, firsts),
        "_range int, verdict string, host string, path string, key string",
    )
    both = dealt.withColumn("kind", F.lit(1)).unionByName(
        ruled.select(
            "_range",
            "key",
            "path",
            "verdict",
            F.concat("host", "path").alias("rule"),
            F.lit(0).alias("kind"),
        ),
        allowMissingColumns=True,
    )
    both = both.repartitionById(len(firsts), F.col("_range")).sortWithinPartitions("_range", "key", "kind")
    found = both.mapInArrow(
        lambda b: _sweep(b, default),
        "page_id long, host string, path string, rule string, verdict string",
    )
    return found.withColumnRenamed("page_id", key)
