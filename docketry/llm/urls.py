"""URL filter: rules first, then a blocked Bloom filter of listed canonical URLs before an exact hash join.

An entry of the list is a canonical URL ``host/path``; it lists the URLs that it equals or is a directory of, on its host
and all subdomains. So a URL is looked up under its host's suffixes with its path's prefixes, of the numbers of labels and
directories that entries have (``depths``), hashed as they grow: work and memory follow the length of the URL, and no strings are made but of keys that pass.
The filter is a split-block Bloom filter: a key sets one bit in each of the eight 64-bit words of one block. It is built by
``bit_or`` on the executors and broadcast. A list whose filter is larger than ``max_filter_bytes`` is dealt out by hash into as many
filters as it takes, which are built, broadcast, applied and destroyed one after another. The keys that pass go to an exact join
with the list, which removes the false positives; what is left is joined to the pages by id and url.

Edge cases: a null url or one without ``://`` has empty host and path, fits no rule and no entry, and is allowed; repeated rows are
judged each; null ids take part; an empty list or table works; null and empty entries are left out; a host or path of any length is looked up; extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import cut, map_batches, read, tag_column, tag_of

#: (rule, verdict): host and path, the longest that fits wins.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Sites of the block list that the query uses.
LISTED_SITES = ("ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets")
LISTED_UNDER = ("example.com", "example.net", "example.org")
_AUTHORITY = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_UPPER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path after the first ``://``."""
    m = _AUTHORITY.search(url) if url else None
    return (m[1].translate(_UPPER), m[2]) if m else ("", "")


def canonical(host: str, path: str) -> str:
    """Host without user, port, and trailing dots; path without repeated or trailing slashes."""
    host = host.rpartition("@")[2].partition(":")[0].strip(".")
    return f"{host}/{'/'.join(p for p in path.split('/') if p)}".rstrip("/") + "/" if host else ""


def lookups(key: str, depths: dict[int, list[int]]) -> Iterator[tuple[int, int, int]]:
    """Hash (XXH64, seed 42), labels and directories of the entries that would list a canonical URL.

    ``depths``: ascending numbers of directories by number of labels.
    """
    host, slash, path = key.partition("/")
    if not slash:
        return
    starts = [m.end() for m in re.finditer(r"\.", host)]  # of labels but the first
    ends = [0, *(m.end() for m in re.finditer("/", path))]
    for labels, many in depths.items():
        if labels > len(starts) + 1:
            continue
        suffix = host if labels == len(starts) + 1 else host[starts[-labels] :]
        state, at = xxhash.xxh64(f"{suffix}/".encode(), 42), 0
        for n in many:
            if n >= len(ends):
                break
            state.update(path[at : ends[n]].encode())
            at = ends[n]
            yield state.intdigest(), labels, n


def entry(key: str, labels: int, directories: int) -> str:
    """The entry that ``lookups`` tells by numbers."""
    host, _, path = key.partition("/")
    return ".".join(host.split(".")[-labels:]) + "/" + "".join(f"{p}/" for p in path.split("/")[:directories])


def rule_for(host: str, path: str, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[str | None, str | None]:
    """The longest rule that fits, and its verdict."""
    best: tuple[str | None, str | None] = (None, None)
    for rule, verdict in rules:
        at, start = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == at or host.endswith("." + at)) and path.startswith(start) and len(rule) > len(best[0] or ""):
            best = rule, verdict
    return best


def listed_keys(entries: DataFrame) -> DataFrame:
    """Distinct canonical keys of ``entries(url)``; entries may lack a scheme."""

    def run(batch: pa.RecordBatch):
        urls = [u for u in batch.column("url").to_pylist() if u]
        keys = [canonical(*split_url(u if "://" in u else "://" + u)) for u in urls]
        yield pa.RecordBatch.from_arrays([pa.array([k for k in keys if k], pa.string())], ["key"])

    return map_batches(entries.select("url"), run, "key string").distinct()


def judge(
    pages: DataFrame, entries: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, max_filter_bytes: int = 64 << 20
) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages(page_id, url)``."""
    sc, rows = pages.sparkSession.sparkContext, pages.select(F.col("page_id").cast("long"), "url")

    listed = cut(listed_keys(entries))
    labels = F.regexp_count(F.substring_index("key", "/", 1), F.lit(r"\.")) + 1
    depths: dict[int, list[int]] = {}
    for r in listed.select(labels.alias("labels"), (F.regexp_count("key", F.lit("/")) - 1).alias("n")).distinct().orderBy("labels", "n").collect():
        depths.setdefault(r["labels"], []).append(r["n"])  # pairs of small numbers: a few, whatever the length of the list
    n = listed.count()
    shards = max(1, -(-n * bloom.BITS_PER_KEY // (8 * max(64, max_filter_bytes))))
    hashes, passed = listed.select(F.xxhash64("key").alias("h")), None  # XXH64 with seed 42
    for shard in range(shards):
        own = hashes.filter(F.pmod("h", F.lit(shards)) == shard)
        known = sc.broadcast(bloom.build(own, bloom.blocks_for(own.count(), 2 * max(64, max_filter_bytes))[0]))  # a shard is about as large as told

        def possible(batch: pa.RecordBatch, known=known, shard=shard):
            found = []
            for page, url in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), strict=True):
                host, path = split_url(url)
                if not host or rule_for(host, path, rules)[1]:
                    continue
                key = canonical(host, path)
                keys = [x for x in lookups(key, depths) if ((x[0] ^ 1 << 63) - (1 << 63)) % shards == shard]  # as pmod of the signed hash
                passes = known.value.might_contain(np.array([h for h, _, _ in keys], np.uint64))
                found += [(page, tag_of(url.encode()), entry(key, *keys[i][1:])) for i in np.flatnonzero(passes)]
            kinds = (pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)], ["page", "tag", "k"])

        part = cut(map_batches(rows, possible, "page long, tag long, k string"))
        known.destroy()
        passed = part if passed is None else passed.unionByName(part)
    hits = passed.join(listed.select("key"), F.col("k") == F.col("key")).select("page", "tag").distinct()

    def parts(batch: pa.RecordBatch):
        urls = batch.column("url").to_pylist()
        split = [split_url(u) for u in urls]
        fits = [rule_for(h, p, rules) for h, p in split]
        columns = [pa.array(list(x), pa.string()) for x in ([h for h, _ in split], [p for _, p in split], [r for r, _ in fits], [v for _, v in fits])]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("t"), *columns], names)

    names = ["page_id", "t", "host", "path", "rule", "ruled"]
    judged = map_batches(rows.withColumn("t", tag_column(F.col("url"))), parts, "page_id long, t long, host string, path string, rule string, ruled string")
    both = judged.join(hits, F.col("page_id").eqNullSafe(F.col("page")) & (F.col("t") == F.col("tag")), "left")
    verdict = F.coalesce("ruled", F.when(F.col("tag").isNotNull(), "block").otherwise("allow"))
    return both.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page by the rules, else by the list of ``LISTED_SITES`` under ``LISTED_UNDER``."""
    entries = spark.createDataFrame([(f"{site}.{under}/",) for site in LISTED_SITES for under in LISTED_UNDER], "url string")
    return judge(read(spark, sf_dir, "pages"), entries)


_LISTED = " OR ".join(f"host = '{s}.{u}' OR ends_with(host, '.{s}.{u}')" for s in LISTED_SITES for u in LISTED_UNDER)
SQL = rf"""
WITH p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id,
        translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT *, CASE
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM q)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN {_LISTED} THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
