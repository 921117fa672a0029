"""URL verdicts from a sorted digest array.

Every rule and every blocked host is a string; the 64-bit xxhash keys of all strings
lie sorted in an array, with the full strings behind them, in a file that executors
fetch once and every worker maps.  A URL gives one probe for each suffix of its host
and each path length that a rule has; all probes of a batch are looked up by one
vectorised binary search, and each hit is confirmed against the stored full string, so
a collision can't give a verdict.

The longest rule that fits wins.  Without one, a URL is blocked if its host or a
parent domain is on the block list, or if a label of its host is on the list of
blocked labels, which holds under every domain ending; else it is allowed.

Lists are Python sequences or tables ``(string, verdict)``, ``(host)`` and ``(label)``.
Their size is counted first: up to ``MAX_ENTRIES`` strings of ``MAX_BYTES`` in all they
go into the array, and longer lists meet the same probes in a join on the same keys,
which confirms the same strings.  Both ways return the same rows.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits
no rule and is allowed; a null id stays null; user names and ports stay part of the
host; repeated rows, and rows that repeat an id with another url, are judged one by
one; null entries of a list are left out; of equal rules with two verdicts, block
counts; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bounded, map_rows, struct_of
from tidemark.llm.mapped import DigestArray, mapped, share

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: The method's own list: hosts that are blocked, with their subdomains, where no rule fits.
BLOCKED_HOSTS = ()
#: Host labels that are blocked under every domain ending, where no rule fits.
BLOCKED_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
#: What marks a host's and a label's probe; no rule begins with a slash.
HOST, LABEL = "/host:", "/label:"
MAX_ENTRIES, MAX_BYTES = 1_000_000, 64 << 20
ALLOW, BLOCK = 0, 1
VERDICTS = ("allow", "block")

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) as the contract cuts them."""
    if not url or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    stop = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    rest = rest[:stop]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def suffixes(host: str) -> list[str]:
    """A host and its parent domains, the longest first."""
    out = [host] if host else []
    at = host.find(".")
    while at >= 0:
        if host[at + 1 :]:
            out.append(host[at + 1 :])
        at = host.find(".", at + 1)
    return out


def probes_of(host: str, path: str, lengths: list[int]) -> list[str]:
    """Rule strings that could fit, the longest first, the host's own probes, and its labels'."""
    names = suffixes(host)
    rules = {n + path[:k] for n in names for k in lengths if k <= len(path)}
    return sorted(rules, key=lambda x: (-len(x), x)) + [HOST + n for n in names] + [LABEL + x for x in dict.fromkeys(host.split(".")) if x]


def lower(text):
    """A-Z lower-cased."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


Listed = DataFrame | Sequence


def _table(spark: SparkSession, given: Listed, columns: list[str]) -> DataFrame:
    if isinstance(given, DataFrame):
        return given.select(*(F.col(a).cast("string").alias(b) for a, b in zip(given.columns, columns, strict=False)))
    rows = [(x,) if isinstance(x, str) else tuple(x) for x in given]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))


def entries_of(spark: SparkSession, rules: Listed = RULES, blocked: Listed = BLOCKED_HOSTS, labels: Listed = BLOCKED_LABELS) -> tuple[DataFrame, list[int]]:
    """``(string, value)`` of all lists, and the lengths of the rules' paths."""
    cut = _table(spark, rules, ["rule", "verdict"]).where("rule is not null and verdict is not null")
    # a rule's host ends at its first slash
    slash = F.expr("instr(rule, '/')")
    host = F.when(slash > 0, F.expr("substring(rule, 1, instr(rule, '/') - 1)")).otherwise(F.col("rule"))
    path = F.when(slash > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise(F.lit(""))
    cut = cut.select(lower(host).alias("host"), path.alias("path"), F.when(F.col("verdict") == "block", BLOCK).otherwise(ALLOW).alias("value"))
    # as many as rules have different lengths
    lengths = sorted((r["n"] for r in cut.select(F.length("path").alias("n")).distinct().collect()), reverse=True)
    parts = [cut.select(F.concat("host", "path").alias("string"), "value")]
    for mark, given in ((HOST, blocked), (LABEL, labels)):
        parts.append(_table(spark, given, ["name"]).where("name is not null and name != ''").select(F.concat(F.lit(mark), lower(F.col("name"))).alias("string"), F.lit(BLOCK).alias("value")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("string").agg(F.max("value").alias("value")), lengths


VERDICT = struct_of("page_id long, url string, host string, path string, rule string, verdict string")


def _judged(urls: list[str | None], lengths: list[int], find) -> list[list]:
    """Hosts, paths, rules and verdicts; ``find`` gives each probe's value, or -1."""
    cut = [split_url(u) for u in urls]
    probes, owner = [], []
    for i, (host, path) in enumerate(cut):
        own = probes_of(host, path, lengths)
        probes += own
        owner += [i] * len(own)
    rule, verdict = [None] * len(cut), ["allow"] * len(cut)
    for i, probe, value in zip(owner, probes, find(probes), strict=True):
        if value < 0 or rule[i] is not None:
            continue
        verdict[i] = VERDICTS[value]
        if not probe.startswith((HOST, LABEL)):
            rule[i] = probe
    return [[h for h, _ in cut], [p for _, p in cut], rule, verdict]


def verdicts(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: Listed = RULES, blocked: Listed = BLOCKED_HOSTS, labels: Listed = BLOCKED_LABELS) -> DataFrame:
    """``(page_id, url, host, path, rule, verdict)`` of every row; without a shuffle for lists that fit the array."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    entries, lengths = entries_of(spark, rules, blocked, labels)
    size = entries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("string")), F.lit(0)).alias("bytes")).first()
    if size["n"] > MAX_ENTRIES or size["bytes"] > MAX_BYTES:
        return _joined(rows, entries, lengths)
    # at most MAX_ENTRIES strings of MAX_BYTES in all
    name = share(spark, DigestArray.arrays((r["string"].encode("utf-8", "surrogatepass"), r["value"]) for r in entries.toLocalIterator()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(mapped(name))
        for batch in bounded(batches, "url"):
            found = _judged(batch.column("url").to_pylist(), lengths, lambda probes: array.find([p.encode("utf-8", "surrogatepass") for p in probes]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *(pa.array(x, pa.string()) for x in found)], names=VERDICT.names)

    return rows.mapInArrow(run, VERDICT)


def _joined(rows: DataFrame, entries: DataFrame, lengths: list[int]) -> DataFrame:
    """As ``verdicts``, for lists of any size: distinct urls give probes, which meet the strings on their keys."""

    def probe(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for url in batch.column("url").to_pylist():
            host, path = split_url(url)
            out += [(url, host, path, i, p) for i, p in enumerate([*probes_of(host, path, lengths), ""])]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()), strict=True)], names=["url", "host", "path", "turn", "string"])

    # the empty probe, last in turn, keeps every url
    probes = map_rows(rows.select("url").distinct(), probe, struct_of("url string, host string, path string, turn int, string string")).withColumn("key", F.xxhash64("string"))
    listed = entries.select(F.xxhash64("string").alias("key"), F.col("string").alias("listed"), "value")
    met = probes.join(listed, (probes["key"] == listed["key"]) & (F.col("string") == F.col("listed")), "left").where("value is not null or string = ''")
    first = met.groupBy("url", "host", "path").agg(F.min(F.struct("turn", "string", "value")).alias("x"))
    is_rule = F.col("x.value").isNotNull() & ~F.col("x.string").startswith(HOST) & ~F.col("x.string").startswith(LABEL)
    judged = first.select(F.col("url").alias("of"), "host", "path", F.when(is_rule, F.col("x.string")).alias("rule"), F.when(F.col("x.value") == BLOCK, "block").otherwise("allow").alias("verdict"))
    return rows.join(judged, F.col("url").eqNullSafe(F.col("of")), "left").select("page_id", "url", "host", "path", "rule", "verdict")


ORACLE_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^([^?#]*)', 1) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id, translate(CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, 1, strpos(rest, '/') - 1) ELSE rest END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM u
), r(h, p, v) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), b(x) AS (
  VALUES ('ads-track'), ('adult-x'), ('casino-win'), ('cheap-pills'), ('free-bets'), ('spam-farm')
), f AS (
  SELECT page_id, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.v, length(r.h || r.p)) AS v
  FROM s JOIN r ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p) GROUP BY page_id
), m AS (
  SELECT DISTINCT page_id FROM s JOIN b ON list_contains(string_split(host, '.'), b.x)
)
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.v, CASE WHEN m.page_id IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM s LEFT JOIN f USING (page_id) LEFT JOIN m USING (page_id)
"""
