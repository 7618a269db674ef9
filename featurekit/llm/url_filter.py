"""URL filters (operator 1): Bloom filter cascades whose levels by turns encode listed keys and the false positives among
all keys of the corpus, so that a key's membership is exact and no row is joined."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featurekit.llm.common import free_name, materialize

#: Bits of a level for each key beyond what the ratio of the other side's keys asks for; bits of a level at least, so that
#: a wrong guess of that ratio costs a short list nothing.
SPARE_BITS, LEAST_BITS = 4, 1 << 16
#: Bits of a level at most (16 MB, some 6 million listed keys among 10 billion): the driver gathers a level's words, and a
#: plan carries them to every worker.
MOST_BITS = 1 << 27
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def parents(host: Column) -> Column:
    """The host and every domain that it is a subdomain of."""
    labels = F.split(host, r"\.")
    return F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels) - i), "."))


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys that could be a rule for a url: each of its domains followed by the path's first characters, as many as some
    rule's path has. A key of length 0 is the domain alone."""
    fits = F.filter(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"), lambda n: F.length(path) >= n)
    return F.flatten(F.transform(parents(host), lambda d: F.transform(fits, lambda n: F.concat(d, F.substring(path, F.lit(1), n)))))


def _places(key: Column, level: int, bits: int, hashes: int) -> Column:
    return F.array(*(F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits)) for i in range(hashes)))


@dataclass
class Level:
    """A Bloom filter: 64-bit words, and how many bits a key sets."""

    words: np.ndarray
    hashes: int

    def inside(self, key: Column, number: int) -> Column:
        held = F.split(F.lit(",".join(map(str, self.words.tolist()))), ",").cast("array<bigint>")  # folded to one literal
        return F.forall(_places(key, number, 64 * len(self.words), self.hashes), lambda p: F.getbit(F.get(held, F.floor(p / 64).cast("int")), (p % 64).cast("int")) == 1)


@dataclass
class Cascade:
    """A key outside an odd level is not listed, one outside an even level is."""

    levels: list[Level]

    def holds(self, key: Column) -> Column:
        answer = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels), 0, -1):
            answer = F.when(self.levels[k - 1].inside(key, k), answer).otherwise(F.lit(k % 2 == 0))
        return answer


def _encode(keys: DataFrame, n: int, others: int, number: int) -> Level:
    """A level of ``n`` keys that takes about as many of the ``others`` for its own as it has. The rows that reach the
    driver are its words, ``MOST_BITS`` / 64 at most."""
    each = math.ceil(1.44 * math.log2(max(others / max(n, 1), 1))) + SPARE_BITS
    bits = 64 * -(-max(n * each, LEAST_BITS) // 64)
    if bits > MOST_BITS:
        raise ValueError(f"{n} listed keys need a filter of {bits} bits; MOST_BITS allows {MOST_BITS}")
    # As few hashes as keep the taken ones below the listed ones.
    taken = lambda h: (1 - math.exp(-n * h / bits)) ** h * others
    hashes = next((h for h in range(1, max(2, round(0.69 * each))) if taken(h) <= n / 2), max(1, round(0.69 * each)))
    at = keys.select(F.explode(_places(F.col("key"), number, bits, hashes)).alias("p"))
    found = at.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("b"))
    words = np.zeros(bits // 64, np.int64)
    for r in found.collect():
        words[r["w"]] = r["b"]
    return Level(words, hashes)


def build(listed: DataFrame, universe: DataFrame, size: int | None = None) -> Cascade:
    """A cascade that is exact for every key of the universe (both have a column key; null keys are left out).

    The universe is read once, for the keys that the first level takes for listed ones; repeated keys need not be removed
    from it. ``size``: its number of keys, if known; a wrong one costs further levels, never a wrong answer."""
    ours = inside = materialize(listed.filter("key is not null").distinct())
    n = inside.count()
    if not n:
        return Cascade([])
    others, m = None, universe.count() if size is None else size
    levels: list[Level] = []
    while True:
        k = len(levels) + 1
        levels.append(_encode(ours, n, m, k))
        # Of the other side, those that this level takes for ours are what the next one encodes.
        taken = (universe.filter("key is not null") if others is None else others).filter(levels[-1].inside(F.col("key"), k))
        wrong = materialize((taken.select("key").distinct().join(inside, "key", "left_anti") if others is None else taken).select("key"))
        count = wrong.count()
        if not count:
            return Cascade(levels)
        ours, others, n, m = wrong, ours, count, n


def _keys(spark: SparkSession, found: list[str]) -> DataFrame:
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(found)), "array<string>")).alias("key"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], listed_hosts: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to every row.

    rules: (host, path, verdict). A rule fits its host and all its subdomains where the url's path starts with the
    rule's; of several the longest holds, and ``rule`` is its host and path together. Where none fits, ``rule`` is null
    and the verdict is "block" if the host or a domain above it is in ``listed_hosts`` (column key), else ``default``.
    A null url, or one without "://", has an empty host and path, fits no rule, and gets ``default``. Repeated rows and
    rules change nothing; columns of these four names are replaced, all others stay. No page is joined or shuffled; what
    is shuffled to build the cascades are listed keys and the keys that a first level takes for listed. A list whose
    level would exceed ``MOST_BITS`` is an error."""
    spark = pages.sparkSession
    pages = pages.drop("host", "path", "rule", "verdict")
    lengths = sorted({len(p) for _, p, _ in rules})
    fixed, stops = [h + p for h, p, _ in rules], [h + p for h, p, v in rules if v == "block"]
    urls = pages.select(host_of(F.col(url_col)).alias("h"), path_of(F.col(url_col)).alias("p"))
    of_rules = urls.select(F.explode(candidates(F.col("h"), F.col("p"), lengths)).alias("key"))
    of_hosts = urls.select(F.explode(F.concat(parents(F.col("h")), candidates(F.col("h"), F.col("p"), lengths))).alias("key"))
    host, path = free_name(pages, "host"), free_name(pages, "path")
    known = pages.withColumns({host: host_of(F.col(url_col)), path: path_of(F.col(url_col))})
    # A url has a handful of domains; the true number of keys matters by its logarithm only.
    n = pages.count()
    rule_keys = build(_keys(spark, fixed), of_rules, 3 * n * max(len(lengths), 1))
    stop_keys = build(_keys(spark, stops).union(listed_hosts.select("key")), of_hosts, 3 * n * (len(lengths) + 1))
    longest = F.array_max(F.transform(F.filter(candidates(F.col(host), F.col(path), lengths), rule_keys.holds), lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))))["key"]
    known = known.withColumn("rule", longest)
    blocked = F.when(F.col("rule").isNotNull(), stop_keys.holds(F.col("rule"))).otherwise(F.exists(parents(F.col(host)), stop_keys.holds))
    other = F.when(F.col("rule").isNotNull(), "allow").otherwise(default)
    return known.withColumn("verdict", F.when(blocked, "block").otherwise(other))


#: The rules of the query.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Hosts with one of these between dots or hyphens are listed.
TERMS = ["bets", "casino", "pills"]


def listed_hosts(pages: DataFrame, terms: list[str] = TERMS) -> DataFrame:
    """The pages' hosts that have a listed term, once each."""
    return pages.select(host_of(F.col("url")).alias("key")).distinct().filter(F.arrays_overlap(F.split("key", "[.-]"), F.array(*map(F.lit, terms))))


def page_verdicts(pages: DataFrame) -> DataFrame:
    judged = judge(pages.select("page_id", "url"), RULES, listed_hosts(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(rh, rp, rv) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
pairs AS (SELECT host, path, max_by(rh || rp, length(rh || rp)) AS rule, max_by(rv, length(rh || rp)) AS rv FROM (SELECT DISTINCT host, path FROM parts) u JOIN rules ON (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp) GROUP BY host, path)
SELECT page_id, parts.host, parts.path, rule, coalesce(rv, CASE WHEN regexp_matches(parts.host, '(^|[.-])(bets|casino|pills)($|[.-])') THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN pairs ON parts.host = pairs.host AND parts.path = pairs.path
"""
