"""URL filtering by host and path rules, matched through hashed host-suffix and path-prefix expressions.

A URL's host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; its path follows up
to ``?``, ``#`` or the end. Without ``://``, and for a null URL, both are empty. A rule fits its host and all subdomains
of it if the path starts with the rule's path. The longest rule that fits decides (of equally long ones the longer host;
of the same rule twice, block); a URL that none fits is allowed.

Each URL is expanded into the expressions that some rule could equal: suffixes of as many labels and path prefixes of as
many characters as the rules have. Expressions meet the rules in an equi-join on the first 8 hex digits of their
SHA-256, and a pair counts if the whole digests agree. What is expanded are the distinct (host, path head) pairs, so a
host that holds a third of all pages is expanded once per head; the verdicts, ``SALT`` times each, then join the pages
on that pair and a salt. Nothing is broadcast by hint. Repeated pages, null ids and other columns are no matter.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

PREFIX = 8
#: In how many parts the pages of one host and path head are dealt out.
SALT = 32


def host_of(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def _lower(host: Column) -> Column:
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def judged(pages: DataFrame, rules: DataFrame, carried: list[str]) -> DataFrame:
    """The carried columns of every page, and host, path, rule (null if none fits) and verdict.

    ``pages`` has ``url``; ``rules`` has host, path and verdict (allow or block), rows with a null host or path apart.
    """
    rules = (rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull())
             .groupBy(_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path"))
             .agg(F.max("verdict").alias("r_verdict"))  # block is after allow
             .withColumn("rule", F.concat("r_host", "r_path"))
             .withColumn("r_digest", F.sha2("rule", 256)).withColumn("short", F.substring("r_digest", 1, PREFIX)))
    labels = F.size(F.split("r_host", r"\."))
    # How many labels and characters the rules have: a few numbers, whatever the number of rules.
    shapes = rules.select(labels.alias("n"), F.length("r_path").alias("m")).distinct().collect()
    head = max((s.m for s in shapes), default=0)
    rows = pages.select(*[F.col(c).alias(f"c_{i}") for i, c in enumerate(carried)], host_of(F.col("url")).alias("host"),
                        path_of(F.col("url")).alias("path"), F.pmod(F.xxhash64(*carried, "url"), F.lit(SALT)).alias("salt"))
    rows = rows.withColumn("head", F.substring("path", 1, head))
    places = rows.select("host", "head").distinct()
    fitting = F.array(*[
        F.when((F.size(F.split("host", r"\.")) >= s.n) & (F.length("head") >= s.m),
               F.concat(F.substring_index("host", ".", -s.n), F.substring("head", 1, s.m)))
        for s in shapes]) if shapes else F.array().cast("array<string>")
    asked = (places.select("host", "head", F.explode(F.array_compact(fitting)).alias("expression"))
             .withColumn("digest", F.sha2("expression", 256)).withColumn("short", F.substring("digest", 1, PREFIX)))
    verdicts = (asked.join(rules, "short").filter("digest = r_digest")
                .groupBy("host", "head")
                .agg(F.max(F.struct(F.length("rule"), F.length("r_host"), "rule", "r_verdict")).alias("best"))
                .select("host", "head", "best.rule", "best.r_verdict",
                        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint"))).alias("salt")))
    return rows.join(verdicts, ["host", "head", "salt"], "left").select(
        *[F.col(f"c_{i}").alias(c) for i, c in enumerate(carried)], "host", "path", "rule",
        F.coalesce("r_verdict", F.lit("allow")).alias("verdict"))
