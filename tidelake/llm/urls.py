"""URL filters: allow and block rules on hosts and path prefixes, looked up by hashes of a URL's expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hex digits of a digest that the join uses; the whole digests are compared after it.
SHORT = 8
#: Bytes of rules to be broadcast at most; more of them are shuffled.
RULES_BYTES = 16 << 20


def rules(spark: SparkSession, listed: list[tuple[str, str]]) -> DataFrame:
    """(verdict, rule): rules as text, host first, then the path prefix from its first slash on."""
    return spark.createDataFrame(listed, "verdict string, rule string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path of a URL; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3)))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    big, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, big, small), F.lit("")), F.coalesce(path, F.lit(""))


def judge(pages: DataFrame, listed: DataFrame, default: str = "allow", into: tuple[str, str, str, str] = ("__host", "__path", "__rule", "__verdict")) -> DataFrame:
    """``pages`` with the URL's host and path, the rule that decides and its verdict, in columns named by ``into``.

    A rule fits its host and all subdomains if the URL's path starts with the rule's path; a rule without a slash fits
    any path, the empty one too. Of the rules that fit, the longest wins, the host's part and the path's counted
    together; of equally long ones that with the longer host, and of two equal rules a block. Where none fits, rule is
    null and the verdict is ``default``. Null URLs and those without ``://`` have an empty host and path, which no rule
    fits. Repeated rows stay, an empty table gives none, URLs may be of any length, and other columns are kept, whatever
    their names; names of ``into`` that are there already are an error.

    Each distinct host and path is expanded into the host suffixes and path prefixes that have as many labels and
    characters as some rule, joined to the rules on a short prefix of the expression's digest, and confirmed by the
    whole digest. URLs meet their result again by host and path, a join whose hot keys Spark can split.
    """
    if set(into) & set(pages.columns):
        raise ValueError(f"a column of {into} is there already")
    parsed = listed.where("rule is not null").select(
        "verdict", "rule", F.substring_index("rule", "/", 1).alias("h"), F.sha2("rule", 256).alias("digest"), F.length("rule").alias("n")
    )
    # labels and characters that some rule has, together: pairs, so that a URL isn't expanded into all combinations
    parsed = parsed.withColumns({"labels": F.size(F.split("h", r"\.")), "chars": F.col("n") - F.length("h")})
    best = parsed.groupBy("rule").agg(F.max(F.col("verdict") == "block").alias("blocks"), F.first("digest").alias("digest"), F.first("labels").alias("labels"), F.first("chars").alias("chars"), F.first("h").alias("h"))
    told = best.agg(F.collect_set(F.struct("labels", "chars")).alias("shapes"), F.sum(F.octet_length("rule") + 120).alias("bytes")).first()
    shapes = sorted(tuple(x) for x in told.shapes)
    host_is, path_is, rule_is, verdict_is = into
    host, path = host_and_path(F.col("url"))
    own = pages.withColumns({host_is: host, path_is: path})
    distinct = own.select(F.col(host_is).alias("host"), F.col(path_is).alias("path")).where("host <> ''").distinct()
    fits = [F.when((F.size(F.split("host", r"\.")) >= n) & (F.length("path") >= k), F.concat(F.substring_index("host", ".", -n), F.substr("path", F.lit(1), F.lit(k)))) for n, k in shapes]
    each = distinct.withColumn("x", F.explode(F.array_compact(F.array(*fits)) if fits else F.array().cast("array<string>"))).withColumn("found", F.sha2("x", 256))
    keyed = best.withColumn("short", F.substr("digest", F.lit(1), F.lit(SHORT)))
    keyed = F.broadcast(keyed) if (told.bytes or 0) <= RULES_BYTES else keyed
    hits = each.join(keyed, F.substr("found", F.lit(1), F.lit(SHORT)) == F.col("short")).where("found = digest and x = rule")
    won = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "blocks"), F.struct(F.length("rule"), F.length("h"))).alias("won"))
    won = won.select(F.col("host").alias(host_is), F.col("path").alias(path_is), F.col("won.rule").alias(rule_is), F.when(F.col("won.blocks"), "block").otherwise("allow").alias(verdict_is))
    found = own.join(won, [host_is, path_is], "left")
    return found.select(*(F.col(f"`{c}`") for c in pages.columns), host_is, path_is, rule_is, F.coalesce(F.col(verdict_is), F.lit(default)).alias(verdict_is))
