"""Scalar expressions over request columns. All of them are built-in functions, so they stay in generated code."""

import json
from ipaddress import ip_network

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weblens.functions import fixed


def ua_hash(ua: Column) -> Column:
    """16 hex digits of a user agent; none is hashed like an empty one."""
    return F.substring(F.sha2(F.coalesce(ua, F.lit("")), 256), 1, 16)


def entity(server: Column, ip: Column, ua: Column) -> Column:
    return F.concat_ws("|", F.coalesce(server, F.lit("_")), F.coalesce(ip, F.lit("_")), ua_hash(ua))


def namespace(org: Column, env: Column, server: Column) -> Column:
    return F.concat_ws("/", *[F.coalesce(F.nullif(c, F.lit("")), F.lit("_")) for c in (org, env, server)])


def is_internal(ip: Column, country: Column) -> Column:
    return ip.isNotNull() & country.isNull()


def is_request(event_type: Column) -> Column:
    """Only a type that says something else excludes a record."""
    return event_type.isNull() | (event_type == "access")


def without_query(path: Column) -> Column:
    return F.regexp_extract(path, r"^[^?#]*", 0)


def extension(path: Column) -> Column:
    """The lower-case extension of the last segment, of 1 to 9 letters or digits; null if there is none."""
    ext = F.regexp_extract(F.lower(without_query(path)), r"(^|/)[^/.][^/]*\.([a-z0-9]{1,9})$", 2)
    return F.nullif(ext, F.lit(""))


def tokens(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda t: t != "")


def depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def referrer_path(referrer: Column) -> Column:
    """The path of an absolute or bare referrer without query; a host alone is ``/``; null if nothing is left."""
    rest = F.regexp_extract(referrer, r"^.*?://(.*)$", 1)
    path = F.when(F.instr(referrer, "://") > 0, F.when(F.instr(rest, "/") > 0, F.regexp_extract(rest, r"(/.*)$", 1)).otherwise("/")).otherwise(referrer)
    return F.nullif(without_query(path), F.lit(""))


def declared_bot(ua: Column) -> Column:
    low = F.lower(ua)
    return (
        F.when(F.coalesce(ua, F.lit("")) == "", True)
        .when(low.rlike(fixed.CUBOT), False)
        .when(~low.startswith("mozilla/"), True)
        .when(F.contains(low, F.lit("compatible;")), True)
        .otherwise(low.rlike(fixed.BOT_WORDS))
    )


def crawler_family(ua: Column) -> Column:
    out = F
    for marker, family in fixed.FAMILY_MARKERS:
        out = out.when(F.contains(F.lower(ua), F.lit(marker)), F.lit(family))
    return out


def is_asset(path: Column) -> Column:
    return F.coalesce(extension(path).isin(*fixed.ASSET_EXTENSIONS), F.lit(False))


def ipv4(ip: Column) -> Column:
    """The number of a dotted address; null for anything else."""
    parts = F.split(ip, r"\.")
    number = F.try_element_at(parts, F.lit(1)).try_cast("long")
    for i in (2, 3, 4):
        number = number * 256 + F.try_element_at(parts, F.lit(i)).try_cast("long")
    return F.when(ip.rlike(r"^((25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"), number)


def ipv6_prefix(ip: Column, groups: int) -> Column:
    """The first groups of an address of version 6 as padded hex digits, if they stand before any ``::``; else null."""
    head = F.split(F.substring_index(F.lower(ip), "::", 1), ":")
    padded = F.transform(F.slice(head, 1, groups), lambda g: F.lpad(g, 4, "0"))
    known = (F.instr(ip, ":") > 0) & ip.rlike(r"^[0-9A-Fa-f:]+$") & (F.size(head) <= 8)
    short = F.size(head) < groups
    zeros = F.concat(padded, F.array_repeat(F.lit("0000"), F.greatest(F.lit(0), F.lit(groups) - F.size(head))))
    return F.when(known & (~short | F.contains(ip, F.lit("::"))), F.array_join(zeros, ""))


def range_rows() -> list[tuple[str, int | None, int | None, str | None]]:
    """(family, lo, hi, prefix) of the published ranges; version 6 ones as a prefix of three groups."""
    rows = []
    for family, text in fixed.CRAWLER_RANGES.items():
        for block in map(ip_network, text.split()):
            if block.version == 4:
                rows.append((family, int(block.network_address), int(block.broadcast_address), None))
            else:
                rows.append((family, None, None, block.network_address.exploded.replace(":", "")[: block.prefixlen // 4]))
    return rows


def crawler_ranges(spark: SparkSession) -> DataFrame:
    """The published ranges as a table of fixed size."""
    return spark.createDataFrame(range_rows(), "family string, lo long, hi long, prefix string")


def in_family(ip: Column, family: Column) -> Column:
    """Whether an address lies in a published range of a crawler family.

    An address is read once, and only for clients that claim a family: it is bound as the one item of an array, and compared
    with a literal list of ranges, so that the plan holds the expressions of address and family once.
    """
    asked = F.array(F.struct(family.alias("family"), ipv4(ip).alias("number"), ipv6_prefix(ip, 3).alias("prefix")))
    ranges = F.from_json(F.lit(json.dumps([dict(zip(("family", "lo", "hi", "prefix"), r, strict=True)) for r in range_rows()])), "array<struct<family: string, lo: long, hi: long, prefix: string>>")
    inside = lambda a, r: (a["family"] == r["family"]) & (a["number"].between(r["lo"], r["hi"]) | (a["prefix"] == r["prefix"]))
    return F.coalesce(F.when(family.isNotNull(), F.exists(asked, lambda a: F.exists(ranges, lambda r: inside(a, r)))), F.lit(False))


def verified_crawler(ip: Column, ua: Column) -> Column:
    return in_family(ip, crawler_family(ua))


def severity_score(confidence: Column, weight: Column | float = 1.0, bands: Column | int = 0) -> Column:
    """0 to 100, rounded half to even; a confidence outside 0 to 1 is an error."""
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(confidence * 100 * weight + bands * 1.0)))
    return F.when(confidence.between(0, 1), score.cast("int")).otherwise(F.raise_error(F.lit("confidence outside 0 to 1")).cast("int"))


def severity_band(score: Column) -> Column:
    return F.when(score >= 90, "critical").when(score >= 70, "high").when(score >= 45, "medium").otherwise("low")


def drift_band(psi: Column) -> Column:
    return F.when(psi > fixed.PSI_HIGH, "significant").when(psi >= fixed.PSI_LOW, "moderate").otherwise("stable")


def is_canary(ip: Column) -> Column:
    return F.coalesce(ip.startswith("198.51.100."), F.lit(False))


def age_s(ts: Column, now: Column) -> Column:
    """Whole seconds from a timestamp to now; 0 for one that lies ahead, null for none."""
    return F.greatest(F.lit(0).cast("long"), F.unix_seconds(now) - F.unix_seconds(ts))
