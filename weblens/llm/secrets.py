"""Secret scans judged by corpus-wide ownership, in DataFrame operations only.

Each kind has a pattern; its leftmost non-overlapping matches are placed by the lengths of what lies between them, and
matches that are too short are dropped. Hashes of the found values are then counted over the corpus by distinct owners
and distinct repositories: a value that many owners carry is a copied example, one that stays with one owner and is not
of a sample's shape looks live. Values travel as hashes only.

Kinds ``assign``, ``access`` and ``hex`` are the base. The method adds spans of vendor token shapes that the base does
not know (``vendor``). Positions are code points, ends are exclusive.

Null texts are empty. A null owner is one owner. Rows that repeat an id stay rows of their own, and a value in several
rows of one owner has one owner. One row comes out for each row that goes in. Texts have any length: no window or join
sees them, only the found spans.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblens.llm.common import keep

# The patterns of the kinds, with the group that holds the value, and the least length of that group.
KINDS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
    "vendor": (r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{20,}|eyJ[A-Za-z0-9_-]{16,}\.eyJ[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 20),
}
#: A cheap test that each text with a match passes.
HINTS = {
    "assign": r"(?i)password|passwd|secret|token|api_?key",
    "access": "AKIA",
    "hex": None,
    "vendor": r"gh[pousr]_|xox[abprs]-|eyJ|PRIVATE KEY-----",
}
BASE = ("assign", "access", "hex")
#: A value with at least so many owners is a copied example.
MANY_OWNERS = 3


def found(text: Column, kind: str) -> Column:
    """array<struct<start, end, kind, order, value>> of a kind's matches in a text."""
    pattern, group, least = KINDS[kind]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    between = F.transform(F.split(text, pattern, -1), F.length)
    spans = F.zip_with(between, F.arrays_zip(whole.alias("whole"), value.alias("value")), lambda gap, m: F.struct(gap.alias("gap"), m["whole"].alias("whole"), m["value"].alias("value")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))
    placed = F.aggregate(
        spans,
        zero,
        lambda acc, s: F.struct(
            (acc["at"] + s["gap"] + F.coalesce(F.length(s["whole"]), F.lit(0))).alias("at"),
            F.when(
                F.length(s["value"]) >= least,
                F.concat(acc["out"], F.array(F.struct((acc["at"] + s["gap"]).alias("start"), (acc["at"] + s["gap"] + F.length(s["whole"])).alias("end"), s["value"].alias("value")))),
            )
            .otherwise(acc["out"])
            .alias("out"),
        ),
        lambda acc: acc["out"],
    )
    order = list(KINDS).index(kind)
    named = F.transform(placed, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.sha2(s["value"], 256).alias("hash"), sample(s["value"]).alias("sample")))
    # The first test is by far the cheapest and most texts fail it.
    return F.when(text.rlike(HINTS[kind] or pattern), named).otherwise(F.array().cast("array<struct<start:int,order:int,end:int,kind:string,hash:string,sample:boolean>>"))


def sample(value: Column) -> Column:
    """Whether a value says itself that it is none."""
    return F.lower(value).rlike(r"example|sample|placeholder|changeme|dummy|your[_-]|xxxx|^(.)\1+$|1234567")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def all_spans(text: Column) -> Column:
    return F.array_sort(F.concat(*[found(text, kind) for kind in KINDS]))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, row, owner, repository, spans) of documents (doc_id, text, source); row tells rows apart."""
    rows = docs.select("doc_id", owner(F.col("source")).alias("owner"), F.col("source").alias("repository"), all_spans(F.coalesce("text", F.lit(""))).alias("spans"))
    return keep(rows).withColumn("row", F.monotonically_increasing_id())


def owner(source: Column) -> Column:
    """The owner of a source: what stands before its first slash."""
    return F.substring_index(source, "/", 1)


def ownership(rows: DataFrame) -> DataFrame:
    """(hash, owners, repositories): how many different owners and repositories carry a value, by sums of distinct rows."""
    each = rows.select("owner", "repository", F.explode("spans").alias("s")).select(F.col("s.hash").alias("hash"), "owner", "repository").distinct()
    return each.groupBy("hash", "owner").agg(F.count("*").alias("here")).groupBy("hash").agg(F.count("*").alias("owners"), F.sum("here").alias("repositories"))


def judged(rows: DataFrame, owned: DataFrame | None = None) -> DataFrame:
    """Candidates' rows with spans that tell how many owners a value has and whether it looks live.

    ``owned`` (hash, owners, repositories) counts another corpus, such as the one before copies went; values that it does
    not hold are one owner's. Without it these rows count.
    """
    spans = rows.select("row", F.explode("spans").alias("s")).withColumn("hash", F.col("s.hash"))
    known = spans.join(ownership(rows) if owned is None else owned, "hash", "left")
    owned = known.withColumns({c: F.coalesce(c, F.lit(1).cast("long")) for c in ("owners", "repositories")})
    live = (F.col("owners") < MANY_OWNERS) & ~F.col("s.sample")
    told = F.struct("s.start", "s.order", "s.end", "s.kind", "owners", "repositories", live.alias("live"))
    by_row = owned.groupBy("row").agg(F.array_sort(F.collect_list(told)).alias("judged"))
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string,owners:bigint,repositories:bigint,live:boolean>>")
    return rows.join(by_row, "row", "left").withColumn("judged", F.coalesce("judged", none))


def secret_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example) of documents (doc_id, text, source)."""
    rows = judged(candidates(docs))
    base = F.filter("judged", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("judged", lambda s: s["kind"] == kind)).cast("long")
    live = F.size(F.filter("judged", lambda s: s["live"])).cast("long")
    return rows.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("judged")).alias("spans"), live.alias("n_live"), (F.size("judged") - live).cast("long").alias("n_example"))


def redacted(docs: DataFrame, owned: DataFrame | None = None, mask: str = "[SECRET]") -> DataFrame:
    """The documents (text, source, ...) with values that look live replaced by a mask; all else stays as it is.
    Owners are counted in these documents, or given.

    Live spans of one text may overlap across kinds; each run of them leaves one mask. Only documents with candidates are
    kept aside for the counts; the others pass.
    """
    whole = F.struct(*docs.columns).alias("doc")
    spans = docs.select(whole, all_spans(F.coalesce("text", F.lit(""))).alias("spans"))
    rows = spans.where(F.size("spans") > 0).select("doc", "spans", owner(F.col("doc.source")).alias("owner"), F.col("doc.source").alias("repository"))
    rows = judged(keep(rows).withColumn("row", F.monotonically_increasing_id()), owned)
    text = F.col("doc.text")
    live = F.filter("judged", lambda s: s["live"])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    masked = F.aggregate(live, start, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    text = F.when(F.size(live) > 0, masked).otherwise(text)
    out = rows.select(*[(text if c == "text" else F.col("doc")[c]).alias(c) for c in docs.columns])
    return docs.where(F.size(all_spans(F.coalesce("text", F.lit("")))) == 0).union(out)
