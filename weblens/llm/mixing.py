"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Each source gets a target of words. Within it the chances of documents differ: a document's expected copies are
``c * measure``, at most ``most``, where the measure grows with its length (``MEASURE``) and c makes the expected words of the
source its target. Of its expected copies the whole ones are taken for certain. The rest p is its chance of one more: documents
are ranked by ``(u / (1 - u)) / (p / (1 - p))``, where u is uniform by a hash of id and text, and the lowest ranks are taken until
their words come nearest to what the chances promise. Documents with the same length class have the same chance.

A source may hold any share of the rows, so no window runs over a source: c comes from the sums of some hundred length
classes. Ranks fall into buckets whose sums find the bucket in which the sample ends; that bucket is divided once more, and only
what lies in the last small bucket is ordered. There may be any number of sources: they are numbered by ranges, and the level to which
they fill is found by rounds of sums.

Sizes count the words ``[^\\x20\\x09-\\x0D]+``; a null text has none. Null sources are one source, the last. Documents
without words take 0. Null ids are ids like others. Rows with equal ids stay rows of their own; those of equal id, text
and source are taken alike. The same input gives the same mix. An empty table gives an empty one.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblens.llm.common import keep

#: Buckets of a division; two divisions leave one row in BUCKETS**2 of a source to be ordered.
BUCKETS = 1024
WEIGHTS = (3, 1, 2)
#: Length classes to a doubling of words, and the power of the length by which chances grow.
CLASSES, MEASURE = 4, 0.25
#: Sources up to which their figures are broadcast.
SOURCES = 100_000


def word_count(text: Column) -> Column:
    """The number of words: spaces are made alike, and each word with those after it becomes one mark. Matches are not listed, as
    the list of a long text's words takes many times its memory."""
    alike = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.length(F.regexp_replace(F.ltrim(alike), "[^ ]+ *", "x")).cast("long"), F.lit(0).cast("long"))


def numbered(sizes: DataFrame) -> DataFrame:
    """Sources with ``place``, their number from 0 by code point, null last: by ranges, each with the count of those before."""
    partitions = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").isNull(), F.col("source")]
    dealt = keep(sizes.repartitionByRange(partitions, *order).withColumn("range", F.spark_partition_id()))
    counts = {r["range"]: r["count"] for r in dealt.groupBy("range").count().collect()}  # a row a partition
    before = {i: sum(n for j, n in counts.items() if j < i) for i in counts}
    start = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("range")) if before else F.lit(0)
    within = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return dealt.withColumn("place", start + within - 1).drop("range")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) of (source, source_size): shares by weight, none above ``most`` times its size.

    The level is what a weight of 1 gets. It only rises: each round closes the sources whose limit lies below their part, and
    shares what they leave among the open ones, until a round closes none.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    full = keep(numbered(sizes).withColumn("weight", weight).withColumn("limit", most * F.col("source_size")))
    total = full.agg(F.sum("source_size")).first()[0] or 0
    level, was = 0.0, -1
    while True:
        closed = F.col("limit") <= level * F.col("weight")
        got = full.agg(F.count_if(closed).alias("n"), F.coalesce(F.sum(F.when(closed, F.col("limit"))), F.lit(0.0)).alias("used"), F.sum(F.when(~closed, F.col("weight"))).alias("open")).first()
        if got.n == was or not got.open:
            break
        level, was = max(level, (share * total - got.used) / got.open), got.n
    return full.select("source", "source_size", F.least("limit", F.lit(level) * F.col("weight")).alias("target"))


def rates(classes: DataFrame, per: DataFrame, most: float) -> DataFrame:
    """(source, source_size, target, c): c times a document's measure, at most ``most``, are its expected copies.

    The longest classes reach ``most`` first, so those that do are the first of a source's classes in falling order.
    ``classes`` (source, class, words) has a row for each length class of a source, a hundred or so.
    """
    down = Window.partitionBy("s").orderBy(F.desc("class"))
    on = F.col("source").eqNullSafe(F.col("s"))
    rows = classes.withColumnRenamed("source", "s").where("class is not null").join(per, on)
    clipped = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("words") * measure("class")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("c", (F.col("target") - most * clipped) / rest)
    # The first class that stays below most: all longer ones are at most.
    fits = rows.where(F.col("c") * measure("class") <= most + 1e-12).groupBy("s").agg(F.max_by("c", "class").alias("c"))
    return per.join(fits, on, "left").select("source", "source_size", "target", F.coalesce("c", F.lit(0.0)).alias("c"))


def length_class(size: Column) -> Column:
    return F.when(size > 0, F.floor(CLASSES * F.log2(size.cast("double")) + 1e-9))


def measure(name: str) -> Column:
    return F.pow(F.lit(2.0), F.col(name) * (MEASURE / CLASSES))


def ended(rows: DataFrame, bucket: str, by: list[str]) -> DataFrame:
    """For each source, the bucket in which its words reach what is left, and what is left before that bucket."""
    sums = rows.groupBy(*by, bucket).agg(F.sum("size").alias("words"), F.first("left").alias("left"))
    sums = sums.withColumn("upto", F.sum("words").over(Window.partitionBy(*by).orderBy(bucket))).where("upto >= left")
    least = sums.groupBy(*by).agg(F.min(F.struct(bucket, (F.col("left") - F.col("upto") + F.col("words")).alias("left"))).alias("m"))
    return least.select(*by, F.col("m")[bucket].alias("end"), F.col("m")["left"].alias("left"))


def placed(rows: DataFrame, per: DataFrame, most: float, seed: int) -> DataFrame:
    """Rows (source, name, size, ...) with their source's figures, their copies for certain and chance, rank and its buckets.

    The number of sources is not bounded: ``per`` is broadcast only if it has few rows.
    """
    out = rows.withColumn("class", length_class(F.col("size"))).join(per.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # A hair is forgiven, so that a chance of 1 is a whole copy.
    expected = F.coalesce(F.least(F.lit(most), F.col("c") * measure("class")), F.lit(0.0))
    out = out.withColumn("expected", expected).withColumn("whole", F.floor(F.col("expected") + 1e-9)).withColumn("chance", F.greatest(F.lit(0.0), F.col("expected") - F.col("whole"))).drop("expected", "class")
    u = (F.pmod(F.xxhash64(F.lit(seed), "name"), F.lit(1 << 50)) + 0.5) / float(1 << 50)
    p = F.col("chance")
    out = out.withColumn("rank", F.when(p > 0, (u / (1 - u)) / (p / (1 - p))))
    # Buckets are cut from a rising function of the rank that spreads it over 0 to 1.
    at = F.col("rank") / (1 + F.col("rank"))
    return out.withColumn("b1", F.floor(at * BUCKETS)).withColumn("b2", F.floor(at * BUCKETS * BUCKETS) % BUCKETS)


def plan(sizes: DataFrame, weights: tuple, share: float, most: float, seed: int) -> DataFrame:
    """For each source of (source, name, size): its target, c, and the rank at which its sample ends."""
    classes = keep(sizes.groupBy("source", length_class(F.col("size")).alias("class")).agg(F.sum("size").alias("words")))
    per = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    per = broadcast_if_few(keep(rates(classes, per, most)))
    asked = placed(sizes, per, most, seed).where("chance > 0 and size > 0").withColumn("s", F.struct("source"))
    left = keep(asked.groupBy("s").agg(F.sum(F.col("size") * F.col("chance")).alias("left")))
    one = keep(ended(asked.join(left, "s"), "b1", ["s"]).withColumnRenamed("end", "b1"))
    two = keep(ended(asked.join(one, ["s", "b1"]), "b2", ["s", "b1"]).withColumnRenamed("end", "b2"))
    last = asked.join(two, ["s", "b1", "b2"]).groupBy("s", "b1", "b2", "rank", "name", "size", "left").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("s").orderBy("rank", "name", "size"))
    # A document is taken if the words come nearer to what is left with it than without it.
    last = last.withColumn("upto", upto).where(F.abs(F.col("upto") - F.col("left")) < F.abs(F.col("upto") - F.col("words") - F.col("left")))
    cut = last.groupBy("s").agg(F.max(F.struct("rank", "name", "size")).alias("cut"))
    ends = two.select("s", F.col("b1").alias("end1"), F.col("b2").alias("end2")).join(cut, "s", "left")
    return broadcast_if_few(keep(per.withColumn("s", F.struct("source")).join(ends, "s", "left").drop("s")))


def broadcast_if_few(per: DataFrame) -> DataFrame:
    """A row a source: broadcast up to SOURCES rows, so that no text is shuffled; beyond that it is joined."""
    return F.broadcast(per) if per.count() <= SOURCES else per


def mixed_in(rows: DataFrame, ends: DataFrame, most: float, seed: int) -> DataFrame:
    """Rows (source, name, size, ...) with source_size, target, copies and taken."""
    before = (F.col("b1") < F.col("end1")) | ((F.col("b1") == F.col("end1")) & (F.col("b2") < F.col("end2")))
    at_end = (F.col("b1") == F.col("end1")) & (F.col("b2") == F.col("end2")) & (F.struct("rank", "name", "size") <= F.col("cut"))
    copies = F.col("whole") + F.coalesce(before | at_end, F.lit(False)).cast("long")
    out = placed(rows, ends, most, seed).withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0).cast("long"))
    return out.withColumn("taken", F.col("size") * F.col("copies"))


def sized(docs: DataFrame) -> DataFrame:
    """(source, doc_id, name, size): the name tells rows of one id by their texts."""
    return docs.select("source", "doc_id", F.xxhash64("doc_id", "text").alias("name"), word_count(F.col("text")).alias("size"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of documents (doc_id, source, text)."""
    rows = keep(sized(docs))
    out = mixed_in(rows, plan(rows, weights, share, most, seed), most, seed)
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


def copied(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns."""
    ends = plan(keep(sized(docs)), weights, share, most, seed)
    whole = F.struct("*").alias("doc")
    rows = docs.select("source", F.xxhash64("doc_id", "text").alias("name"), word_count(F.col("text")).alias("size"), whole)
    taken = mixed_in(rows, ends, most, seed).where("copies > 0")
    return taken.select("doc", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("doc.*")
