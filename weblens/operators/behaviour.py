"""Behaviour of clients beyond their windows: sequences of answers, agents' spelling, rhythm, breadth, and campaigns."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblens.operators.lineage import cut

CLIENT = ["server", "source_ip"]
ORDER = ["us", "event_id"]
SYMBOLS = 5


def answer_class(status: Column) -> Column:
    """One of five symbols, null for other codes."""
    within = lambda a, b: status.between(a, b)
    return F.when(within(200, 299), "2").when(within(300, 399), "3").when(status.isin(401, 403), "a").when(within(400, 499), "n").when(within(500, 599), "5")


def sequence_likelihood(requests: DataFrame) -> DataFrame:
    """(server, source_ip, steps, loglik): the mean log-likelihood of a client's steps between answer classes, under its
    server's steps with one more of each kind."""
    rows = requests.select(*CLIENT, *ORDER, answer_class(F.col("status_code")).alias("to")).where("to is not null")
    steps = rows.withColumn("from", F.lag("to").over(Window.partitionBy(*CLIENT).orderBy(*ORDER))).where("from is not null")
    by_client = steps.groupBy(*CLIENT, "from", "to").agg(F.count("*").alias("n"))
    counts = by_client.groupBy("server", "from", "to").agg(F.sum("n").alias("k"))  # 25 rows a server
    model = counts.withColumn("p", (F.col("k") + 1) / (F.sum("k").over(Window.partitionBy("server", "from")) + SYMBOLS)).drop("k")
    return by_client.join(model, ["server", "from", "to"]).groupBy(*CLIENT).agg(F.sum("n").alias("steps"), (F.sum(F.col("n") * F.log("p")) / F.sum("n")).alias("loglik"))


def agent_perplexity(requests: DataFrame) -> DataFrame:
    """(user_agent, requests, perplexity) of distinct agents under a model of each character after the two before it, counted
    over all requests with one more of each character."""
    agents = requests.where("user_agent is not null").groupBy("user_agent").agg(F.count("*").alias("requests"))
    padded = F.concat(F.lit("\x02\x02"), F.col("user_agent"), F.lit("\x03"))
    grams = agents.select("user_agent", "requests", F.explode(F.transform(F.sequence(F.lit(1), F.length("user_agent") + 1), lambda i: F.substring(padded, i, F.lit(3)))).alias("g"))
    counts = grams.groupBy("g").agg(F.sum("requests").alias("n"))
    context = counts.groupBy(F.substring("g", 1, 2).alias("c")).agg(F.sum("n").alias("m"))
    alphabet = counts.agg(F.count_distinct(F.substring("g", 3, 1)).alias("v")).first().v  # one number
    model = counts.withColumn("c", F.substring("g", 1, 2)).join(context, "c").select("g", F.log((F.col("n") + 1) / (F.col("m") + alphabet)).alias("l"))
    return grams.join(model, "g").groupBy("user_agent").agg(F.max("requests").alias("requests"), F.exp(-F.avg("l")).alias("perplexity"))


def rhythm(requests: DataFrame) -> DataFrame:
    """(server, source_ip, patterns, permutation_entropy): entropy, by log2 6, of the orders in which three pauses in a row stand;
    of equal pauses the earlier counts as the shorter."""
    w = Window.partitionBy(*CLIENT).orderBy(*ORDER)
    gaps = requests.select(*CLIENT, *ORDER, (F.col("us") - F.lag("us").over(w)).alias("gap")).where("gap is not null")
    three = gaps.withColumn("g1", F.lag("gap", 1).over(w)).withColumn("g2", F.lag("gap", 2).over(w)).where("g2 is not null")
    first, second, third = F.col("g2"), F.col("g1"), F.col("gap")
    order = F.concat((first <= second).cast("int"), (first <= third).cast("int"), (second <= third).cast("int"))
    counts = three.groupBy(*CLIENT, order.alias("o")).agg(F.count("*").alias("n"))
    n = F.sum("n")
    return counts.groupBy(*CLIENT).agg(n.alias("patterns"), F.greatest(F.lit(0.0), (F.log2(n) - F.sum(F.col("n") * F.log2("n")) / n) / F.log2(F.lit(6.0))).alias("permutation_entropy"))


def concentration(requests: DataFrame) -> DataFrame:
    """(server, source_ip, paths, gini): how unevenly a client's requests fall on its paths, 0 for evenly."""
    hits = requests.where("url_path is not null").groupBy(*CLIENT, "url_path").agg(F.count("*").alias("x"))
    # Equal hits share a sum whatever their order, so hits are counted by size first.
    sizes = hits.groupBy(*CLIENT, "x").agg(F.count("*").alias("m"))
    upto = F.sum("m").over(Window.partitionBy(*CLIENT).orderBy("x"))
    places = sizes.withColumn("places", F.col("m") * (2 * upto - F.col("m") + 1) / 2)
    n, total = F.sum("m"), F.sum(F.col("m") * F.col("x"))
    return places.groupBy(*CLIENT).agg(n.alias("paths"), (2 * F.sum(F.col("places") * F.col("x")) / (n * total) - (n + 1) / n).alias("gini"))


def campaigns(requests: DataFrame, num: int = 4, den: int = 5, least: int = 3) -> DataFrame:
    """(client, paths, links, campaign): clients (server|source_ip) whose path sets have a Jaccard similarity of num / den or
    more are linked; campaign is the least client that links reach. Clients of fewer than ``least`` paths take no part.

    Sets are ordered by how rare their paths are; two that are linked share a path among the first n - ceil(n num / den) + 1
    of each, so only sets that meet in such a path, and whose sizes allow it, are compared.
    """
    sets = requests.where("url_path is not null").groupBy(F.concat_ws("|", *CLIENT).alias("client"), "url_path").agg(F.lit(1).alias("one"))
    df = sets.groupBy("url_path").agg(F.count("*").alias("df"))
    listed = sets.join(df, "url_path").groupBy("client").agg(F.array_sort(F.collect_list(F.struct("df", "url_path"))).alias("s"))
    listed = cut(listed.select("client", F.transform("s", lambda x: x["url_path"]).alias("s")).where(F.size("s") >= least))
    n = F.size("s")
    heads = listed.select("client", n.alias("n"), F.explode(F.slice("s", 1, n - F.ceil(n * num / den).cast("int") + 1)).alias("url_path"))
    a, b = heads.toDF("a", "na", "url_path"), heads.toDF("b", "nb", "url_path")
    pairs = a.join(b, "url_path").where((F.col("a") < F.col("b")) & (den * F.col("na") >= num * F.col("nb")) & (den * F.col("nb") >= num * F.col("na"))).select("a", "b").distinct()
    both = pairs.join(listed.toDF("a", "sa"), "a").join(listed.toDF("b", "sb"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    links = cut(both.where(den * common >= num * (F.size("sa") + F.size("sb") - common)).select("a", "b"))
    edges = links.union(links.select("b", "a")).toDF("a", "b")
    labels = listed.select(F.col("client").alias("a"), F.col("client").alias("label"))
    while True:
        near = edges.join(labels.toDF("b", "l"), "b").groupBy("a").agg(F.min("l").alias("l"))
        step = labels.join(near, "a", "left").select("a", F.col("label").alias("was"), F.least("label", F.coalesce("l", "label")).alias("label"))
        # A label's own label is as good: chains halve.
        far = step.select(F.col("a").alias("label"), F.col("label").alias("next"))
        step = cut(step.join(far, "label").select("a", "was", F.least("label", "next").alias("label")))
        labels = step.select("a", "label")
        if not step.where("was <> label").limit(1).count():
            break
    degree = edges.groupBy("a").agg(F.count("*").alias("links"))
    out = listed.select(F.col("client").alias("a"), F.size("s").alias("paths")).join(labels, "a").join(degree, "a", "left")
    return out.select(F.col("a").alias("client"), F.col("paths").cast("long").alias("paths"), F.coalesce("links", F.lit(0).cast("long")).alias("links"), F.col("label").alias("campaign"))
