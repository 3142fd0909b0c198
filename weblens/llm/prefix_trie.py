"""Conversation prefix trie: shards in level order (LOUDS), rolled up from their deepest level; heavy upper levels apart.

A node of depth d is a sequence of the first d turns (role, text) of some conversation; its members are the conversations
that start with it. It is named by 128 bits: the sum of hashes of each turn with its place, so that the names of all prefixes
of a conversation are running sums, wherever its rows lie. It is called by its smallest member and its depth.

Rows of ids and hashes, without texts, are sorted into ranges by conversation and turn; a conversation may run through many
tasks, whose edges (a row or two a task) the driver chains. Each conversation has a row for each of its prefixes. A node
whose subtree has more than ``SHARD`` of these rows is heavy, as is the root. The subtrees below heavy nodes are shards; a task
reads whole shards of together about ``FOREST`` rows and builds one forest of them: bits and labels level by level, parents
and degrees by rank and select on the bits, sums from the last level to the first. Heavy nodes, whatever their number or
depth, get the sums of their subtrees by doubling: in round k each adds what those 2^k below it have, so rounds grow with the
logarithm of the depth. Members that end in a heavy node are joined in ranges and their digest reads these pieces in a stream.

Nulls: a null role or text is empty, null turns come first, rows with a null conversation id belong to none. Rows that tie in
their turn are ordered by role, then by a hash of the text; repeated rows are turns of their own. A conversation without
turns is a member of the root. An empty table gives an empty one; other columns are not read.
"""

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.llm.common import Scratch, keep, mixed, signed
from weblens.llm.mixing import word_count

#: Prefix rows of a subtree that stays together; one with more is split at its top, however many share its beginning.
SHARD = 2_000
#: Rows of whole shards that a task builds at once, at least a shard's most.
FOREST = 100_000
#: Ids in one piece of a heavy node's digest.
PIECE = 50_000
#: Conversations that share their beginning with the first of them, and the turns that may be shared.
FAMILY, SHARED = 20, 4


def borrowed(conv: int) -> int:
    """How many turns a conversation takes from the first of its family."""
    return zlib.crc32(str(conv).encode()) % SHARED if conv % FAMILY else 0


def arrays(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> list[np.ndarray]:
    """A task's columns of whole numbers."""
    got: list[list[np.ndarray]] = [[] for _ in names]
    for b in batches:
        for column, name in zip(got, names, strict=True):
            column.append(b.column(name).to_numpy(zero_copy_only=False))
    return [np.concatenate(c) if c else np.zeros(0, np.int64) for c in got]


def segments(key: np.ndarray) -> np.ndarray:
    """Starts of the stretches of equal values, and the end."""
    return np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]) if len(key) else np.zeros(1, np.int64)


class Share:
    """A task's share of the sorted turns: names of the prefixes that its turns end.

    ``edge`` holds what lies in other tasks: turns of the first conversation before this share, all turns of the first and of
    the last one, the family's first turns as far as they came before, and the sums before the share.
    """

    COLUMNS = ("conv_id", "t1", "t2", "words")

    def __init__(self, columns: list[np.ndarray], edge: dict):
        conv, t1, t2, words = columns
        self.conv, self.words, self.cuts = conv, words, segments(conv)
        begin, heads = self.cuts[:-1], conv[self.cuts[:-1]].tolist()
        self.heads, sizes = heads, np.diff(self.cuts)
        before = np.zeros(len(heads), np.int64)
        total = sizes.copy()
        if heads:
            before[0] = edge["before"]
            total[0], total[-1] = edge["first_total"], edge["last_total"]
        lead, lead_id = list(edge["lead"]), edge["lead_id"]
        h, hb, sums, self.copies = [], [], [], []
        for s, c in enumerate(heads):
            a, n = int(begin[s]), int(sizes[s])
            if c % FAMILY == 0:
                if c != lead_id:
                    lead, lead_id = [], c
                lead += [(int(t1[i]), int(t2[i]), int(words[i])) for i in range(a, a + min(n, SHARED - 1 - len(lead)))]
            take = borrowed(c)
            own = lead[:take] if take and lead_id == c - c % FAMILY else []
            names = prefix_names(own)
            h.append(take)
            hb.append(len(own))
            sums.append(names[-1][:2] if names else (0, 0))
            self.copies.append(names)
        self.h, self.hb = np.array(h, np.int64), np.array(hb, np.int64)
        self.length = self.hb + np.maximum(total - self.h, 0)
        self.begins = before == 0
        seg = np.repeat(np.arange(len(heads)), sizes)
        place = np.arange(len(conv)) - begin[seg] + before[seg] if len(conv) else np.zeros(0, np.int64)
        self.used = place >= self.h[seg]
        self.seg, self.depth = seg, self.hb[seg] + place - self.h[seg] + 1
        self.names, self.parents, self.tail = [], [], []
        for k, t in enumerate((t1, t2)):
            g = np.where(self.used, turn_hash(t.view(np.uint64), self.depth), np.uint64(0))
            cum = np.concatenate([[np.uint64(0)], np.cumsum(g, dtype=np.uint64)])
            first = np.array([x[k] for x in sums], np.uint64)
            if heads and before[0]:
                first[0] = np.uint64(edge["sums"][k])
            after = cum[1:] - cum[begin][seg] + first[seg]
            self.names.append(after)
            self.parents.append(after - g)
            self.tail.append(int(after[-1]) if len(after) else 0)


def turn_hash(turn: np.ndarray, depth: np.ndarray) -> np.ndarray:
    return mixed(turn ^ mixed(depth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def prefix_names(turns: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(name, name, words of the last turn) of each prefix of a few turns."""
    out, sums = [], [0, 0]
    for d, turn in enumerate(turns, 1):
        for k in (0, 1):
            own = turn_hash(np.array([turn[k]], np.int64).view(np.uint64), np.array([d]))
            sums[k] = (sums[k] + int(own[0])) % (1 << 64)
        out.append((*sums, turn[2]))
    return out


def edges_of(ordered: DataFrame) -> dict[int, dict]:
    """For each task what its first and last conversations have in other tasks, but for the sums."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, t1, t2, words = arrays(batches, Share.COLUMNS)
        if not len(conv):
            return
        cuts = segments(conv)
        heads = conv[cuts[:-1]]
        leads = np.flatnonzero(heads % FAMILY == 0)
        lead, turns = None, []
        if len(leads):
            a, b = cuts[leads[-1]], cuts[leads[-1] + 1]
            lead, b = int(heads[leads[-1]]), min(b, a + SHARED - 1)
            turns = np.stack([t1[a:b], t2[a:b], words[a:b]], axis=1).ravel().tolist()
        row = [TaskContext.get().partitionId(), int(heads[0]), int(cuts[1]), int(heads[-1]), int(cuts[-1] - cuts[-2]), lead, turns]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.list_(pa.int64()) if i == 6 else pa.int64()) for i, x in enumerate(row)], names=["pid", "c1", "n1", "c2", "n2", "lead", "turns"])

    tasks = sorted(ordered.mapInArrow(ends, "pid long, c1 long, n1 long, c2 long, n2 long, lead long, turns array<long>").collect(), key=lambda r: r.pid)  # one row a task
    out, lead_id, lead, last, upto, chain = {}, None, [], None, 0, []
    total: dict[int, int] = {}
    for r in tasks:
        for c, n in ((r.c1, r.n1), (r.c2, r.n2)) if r.c1 != r.c2 else ((r.c1, r.n1),):
            total[c] = total.get(c, 0) + n
    for r in tasks:
        before = upto if r.c1 == last else 0
        out[r.pid] = {"before": before, "first_total": total[r.c1], "last_total": total[r.c2], "lead": tuple(lead), "lead_id": lead_id, "one": r.c1 == r.c2, "c1": r.c1, "c2": r.c2, "sums": (0, 0)}
        last, upto = r.c2, (before + r.n1 if r.c1 == r.c2 else r.n2)
        if r.lead is not None:
            turns = list(zip(r.turns[::3], r.turns[1::3], r.turns[2::3], strict=True))
            lead = [*(lead if r.lead == lead_id else []), *turns][: SHARED - 1]
            lead_id = r.lead
    return out


def with_sums(ordered: DataFrame, edges: dict[int, dict]) -> dict[int, dict]:
    """The edges with the sums that the first conversation of a task has before it."""
    shared = ordered.sparkSession.sparkContext.broadcast(edges)

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        columns = arrays(batches, Share.COLUMNS)
        if len(columns[0]):
            tail = np.array(Share(columns, shared.value[pid]).tail, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (pid, *signed(tail).tolist())], names=["pid", "s1", "s2"])

    got = {r.pid: (r.s1, r.s2) for r in ordered.mapInArrow(tails, "pid long, s1 long, s2 long").collect()}  # one row a task
    carried, last = [0, 0], None
    out = {}
    for pid in sorted(edges):
        e = dict(edges[pid])
        if e["before"] and e["c1"] == last:
            e["sums"] = tuple(carried)
        tail = [x % (1 << 64) for x in got[pid]]
        # A share of one conversation that goes on from before started its sum from nothing.
        carried = [(a + b) % (1 << 64) for a, b in zip(e["sums"], tail, strict=True)] if e["one"] else tail
        last, out[pid] = e["c2"], e
    return out


def prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, length, p1, p2, q1, q2, words): a row for each prefix of each rebuilt conversation, the empty one
    included: its name, the name without its last turn, the words of the last turn, and the turns of the conversation."""
    spark = conversations.sparkSession
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.xxhash64(F.lit(1), role, text).alias("t1"), F.xxhash64(F.lit(2), text, role).alias("t2"), word_count(text).alias("words"),
    )
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "t1", "t2", "salt"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = slim.withColumn("salt", F.monotonically_increasing_id())
    ordered = keep(salted.repartitionByRange(n, *order).sortWithinPartitions(*order).select(*Share.COLUMNS))
    shared = spark.sparkContext.broadcast(with_sums(ordered, edges_of(ordered)))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = arrays(batches, Share.COLUMNS)
        if not len(columns[0]):
            return
        s = Share(columns, shared.value[TaskContext.get().partitionId()])
        rows: list[tuple] = []  # the root and the turns of the family's first, at each conversation's beginning
        for i in np.flatnonzero(s.begins).tolist():
            rows.append((s.heads[i], 0, int(s.length[i]), 0, 0, 0, 0, 0))
            was = (0, 0)
            for d, (p1, p2, words) in enumerate(s.copies[i], 1):
                rows.append((s.heads[i], d, int(s.length[i]), p1, p2, *was, words))
                was = (p1, p2)
        u = s.used
        own = [s.conv[u], s.depth[u], s.length[s.seg][u], *(signed(np.ascontiguousarray(x[u])) for x in (*s.names, *s.parents)), s.words[u]]
        given = [np.array(x, np.uint64).view(np.int64) if 3 <= k <= 6 else np.array(x, np.int64) for k, x in enumerate(zip(*rows, strict=True))] or [np.zeros(0, np.int64)] * 8
        for part in (given, own):
            for a in range(0, len(part[0]), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 50_000], pa.int64()) for c in part], names=list(PREFIX))

    return ordered.mapInArrow(named, ", ".join(f"{c} long" for c in PREFIX))


PREFIX = ("conv_id", "depth", "length", "p1", "p2", "q1", "q2", "words")


class Louds:
    """A forest in level order: for each node a 1 for each child, then a 0; before all, those of a root above its trees."""

    def __init__(self, parents: list[np.ndarray]):
        """Of the parents' numbers of each level's nodes, siblings side by side; the first level's are 0."""
        sizes = [len(p) for p in parents]
        self.levels = np.cumsum([0, *sizes])
        degree = [np.array([sizes[0]])]
        for above, p in zip(sizes, [*parents[1:], np.zeros(0, np.int64)], strict=True):
            degree.append(np.bincount(p, minlength=above))
        degree = np.concatenate(degree)
        self.bits = np.ones(int(degree.sum()) + len(degree), dtype=bool)
        self.bits[np.cumsum(degree + 1) - 1] = False

    def parents(self) -> np.ndarray:
        """The number of each node's parent, -1 for the trees' roots: the zeros before the node's own 1."""
        zeros_before = np.cumsum(~self.bits)
        return zeros_before[np.flatnonzero(self.bits)] - 1

    def degrees(self) -> np.ndarray:
        """Children of each node: the ones between its zero and the one before."""
        return np.diff(np.flatnonzero(~self.bits)) - 1

    def rolled_up(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees, from the deepest level up."""
        out, parents = values.copy(), self.parents()
        for a, b in zip(self.levels[-2:0:-1].tolist(), self.levels[:1:-1].tolist(), strict=True):
            np.add.at(out, parents[a:b], out[a:b])
        return out


NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, q1 long, q2 long"


def digest(ids: list[int]) -> str:
    return sha256(",".join(map(str, ids)).encode()).hexdigest()


def forest(rows: list[np.ndarray]) -> pa.RecordBatch:
    """The nodes of whole shards, of (conv_id, depth, length, p1, p2, q1, q2, words, shard's depth): the top of a shard has
    the name of its parent and no parent_conv_id, other nodes have no such name."""
    conv, depth, length, p1, p2, q1, q2, words, top = rows
    who = np.unique(conv, return_inverse=True)[1]
    at = np.zeros(len(conv), np.int64)  # the number, within its level, of the node in which each conversation stands
    level = depth - top
    by_level = np.argsort(level, kind="stable")
    bounds = np.searchsorted(level[by_level], np.arange(int(level.max()) + 2))
    parents, chosen, counts, ends = [], [], [], []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        rows_here = by_level[a:b]
        above = at[who[rows_here]] if parents else np.zeros(b - a, np.int64)
        rows_here = rows_here[order := np.lexsort((conv[rows_here], p2[rows_here], p1[rows_here], above))]
        above = above[order]
        new = np.ones(len(rows_here), bool)
        new[1:] = (above[1:] != above[:-1]) | (p1[rows_here[1:]] != p1[rows_here[:-1]]) | (p2[rows_here[1:]] != p2[rows_here[:-1]])
        starts = np.flatnonzero(new)
        at[who[rows_here]] = np.cumsum(new) - 1
        parents.append(above[starts])
        chosen.append(rows_here[starts])
        counts.append(np.diff(starts, append=len(rows_here)))
        stop = np.flatnonzero(depth[rows_here] == length[rows_here])
        hashes = [NO_ENDS] * len(starts)
        mine = (np.cumsum(new) - 1)[stop]
        cuts = segments(mine)
        ids = conv[rows_here[stop]].tolist()
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            hashes[int(mine[x])] = digest(ids[x:y])
        ends += hashes
    trie = Louds(parents)
    first, n = np.concatenate(chosen), np.concatenate(counts)
    degrees, parent = trie.degrees(), trie.parents()
    inner = parent >= 0
    of = np.where(inner, conv[first][parent], 0)
    columns = [conv[first], depth[first], pa.array(of, pa.int64(), mask=~inner), n, degrees, trie.rolled_up((degrees == 0).astype(np.int64)), trie.rolled_up((n - 1) * words[first]), ends]
    columns += [pa.array(q[first], pa.int64(), mask=inner) for q in (q1, q2)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f.split()[0] for f in NODE.split(", ")])


NO_ENDS = digest([])


def shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Forests of whole shards, of rows that come shard by shard. A shard has ``size`` rows at most, so twice as many
    hold the end of one."""
    names = (*PREFIX, "top", "s1", "s2")
    held: list[list[np.ndarray]] = []
    n = 0
    for b in batches:
        held.append([b.column(c).to_numpy(zero_copy_only=False) for c in names])
        n += b.num_rows
        if n >= 2 * size:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            s1, s2 = columns[-2:]
            cut = int(np.flatnonzero((s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1]))[-1]) + 1
            yield forest([c[:cut] for c in columns[:-2]])
            held, n = [[c[cut:] for c in columns]], n - cut
    if n:
        yield forest([np.concatenate(c) for c in zip(*held, strict=True)][:-2])


def ends_of(stops: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of (node, depth, member): digests of any number of members, which are sorted in ranges,
    joined in pieces, and read in order."""
    spark = stops.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, depth, member = (b.column(c).to_numpy(zero_copy_only=False) for c in ("node", "depth", "member"))
            cuts = np.union1d(np.union1d(segments(node), segments(depth)), np.arange(0, len(node) + 1, PIECE))[:-1].astype(np.int64)
            text = [",".join(map(str, x.tolist())).encode() for x in np.split(member, cuts[1:])] if len(node) else []
            yield pa.RecordBatch.from_arrays([pa.array(node[cuts]), pa.array(depth[cuts]), pa.array(member[cuts]), pa.array(text, pa.binary())], names=["node", "depth", "member", "piece"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, out = None, None, []
        for b in batches:
            for i in range(b.num_rows):
                key = (b.column("node")[i].as_py(), b.column("depth")[i].as_py())
                if key == at:
                    state.update(b",")
                else:
                    if at is not None:
                        out.append((*at, state.hexdigest()))
                    at, state = key, sha256()
                state.update(b.column("piece")[i].as_py())
        if at is not None:
            out.append((*at, state.hexdigest()))
        node, depth, hexes = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(depth, pa.int64()), pa.array(hexes, pa.string())], names=["conv_id", "depth", "ends_sha256"])

    sort = ["node", "depth", "member"]
    pieces = stops.repartitionByRange(n, *sort).sortWithinPartitions(*sort).mapInArrow(joined, "node long, depth long, member long, piece binary")
    return pieces.repartition(n, "node", "depth").sortWithinPartitions(*sort).mapInArrow(hashed, "conv_id long, depth long, ends_sha256 string")


def doubled(heavy: DataFrame, tables: Scratch) -> DataFrame:
    """Nodes (conv_id, depth, parent_conv_id, leaves, saved) with their subtrees' sums in leaves and saved."""
    state = tables.put(heavy.select("conv_id", "depth", F.col("parent_conv_id").alias("up"), "leaves", "saved"))
    jump = 1
    while state.where("up is not null").limit(1).count():
        below = state.where("up is not null").groupBy(F.col("up").alias("conv_id"), (F.col("depth") - jump).alias("depth"))
        below = below.agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        above = state.select(F.col("conv_id").alias("up"), (F.col("depth") + jump).alias("depth"), F.col("up").alias("next"))
        got = state.join(below, ["conv_id", "depth"], "left").join(above, ["up", "depth"], "left")
        state = tables.put(got.select("conv_id", "depth", F.col("next").alias("up"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")))
        tables.drop(tables.n - 1)
        jump *= 2
    return state


def prefix_trie(conversations: DataFrame, shard_rows: int = SHARD) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row a node."""
    spark = conversations.sparkSession
    tables = Scratch(spark)
    rows = tables.put(prefixes(conversations))
    name = ["depth", "p1", "p2"]
    nodes = rows.groupBy(*name).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("words").alias("words"), F.first("q1").alias("q1"), F.first("q2").alias("q2"), F.sum(F.col("length") - F.col("depth") + 1).alias("below"))
    heavy = tables.put(nodes.where((F.col("below") > shard_rows) | (F.col("depth") == 0)).drop("below"))
    marked = rows.join(heavy.select(*name, F.lit(True).alias("is_heavy")), name, "left")
    first_light = F.min_by(F.struct("depth", "p1", "p2"), F.when(F.col("is_heavy").isNull(), F.col("depth")))
    stop = F.max_by(F.struct("p1", "p2", "is_heavy"), "depth")
    members = tables.put(marked.groupBy("conv_id").agg(first_light.alias("shard"), stop.alias("stop"), F.max("length").alias("length")))

    shard = members.where("shard is not null").select("conv_id", F.col("shard.depth").alias("top"), F.col("shard.p1").alias("s1"), F.col("shard.p2").alias("s2"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    light = rows.join(shard, "conv_id").where("depth >= top").select(*PREFIX, "top", "s1", "s2")
    light = tables.put(light.repartition(n, "s1", "s2").sortWithinPartitions("s1", "s2").mapInArrow(lambda batches: shards(batches, max(shard_rows, FOREST)), NODE))

    # What heavy nodes have from the shards below them and from heavy children.
    up = [(F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")]
    tops = light.where("q1 is not null")
    below = tops.groupBy(*up).agg(F.count("*").alias("n"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
    inner = heavy.where("depth > 0").groupBy(*up).agg(F.count("*").alias("m"))
    called = heavy.select(*name, F.col("conv_id").alias("parent_conv_id"))
    above = called.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), "parent_conv_id")
    zero = F.lit(0).cast("long")
    children = F.coalesce("n", zero) + F.coalesce("m", zero)
    full = heavy.join(below, name, "left").join(inner, name, "left").join(above, ["depth", "q1", "q2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", children.alias("n_children"),
        F.when(children == 0, F.lit(1).cast("long")).otherwise(F.coalesce("l", zero)).alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("words") + F.coalesce("s", zero)).alias("saved"),
    )
    full = tables.put(full)
    sums = doubled(full, tables).select("conv_id", "depth", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    stops = members.where("stop.is_heavy").select(F.col("length").alias("depth"), F.col("stop.p1").alias("p1"), F.col("stop.p2").alias("p2"), F.col("conv_id").alias("member"))
    ends = ends_of(stops.join(called, name).select(F.col("parent_conv_id").alias("node"), "depth", "member"))
    upper = full.join(sums, ["conv_id", "depth"]).join(ends, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))

    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    topped = tops.drop("parent_conv_id").join(above, ["depth", "q1", "q2"])
    return upper.select(*columns).unionByName(topped.select(*columns)).unionByName(light.where("q1 is null").select(*columns))
