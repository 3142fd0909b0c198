"""Chat formatting: transcripts are parsed by a hidden Markov model and rendered as canonical turns.

The rows of a conversation, in the order of their turns, are cut into lines. A line shows a speaker marker (one that it
begins with, such as ``User:`` or ``### Assistant``, or, at the first line of a row, the row's role) or none, and some
features: whether it begins a row, its length, whether it ends as a question, whether it looks like code or a list. The
hidden states are the roles. Start, row-to-row and feature probabilities are counted over all rows with a known role; a
marker names its role with a fixed small chance of error, so that a marker that contradicts its surroundings can be
overruled and rows without one get the likeliest role. Viterbi's best path gives each line its role; runs of one role
become turns.

A conversation may hold any share of the rows. Rows are sorted into ranges, so a conversation may run through many tasks;
each task sums up its share of a conversation that crosses its edges by the best score from each state before to each
state after it (at most two such matrices a task go to the driver), the driver chains them, and each task then traces its
share back between the states at its edges. The result is the best path of the whole conversation.

Null and empty texts are one empty line. A null conversation id is one conversation. Null turns come first; rows that tie
are ordered by role and text, and equal rows stay rows of their own. An unknown role is no marker. An empty table gives an
empty one. Parts of a row are numbered from 0; joined in order, ``rendered`` is the conversation.
"""

import math
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.llm.common import keep

ROLES = ("system", "user", "assistant", "tool")
# Names by which speakers are marked.
NAMES = {
    "system": ("system", "developer", "instruction", "instructions"),
    "user": ("user", "human", "prompter", "question", "customer"),
    "assistant": ("assistant", "ai", "bot", "gpt", "model", "chatbot", "answer", "response"),
    "tool": ("tool", "function", "observation"),
}
ROLE_OF = {name: i for i, names in enumerate(NAMES.values()) for name in names}
MARKER = re.compile(r"^[ \t]*(?:<\|(?:im_start\|>)?|\[|\*\*|#{1,4}[ \t]+)?(" + "|".join(sorted(ROLE_OF, key=len, reverse=True)) + r")(?:\|>|\]:?|:\*\*|\*\*:|:|(?=[ \t]*$))[ \t]*", re.IGNORECASE)
#: Chance that a marker is wrong, and that a line inside a row has another role than the one before.
WRONG, SWITCH = 0.02, 0.01
#: Features of a line.
SYMBOLS = 32
S = len(ROLES)


def lines(role: str | None, text: str | None) -> list[tuple[int, int, bool, str]]:
    """(marker or -1, symbol, whether a row begins, text without marker) of a row's lines."""
    out = []
    for i, line in enumerate((text or "").split("\n")):
        found = MARKER.match(line)
        marker = ROLE_OF[found[1].lower()] if found and not (found.end() == len(line) and ":" not in found[0] and found[0].strip().isalpha()) else -1
        body = line[found.end() :] if marker >= 0 else line
        if marker < 0 and i == 0:
            marker = ROLE_OF.get((role or "").strip().lower(), -1)
        out.append((marker, symbol(body, i == 0), i == 0, body))
    return out


def symbol(line: str, begins: bool) -> int:
    length = min(3, len(line).bit_length() // 3)
    return length + 4 * line.rstrip().endswith("?") + 8 * line.startswith(("    ", "\t", "- ", "* ", "```", "{", "|", "1.")) + 16 * begins


class Model:
    """Log probabilities: start, row-to-row, features."""

    def __init__(self, start: list[int], step: list[list[int]], seen: list[list[int]]):
        logs = lambda row: [math.log((x + 1) / (sum(row) + len(row))) for x in row]
        self.start, self.step, self.seen = logs(start), [logs(r) for r in step], [logs(r) for r in seen]
        self.stay = [[math.log(1 - SWITCH if i == j else SWITCH / (S - 1)) for j in range(S)] for i in range(S)]
        self.right, self.wrong = math.log(1 - WRONG), math.log(WRONG / (S - 1))

    def shown(self, line: tuple) -> list[float]:
        marker, sym = line[0], line[1]
        return [self.seen[s][sym] + (0.0 if marker < 0 else self.right if marker == s else self.wrong) for s in range(S)]

    def moves(self, line: tuple) -> list[list[float]]:
        return self.step if line[2] or line[0] >= 0 else self.stay

    def follow(self, before: list[float], line: tuple) -> tuple[list[float], list[int]]:
        """Best scores after a line and where they come from; ties go to the state named first."""
        move, shown = self.moves(line), self.shown(line)
        came = [max(range(S), key=lambda i: before[i] + move[i][j]) for j in range(S)]
        return [before[came[j]] + move[came[j]][j] + shown[j] for j in range(S)], came

    def summary(self, seq: list[tuple], first: bool) -> list[list[float]]:
        """From each state before a share of a conversation to each state after it."""
        rows = [[0.0 if i == j else -math.inf for j in range(S)] for i in range(S)]
        for n, line in enumerate(seq):
            rows = [[a + b for a, b in zip(self.start, self.shown(line), strict=True)]] * S if first and n == 0 else [self.follow(r, line)[0] for r in rows]
        return rows

    def path(self, seq: list[tuple], entry: int | None, leave: int | None) -> list[int]:
        """The best states of a share that follows ``entry`` (None: a start) and ends in ``leave`` (None: in the best)."""
        score, back = [0.0 if i == entry else -math.inf for i in range(S)], []
        for n, line in enumerate(seq):
            if n == 0 and entry is None:
                score, came = [a + b for a, b in zip(self.start, self.shown(line), strict=True)], [0] * S
            else:
                score, came = self.follow(score, line)
            back.append(came)
        at = max(range(S), key=score.__getitem__) if leave is None else leave
        out = [at]
        for came in reversed(back[1:]):
            out.append(at := came[at])
        return out[::-1]


def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple]]]:
    """The conversations of a task's rows, one after the other."""
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True))
    for conv, group in groupby(rows, key=lambda r: r[0]):
        yield conv, list(group)


def fit(ordered: DataFrame) -> Model:
    """Counts over all rows with a known role. Neighbours in different tasks count too."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, seen, start, edge, role = [0] * (S * S), [0] * (S * SYMBOLS), [0] * S, [], None
        for n, (conv, rows) in enumerate(shares(batches)):
            was = None
            for k, r in enumerate(rows):
                role = ROLE_OF.get((r[2] or "").strip().lower())
                if k == 0 and n == 0:
                    edge = [conv, role]
                elif k == 0 and role is not None:
                    start[role] += 1
                if was is not None and role is not None:
                    step[was * S + role] += 1
                if role is not None:
                    for line in lines(None, r[3]):
                        seen[role * SYMBOLS + line[1]] += 1
                was = role
        if edge:
            columns = [[TaskContext.get().partitionId()], [edge[0]], [edge[1]], [conv], [role], [step], [seen], [start]]
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["pid", "c1", "r1", "c2", "r2", "step", "seen", "start"])

    got = sorted(ordered.mapInArrow(count, "pid int, c1 long, r1 int, c2 long, r2 int, step array<long>, seen array<long>, start array<long>").collect())  # one row a task
    add = lambda name, n: [sum(r[name][i] for r in got) for i in range(n)]
    step, seen, start = add("step", S * S), add("seen", S * SYMBOLS), add("start", S)
    for i, r in enumerate(got):
        before = got[i - 1] if i else None
        if before is None or before.c2 != r.c1:
            if r.r1 is not None:
                start[r.r1] += 1
        elif before.r2 is not None and r.r1 is not None:
            step[before.r2 * S + r.r1] += 1
    return Model(start, [step[i * S : i * S + S] for i in range(S)], [seen[i * SYMBOLS : (i + 1) * SYMBOLS] for i in range(S)])


def sequence(rows: list[tuple]) -> list[tuple]:
    return [line for r in rows for line in lines(r[2], r[3])]


def edges(ordered: DataFrame, model: Model) -> dict[int, tuple]:
    """For each task: the state before its first conversation (None: it starts there), the state at the end of its last
    one (None: free), and whether that one goes on in the next task."""
    shared = ordered.sparkSession.sparkContext.broadcast(model)

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [c for b in batches if b.num_rows for c in (b.column("conv_id")[0].as_py(), b.column("conv_id")[-1].as_py())]
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([ends[0]], pa.int64()), pa.array([ends[-1]], pa.int64())], names=["pid", "c1", "c2"])

    tasks = sorted(ordered.select("conv_id").mapInArrow(names, "pid int, c1 long, c2 long").collect(), key=lambda r: r.pid)  # one row a task
    open_before = {b.pid: i > 0 and tasks[i - 1].c2 == b.c1 for i, b in enumerate(tasks)}
    open_after = {b.pid: i + 1 < len(tasks) and tasks[i + 1].c1 == b.c2 for i, b in enumerate(tasks)}
    crossing = {p for p in open_before if open_before[p] or open_after[p]}

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, m = TaskContext.get().partitionId(), shared.value
        found, n, last = [], 0, []
        if pid in crossing:
            for n, (_, rows) in enumerate(shares(batches)):
                last = rows
                if n == 0 and open_before[pid]:
                    found.append((True, m.summary(sequence(rows), False)))
            if open_after[pid] and (n > 0 or not open_before[pid]):
                found.append((False, m.summary(sequence(last), True)))
        yield pa.RecordBatch.from_arrays([pa.array([pid] * len(found), pa.int32()), pa.array([h for h, _ in found], pa.bool_()), pa.array([n == 0] * len(found), pa.bool_()), pa.array([sum(x, []) for _, x in found], pa.list_(pa.float64()))], names=["pid", "head", "only", "m"])

    got = ordered.mapInArrow(summed, "pid int, head boolean, only boolean, m array<double>").collect() if crossing else []  # two small matrices a task
    heads, tails = {r.pid: r for r in got if r.head}, {r.pid: r for r in got if not r.head}
    entry, leave, order = {}, {}, [b.pid for b in tasks]
    for i, pid in enumerate(order):
        if pid not in tails:
            continue
        chain, j = [(pid, tails[pid])], i + 1
        while j < len(order) and open_before[order[j]]:
            chain.append((order[j], heads[order[j]]))
            if not (heads[order[j]].only and open_after[order[j]]):
                break
            j += 1
        score, back = chain[0][1].m[:S], []
        for _, r in chain[1:]:
            came = [max(range(S), key=lambda a: score[a] + r.m[a * S + b]) for b in range(S)]
            score = [score[came[b]] + r.m[came[b] * S + b] for b in range(S)]
            back.append(came)
        at = max(range(S), key=score.__getitem__)
        states = [at]
        for came in reversed(back):
            states.append(at := came[at])
        states.reverse()
        leave[pid] = states[0]
        for (p, r), before, own in zip(chain[1:], states, states[1:], strict=False):
            entry[p] = before
            if r.only and open_after[p]:
                leave[p] = own
            else:
                leave[("head", p)] = own
    return {p: (entry.get(p), leave.get(("head", p)), leave.get(p), open_after[p]) for p in order}


def chat_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, part, role, opens, rendered) of rows (conv_id, turn, role, text)."""
    spark = rows.sparkSession
    slim = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = ["conv_id", "turn", F.coalesce("role", F.lit("")), F.xxhash64("role", "text"), "salt"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = slim.withColumn("salt", F.monotonically_increasing_id())
    ordered = keep(salted.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("salt"))
    model = fit(ordered)
    shared = spark.sparkContext.broadcast((model, edges(ordered, model)))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, at = shared.value
        entry, head, tail, goes_on = at.get(TaskContext.get().partitionId(), (None, None, None, False))
        found, n, held = [], 0, None

        def told(conv: int | None, group: list[tuple], last: bool, first: bool) -> Iterator[tuple]:
            before = entry if first else None
            leave = (head if first else None) if not last else (tail if goes_on else head if first else None)
            cut = [lines(r[2], r[3]) for r in group]
            states = m.path([x for c in cut for x in c], before, leave)
            i, was = 0, before
            for k, (r, c) in enumerate(zip(group, cut, strict=True)):
                runs = [(s, [x[3] for _, x in g]) for s, g in groupby(zip(states[i : i + len(c)], c, strict=True), key=lambda x: x[0])]
                i += len(c)
                for part, (s, body) in enumerate(runs):
                    opens = s != was
                    end = k == len(group) - 1 and part == len(runs) - 1 and not (last and goes_on)
                    start = ("" if was is None else "<|im_end|>\n") + f"<|im_start|>{ROLES[s]}\n" if opens else "\n"
                    yield conv, r[1], part, ROLES[s], opens, start + "\n".join(body) + ("<|im_end|>\n" if end else "")
                    was = s

        def batch(out: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv_id", "turn", "part", "role", "opens", "rendered"])

        for n, share in enumerate(shares(batches)):
            if held:
                found.extend(told(*held, False, n == 1))
            held = share
            if len(found) > 2000:
                yield batch(found)
                found = []
        if held:
            found.extend(told(*held, True, n == 0))
        if found:
            yield batch(found)

    return ordered.mapInArrow(render, "conv_id long, turn long, part int, role string, opens boolean, rendered string")
