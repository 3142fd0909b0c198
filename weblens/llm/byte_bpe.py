"""Byte-level BPE encoding and decoding by a public rank file.

Texts are cut into pieces as the public pattern cuts them (contractions, a space with the letters, numbers or other signs
after it, white space), without a regular expression: code points become classes through one table, a class looks one or two
places ahead where the pattern does, and the state of a small automaton before each character follows from the transition
functions of the classes before it. These functions are closed under composition, so each is a number, two are composed by a
table, and the prefixes of all characters of many texts are found by an associative scan: side by side in blocks, then over
the blocks' totals. A piece begins where the state and the class say so. Each distinct piece is merged once, always the pair
of least rank, the leftmost of equal ones, side by side with the other new pieces, and cached; its tokens' ends are kept, so
that tokens point into the text.

The rank file is read on the driver and broadcast: its size is bounded by the vocabulary, not by the input. There is no
shuffle. A worker holds one Arrow batch (which Spark bounds by bytes), works on ``CHARS_AT_ONCE`` characters or one text at a
time and caches ``PIECES`` pieces at most; a piece of any length is merged in n log n steps.

Null texts are empty, and empty texts have no tokens. Special tokens are ordinary text. Equal rows and rows with a null id
are rows of their own; bytes that are not UTF-8 become U+FFFD. Decoding joins the tokens' bytes: null ids are no tokens, and
an id that the file doesn't have is an error. An empty table gives an empty one; other columns are not read.
"""

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.llm.common import lists

#: Characters of whole texts that are cut together.
CHARS_AT_ONCE = 2_000_000
#: Tokens of whole rows that are decoded together.
TOKENS_AT_ONCE = 500_000
#: Pieces with their tokens that a worker remembers; beyond that it starts anew.
PIECES = 500_000
#: Longest piece in bytes that is merged in rounds with others; a longer one is merged by itself with a heap.
SIDE_BY_SIDE = 64
#: Ids and places are below these, and no pair has a rank of NONE.
WIDE, PLACES, NONE = 1 << 24, 1 << 36, 1 << 24

# Classes of characters. BOUND stands between texts; a contraction is named by the letters after its apostrophe; white space
# that ends before a sign is a class of its own, as the pattern leaves such a place to what follows.
LETTER, NUMBER, OTHER, SPACE, BLANK, BOUND, ONE_AFTER, TWO_AFTER, LAST_SPACE, LAST_BLANK = range(10)
# States: what the last character leaves open.
FRESH, LETTERS, NUMBERS, OTHERS, LED, BLANKS, LAST_OF_TWO, FIRST_OF_TWO = range(8)
CLASSES, STATES = 10, 8
APOSTROPHE = 0x27
#: What makes a contraction after an apostrophe.
ONE_LETTER, TWO_LETTERS = ("s", "t", "m", "d"), ("re", "ve", "ll")


def step(state: int, kind: int) -> tuple[int, bool]:
    """The state after a character and whether a piece begins with it."""
    if kind == BOUND:
        return FRESH, True
    if kind in (SPACE, BLANK):
        return BLANKS, state != BLANKS
    if kind == LAST_SPACE:
        return LED, True
    if kind == LAST_BLANK:
        return FRESH, True
    if kind == LETTER and state in (LAST_OF_TWO, FIRST_OF_TWO):
        return (FRESH if state == LAST_OF_TWO else LAST_OF_TWO), False
    if kind in (ONE_AFTER, TWO_AFTER) and state not in (OTHERS, LED):
        return (LAST_OF_TWO if kind == ONE_AFTER else FIRST_OF_TWO), True
    run = {LETTER: LETTERS, NUMBER: NUMBERS}.get(kind, OTHERS)
    return run, state not in (run, LED)


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(function of each class, composition of two functions, state that each function leads to from FRESH, whether a
    character of a class begins a piece in a state)."""
    basic = [tuple(step(s, k)[0] for s in range(STATES)) for k in range(CLASSES)]
    number: dict[tuple, int] = {tuple(range(STATES)): 0}
    waiting = [tuple(range(STATES))]
    while waiting:
        f = waiting.pop()
        for g in basic:
            both = tuple(g[x] for x in f)
            if both not in number:
                number[both] = len(number)
                waiting.append(both)
    known = list(number)
    then = np.array([[number[tuple(g[x] for x in f)] for g in known] for f in known], dtype=np.uint16)
    begins = np.array([[step(s, k)[1] for k in range(CLASSES)] for s in range(STATES)])
    return np.array([number[b] for b in basic], dtype=np.uint16), then, np.array([f[FRESH] for f in known], dtype=np.uint8), begins


def scanned(functions: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Each place's composition of all functions up to it."""
    n = len(functions)
    if n <= 256:
        out = functions.copy()
        for i in range(1, n):
            out[i] = then[out[i - 1], out[i]]
        return out
    width, flat = 64, then.ravel()
    both = lambda f, g: flat.take(f.astype(np.intp) * len(then) + g)
    blocks = np.zeros((width, -(-n // width)), dtype=np.uint16)  # column by column: block j holds places j * width and on
    blocks.T.flat[:n] = functions
    for i in range(1, width):
        blocks[i] = both(blocks[i - 1], blocks[i])
    totals = scanned(blocks[-1], then)
    blocks[:, 1:] = both(totals[:-1][None, :], blocks[:, 1:])
    return np.ascontiguousarray(blocks.T).reshape(-1)[:n]


@lru_cache(1)
def class_of() -> np.ndarray:
    """The class of every code point; the last stands for the place between texts."""
    out = np.full(0x110001, OTHER, dtype=np.uint8)
    for cp in range(0x110000):
        major = unicodedata.category(chr(cp))[0]
        if major == "L":
            out[cp] = LETTER
        elif major == "N":
            out[cp] = NUMBER
    # White space of the pattern, which are the characters with the property White_Space.
    out[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK
    out[0x20], out[0x110000] = SPACE, BOUND
    return out


def classes(points: np.ndarray) -> np.ndarray:
    """The classes of characters in their places; the last place must be one between texts."""
    table = class_of()
    kinds = table[points]
    white = (kinds == SPACE) | (kinds == BLANK)
    last = np.flatnonzero(white[:-1] & ~white[1:] & (kinds[1:] != BOUND))
    kinds[last] += LAST_SPACE - SPACE
    quotes = np.flatnonzero(points == APOSTROPHE)
    if len(quotes):
        first, second = points[quotes + 1], points[np.minimum(quotes + 2, len(points) - 1)]
        kinds[quotes[np.isin(first, [ord(c) for c in ONE_LETTER])]] = ONE_AFTER
        for a, b in TWO_LETTERS:
            kinds[quotes[(first == ord(a)) & (second == ord(b))]] = TWO_AFTER
    return kinds


def begins(points: np.ndarray) -> np.ndarray:
    """Places where a piece, or the place between texts, begins."""
    function, then, reached, first = automaton()
    kinds = classes(points)
    after = reached[scanned(function[kinds], then)]
    before = np.concatenate([np.array([FRESH], np.uint8), after[:-1]])
    return np.flatnonzero(first[before, kinds])


class Merges:
    """Tokens of pieces, each merged once and remembered as a stretch of two arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        # Every way to put a token together from two, in order, for looking up many pairs at once.
        pairs = {ranks[t[:i]] * WIDE + ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.found = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.single = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.forget()

    def forget(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.ids, self.ends, self.starts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def of(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ends within their piece, number of tokens of each piece)"""
        missing = set(pieces).difference(self.slot)
        if missing and len(self.slot) + len(missing) > PIECES:
            self.forget()
            missing = set(pieces)
        if missing:
            self.learn(list(missing))
        at = np.fromiter(map(self.slot.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        counts = self.starts[at + 1] - self.starts[at]
        places = np.repeat(self.starts[at] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        return self.ids[places], self.ends[places], counts

    def learn(self, pieces: list[bytes]) -> None:
        alone = [p for p in pieces if p in self.ranks or len(p) > SIDE_BY_SIDE]
        short = [p for p in pieces if p not in self.ranks and len(p) <= SIDE_BY_SIDE]
        merged = [((self.ranks[p],), (len(p),)) if p in self.ranks else self.merged(p) for p in alone]
        ids, ends, counts = self.side_by_side(short)
        counts = np.concatenate([[len(i) for i, _ in merged], counts]).astype(np.int64)
        self.slot.update(zip([*alone, *short], range(len(self.slot), len(self.slot) + len(pieces)), strict=True))
        self.ids = np.concatenate([self.ids, *(np.array(i, np.int32) for i, _ in merged), ids.astype(np.int32)])
        self.ends = np.concatenate([self.ends, *(np.array(e, np.int64) for _, e in merged), ends])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])

    def ranked(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens, NONE where they make none."""
        keys = first * WIDE + second
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.found[at], NONE)

    def side_by_side(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merge many pieces at once: a round merges the first pair of least rank of each piece that has one left."""
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        token = self.single[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        end = np.arange(1, len(token) + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        rank = np.full(len(token), NONE)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inner] = self.ranked(token[inner], token[inner + 1])
        ready = []
        while len(token):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            least = np.minimum.reduceat(rank * PLACES + np.arange(len(rank)), starts)
            done = least >= NONE * PLACES
            ended = np.repeat(done, np.diff(starts, append=len(token)))
            ready.append((owner[ended], token[ended], end[ended]))
            at = least[~done] % PLACES
            token[at], end[at] = rank[at], end[at + 1]
            stays = ~ended
            stays[at + 1] = False
            at = (np.cumsum(stays) - 1)[at]
            token, owner, end, rank = token[stays], owner[stays], end[stays], rank[stays]
            # Only the pairs at a merged token changed.
            rank[at] = NONE
            right = at[at + 1 < len(token)]
            right = right[owner[right] == owner[right + 1]]
            rank[right] = self.ranked(token[right], token[right + 1])
            left = at[at > 0]
            left = left[owner[left - 1] == owner[left]] - 1
            rank[left] = self.ranked(token[left], token[left + 1])
        owner, token, end = (np.concatenate(x) for x in zip(*ready, strict=True)) if ready else (np.zeros(0, np.int64),) * 3
        order = np.argsort(owner, kind="stable")
        return token[order], end[order], np.bincount(owner, minlength=len(pieces))

    def merged(self, piece: bytes) -> tuple[tuple[int, ...], tuple[int, ...]]:
        """Parts are chained by their starts; a heap names the pairs, and those that changed since are passed over."""
        rank, n = self.ranks.get, len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = bytearray(b"\1") * n
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, middle, end = heapq.heappop(heap)
            if not alive[i] or after[i] != middle or middle >= n or not alive[middle] or after[middle] != end:
                continue
            alive[middle] = 0
            after[i] = end
            if end < n:
                before[end] = i
                if (r := rank(piece[i : after[end]])) is not None:
                    heapq.heappush(heap, (r, i, end, after[end]))
            if (b := before[i]) >= 0 and (r := rank(piece[b:end])) is not None:
                heapq.heappush(heap, (r, b, i, end))
        ids, ends, i = [], [], 0
        while i < n:
            ids.append(self.ranks[piece[i : after[i]]])
            ends.append(after[i])
            i = after[i]
        return tuple(ids), tuple(ends)


def rank_file(path: str) -> dict[bytes, int]:
    """Ranks of tokens by their bytes, of a file with a token in base 64 and its rank a line."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if any(bytes([i]) not in ranks for i in range(256)):
        raise ValueError("every single byte needs a rank")
    return ranks


def encoded(texts: list[str], merges: Merges) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, ends in bytes) of each text."""
    ends_of = np.cumsum([len(t) + 1 for t in texts])
    points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), dtype=np.uint32).copy()
    points[ends_of - 1] = 0x110000
    starts = begins(points)
    # Places in bytes: those between texts take none.
    sizes = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    sizes[ends_of - 1] = 0
    at = np.concatenate([[0], np.cumsum(sizes)])
    data = "".join(texts).encode()
    cuts = at[starts]
    bounds = np.searchsorted(starts, ends_of - 1)
    # The place between texts begins a piece of no bytes, which is left out.
    spaces = np.zeros(len(starts), dtype=bool)
    spaces[bounds] = True
    inside = np.flatnonzero(~spaces)
    ids, ends, counts = merges.of([data[a:b] for a, b in zip(cuts[inside].tolist(), cuts[inside + 1].tolist(), strict=True)])
    ends += np.repeat(cuts[inside], counts)
    tokens = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(inside, bounds)]
    base = np.concatenate([[0], at[ends_of[:-1]]])
    return [(ids[a:b], ends[a:b] - shift) for a, b, shift in zip([0, *tokens[:-1].tolist()], tokens.tolist(), base.tolist(), strict=True)]


@lru_cache(1)
def merges_of(shared: Broadcast) -> Merges:
    """The tables of a broadcast rank file, made once a worker; what it learns in a task is forgotten after it."""
    return Merges(shared.value)


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(doc_id, ids, ends) of documents: the tokens of each text and where they end, in bytes of its UTF-8."""
    shared = docs.sparkSession.sparkContext.broadcast(rank_file(path))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = merges_of(shared)
        for b in batches:
            ids, raw = b.column("doc_id"), b.column("text").cast(pa.binary())
            begin = 0
            while begin < len(raw):
                texts, n = [], 0
                while begin + len(texts) < len(raw) and (not texts or n < CHARS_AT_ONCE):
                    t = (raw[begin + len(texts)].as_py() or b"").decode("utf-8", "replace")
                    texts.append(t)
                    n += len(t)
                found = encoded(texts, merges)
                columns = [ids.slice(begin, len(texts)), lists([i for i, _ in found], pa.int32()), lists([e for _, e in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "ends"])
                begin += len(texts)
        merges.forget()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(tokens, "doc_id long, ids array<int>, ends array<long>")


def spelt(rows: pa.ListArray, numbers: np.ndarray, of: pa.Array) -> pa.Array:
    """The bytes of each row's tokens, laid end to end; rows without a list have none. Ids that ``numbers`` lacks are an error."""
    # Rows without a list take no place among the values; a null id is no token.
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False))])
    flat = rows.flatten()
    null = flat.is_null().to_numpy(zero_copy_only=False)
    ids = pc.fill_null(flat, int(numbers[0])).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.minimum(np.searchsorted(numbers, ids), len(numbers) - 1)
    if (wrong := numbers[at] != ids).any():
        raise KeyError(f"no token has the id {ids[wrong][0]}")
    taken = of.take(pa.array(at, mask=null))
    data, places = taken.buffers()[2], np.frombuffer(taken.buffers()[1], dtype=np.int64, count=len(at) + 1)
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(places[ends].tobytes()), data]).cast(pa.binary())


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """The table with ``decoded``, the bytes of the tokens in ``ids``, in place of its ids; other columns stay."""
    known = sorted((i, t) for t, i in rank_file(path).items())
    shared = tokens.sparkSession.sparkContext.broadcast((np.array([i for i, _ in known], dtype=np.int64), [t for _, t in known]))
    kept = [c for c in tokens.columns if c not in ("ids", "decoded")]

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, of = shared.value[0], pa.array(shared.value[1], pa.large_binary())
        for b in batches:
            ends, begin = np.cumsum(pc.fill_null(pc.list_value_length(b.column("ids")), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
            while begin < b.num_rows:
                upto = int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + TOKENS_AT_ONCE, side="right"))
                part = b.slice(begin, max(1, upto - begin))
                begin += part.num_rows
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), spelt(part.column("ids"), numbers, of)], names=[*kept, "decoded"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields if f.name in kept]
    return tokens.select(*(F.col(f"`{c}`") for c in kept), "ids").mapInArrow(texts, ", ".join([*fields, "decoded binary"]))
