"""Encoding against the public library, decoding as a round trip."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from weblens.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
SIGNS = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", " ", "　", "a", "É", "é", "1", "٣", "½", "!", "…", "😀", "日", "'s", "S", "x", "\x00", "\x85", "​", "r", "e", "v", "l"]


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.rank_file(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def same(texts, ranks, library):
    merges = byte_bpe.Merges(ranks)
    token = {i: t for t, i in ranks.items()}
    for text, (ids, ends) in zip(texts, byte_bpe.encoded(texts, merges), strict=True):
        assert ids.tolist() == library.encode_ordinary(text), text[:80]
        raw = text.encode()
        assert [raw[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)] == [token[i] for i in ids.tolist()]


def test_as_the_library_cuts_and_merges(ranks, library):
    r = random.Random(2)
    same(["".join(r.choices(SIGNS, k=r.choice([0, 1, 2, 3, 5, 8, 20, 60, 300]))) for _ in range(3000)], ranks, library)


def test_every_code_point(ranks, library):
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for a in range(0, len(points), 100_000):
        merges = byte_bpe.Merges(ranks) if a == 0 else merges
        texts = [f"a{chr(c)}1{chr(c)} {chr(c)}!" for c in points[a : a + 100_000]]
        wrong = [t for t, (ids, _) in zip(texts, byte_bpe.encoded(texts, merges), strict=True) if ids.tolist() != library.encode_ordinary(t)]
        assert wrong == []


def test_long_pieces(ranks, library):
    same(["a" * 30_001, "!?" * 10_000, " " * 5_000, "é" * 3_000 + " b", "x" * 64, "x" * 65], ranks, library)


def test_merging_side_by_side_equals_the_heap_and_forgetting_changes_nothing(ranks, library, monkeypatch):
    r = random.Random(4)
    texts = [" ".join("".join(r.choices("abcdeéèst'", k=r.randint(1, 30))) for _ in range(50)) for _ in range(20)]
    monkeypatch.setattr(byte_bpe, "SIDE_BY_SIDE", 0)
    same(texts, ranks, library)
    monkeypatch.setattr(byte_bpe, "SIDE_BY_SIDE", 64)
    monkeypatch.setattr(byte_bpe, "PIECES", 40)
    merges = byte_bpe.Merges(ranks)
    for t in texts:
        assert byte_bpe.encoded([t], merges)[0][0].tolist() == library.encode_ordinary(t)


def test_scan_equals_a_walk():
    function, then, reached, _ = byte_bpe.automaton()
    r = random.Random(1)
    for n in (1, 63, 64, 65, 256, 257, 5000, 20_000):
        kinds = np.array([r.randrange(byte_bpe.CLASSES) for _ in range(n)])
        state, want = byte_bpe.FRESH, []
        for k in kinds.tolist():
            state = byte_bpe.step(state, k)[0]
            want.append(state)
        assert reached[byte_bpe.scanned(function[kinds], then)].tolist() == want


def test_rows(spark, library):
    long = "wörter und zahlen 123 " * 3000
    rows = [(1, "it's  fine\n\nNow", 7), (1, "it's  fine\n\nNow", 7), (2, None, 7), (3, "", 7), (None, "   x", 7), (4, long, None), (5, "<|endoftext|>", 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3)
    tokens = byte_bpe.encode(frame, PATH)
    got = sorted((str(r.doc_id), r.ids) for r in tokens.collect())
    assert got == sorted((str(i), library.encode_ordinary(t or "")) for i, t, _ in rows)
    back = sorted((str(r.doc_id), bytes(r.decoded).decode()) for r in byte_bpe.decode(tokens, PATH).collect())
    assert back == sorted((str(i), t or "") for i, t, _ in rows)
    assert byte_bpe.encode(frame.where("false"), PATH).collect() == []
    lists = spark.createDataFrame([(1, None), (2, [None, 64])], "doc_id long, ids array<int>")
    assert sorted((r.doc_id, bytes(r.decoded)) for r in byte_bpe.decode(lists, PATH).collect()) == [(1, b""), (2, library.decode_single_token_bytes(64))]


def test_the_query_over_its_whole_table(spark, library):
    from hashlib import sha256

    from weblens.llm.queries import op12_byte_bpe

    sf = "/root/testdata/sf0.001"
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, op12_byte_bpe(spark, sf).collect())) == sorted(want)


def test_spelling_many_tokens_at_once(ranks):
    """Nulls, empty rows, slices and numbers with holes; ids without a token are an error; no step a token in Python."""
    import time

    import pyarrow as pa

    token = {2 * i + 5: t for t, i in ranks.items()}
    numbers, of = np.array(sorted(token)), pa.array([token[i] for i in sorted(token)], pa.large_binary())
    rng = random.Random(3)
    rows = [None, [], [None], [5, None, 7], *([rng.choice(numbers).item() for _ in range(rng.randrange(400))] for _ in range(1000))]
    column = pa.array(rows, pa.list_(pa.int32()))
    began = time.process_time()
    got = byte_bpe.spelt(column, numbers, of)
    took = time.process_time() - began
    began = time.process_time()
    want = [b"".join(token[t] for t in (column[i].as_py() or ()) if t is not None) for i in range(len(column))]
    assert got.to_pylist() == want and took < (time.process_time() - began) / 2
    assert byte_bpe.spelt(column.slice(3, 9), numbers, of).to_pylist() == want[3:12]
    assert byte_bpe.spelt(column.slice(0, 0), numbers, of).to_pylist() == []
    with pytest.raises(KeyError):
        byte_bpe.spelt(pa.array([[6]], pa.list_(pa.int32())), numbers, of)
