import hashlib
import random
import re

from weblens.llm import secrets


def either_case(word):
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + either_case("api") + "_?" + either_case("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def expected(text):
    text = text or ""
    spans = [(m.start(), 0, "assign", m.end()) for m in re.finditer(ASSIGN, text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    spans.sort()
    base = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
    return [sum(k == kind for _, _, k, _ in spans) for kind in ("assign", "access", "hex")], base


def texts(seed):
    r = random.Random(seed)
    parts = ["password", "PassWd", "token", "SECRET", "api_key", "apikey", "=", ":", " = ", '"', "'", " ", "\n", "abc", "abcdefgh1", "AKIA", "AKIAABCDEFGHIJKL", "0123456789abcdef" * 2, "dead", "é", "𝒳", "==", "ghp_" + "a" * 36, "K"]
    return ["".join(r.choices(parts, k=r.choice([0, 3, 8, 20, 60]))) for _ in range(400)] + [None, "", "password: token: abcdefghij", "x" * 200_000 + " token=abcdefgh", "ſecret=abcdefghi"]


def test_spans_as_python_finds_them(spark):
    rows = [(i, t, f"src{i % 7}", 1) for i, t in enumerate(texts(3))] + [(0, "token=abcdefgh", None, 1), (None, "AKIAABCDEFGHIJKL", "src1", 2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, spans int")
    got = secrets.secret_scan(frame).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), *expected(t)[0], hashlib.sha256(expected(t)[1].encode()).hexdigest()) for i, t, _, _ in rows)
    assert sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    for r in got:
        base = ",".join(s for s in r.spans.split(",") if not s.startswith("vendor"))
        assert hashlib.sha256(base.encode()).hexdigest() == r.base_sha256


def test_ownership_separates_examples(spark):
    rows = [(i, f"token=copied{'q' * 9}", f"o{i}/r") for i in range(5)] + [(9, "token=owned4Zz81kq", "o1/a"), (10, "token=owned4Zz81kq", "o1/b"), (11, "secret=your_secret_here", "o2/a")]
    got = {r.doc_id: (r.n_live, r.n_example) for r in secrets.secret_scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {**{i: (0, 1) for i in range(5)}, 9: (1, 0), 10: (1, 0), 11: (0, 1)}


def test_redaction(spark):
    rows = [(1, "é token=owned4Zz81kq end", "a", 1), (2, "nothing", "a", 2), (3, None, None, 3), (4, "k=" + "0a" * 20 + " password=" + "1b" * 20, "b", 4), (1, "é token=owned4Zz81kq end", "a", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, judged int")
    got = secrets.redacted(frame)
    assert got.columns == frame.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "é [SECRET] end", "a", 1)] * 2 + [(2, "nothing", "a", 2), (3, None, None, 3), (4, "k=[SECRET] [SECRET]", "b", 4)], key=str)


def test_owners_of_another_corpus(spark):
    before = spark.createDataFrame([(i, f"token=copied{'q' * 9}", f"o{i}/r") for i in range(5)], "doc_id long, text string, source string")
    left = spark.createDataFrame([(1, f"token=copied{'q' * 9}", "o1/r"), (7, "token=owned4Zz81kq", "o7/r")], "doc_id long, text string, source string")
    owned = secrets.ownership(secrets.candidates(before))
    assert {r.doc_id: r.text for r in secrets.redacted(left, owned).collect()} == {1: f"token=copied{'q' * 9}", 7: "[SECRET]"}
    assert {r.text for r in secrets.redacted(left).collect()} == {"[SECRET]"}


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, source string")
    assert secrets.secret_scan(frame).collect() == [] == secrets.redacted(frame).collect()
