import itertools
import random

import pytest

from weblens.llm import chat


def brute_path(model, seq):
    """The best of all paths."""
    def score(path):
        total = 0.0
        for n, (s, line) in enumerate(zip(path, seq, strict=True)):
            total += model.shown(line)[s] + (model.start[s] if n == 0 else model.moves(line)[path[n - 1]][s])
        return total

    return max(itertools.product(range(chat.S), repeat=len(seq)), key=score)


def model():
    r = random.Random(3)
    return chat.Model([5, 9, 1, 0], [[1, 20, 1, 0], [0, 3, 30, 1], [0, 28, 4, 2], [0, 1, 5, 0]], [[r.randrange(30) for _ in range(chat.SYMBOLS)] for _ in range(chat.S)])


@pytest.mark.parametrize("seed", range(6))
def test_viterbi_by_brute_force_whole_and_in_shares(seed):
    r, m = random.Random(seed), model()
    seq = [(r.choice([-1, -1, 0, 1, 2, 3]), r.randrange(chat.SYMBOLS), r.random() < 0.5, "") for _ in range(6)]
    best = list(brute_path(m, seq))
    assert m.path(seq, None, None) == best
    a, b = seq[:3], seq[3:]
    head, rest = m.summary(a, True)[0], m.summary(b, False)
    totals = {(i, j): head[i] + rest[i][j] for i in range(chat.S) for j in range(chat.S)}
    i, j = max(totals, key=totals.get)
    assert m.path(a, None, i) + m.path(b, i, j) == best


def conversations():
    r = random.Random(1)
    rows = []
    for c in range(60):
        rows += [(c, t, None if r.random() < 0.1 else "user" if t % 2 == 0 else "assistant", "how so?" if t % 2 == 0 else "line one\nline two " * 3) for t in range(r.choice([2, 4, 9]))]
    rows += [(1000, t, "Human" if t % 2 == 0 else "AI", f"q{t}?" if t % 2 == 0 else f"answer {t}\nand more of it") for t in range(900)]
    rows += [(2000, 0, None, "User: who is it?\nAssistant: nobody\nreally nobody\nUser: sure?\nAssistant: yes")]
    rows += [(None, None, None, None), (None, 1, "user", ""), (3000, 0, "user", "same"), (3000, 0, "user", "same"), (4000, 0, "wizard", "x" * 200_000)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_one_conversation_over_many_tasks_is_parsed_as_in_one(spark):
    frame = spark.createDataFrame(conversations(), SCHEMA)
    got = chat.chat_turns(frame).collect()
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "37"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert sorted(map(str, chat.chat_turns(frame.repartition(3)).collect())) == sorted(map(str, got))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert len({(x.conv_id, x.turn) for x in got}) == len({(c, t) for c, t, _, _ in conversations()})


def test_roles_turns_and_rendering(spark):
    got = chat.chat_turns(spark.createDataFrame(conversations(), SCHEMA)).collect()
    hidden = [x for x in got if x.conv_id is not None and x.conv_id < 60]
    assert sum(x.role == ("user" if x.turn % 2 == 0 else "assistant") for x in hidden) / len(hidden) > 0.98
    long_one = sorted((x for x in got if x.conv_id == 1000), key=lambda x: (x.turn, x.part))
    text = "".join(x.rendered for x in long_one)
    assert text.startswith("<|im_start|>user\nq0?<|im_end|>\n<|im_start|>assistant\nanswer 1\nand more of it<|im_end|>\n")
    assert text.count("<|im_start|>") == text.count("<|im_end|>") == 900
    embedded = sorted((x for x in got if x.conv_id == 2000), key=lambda x: x.part)
    assert [x.role for x in embedded] == ["user", "assistant", "user", "assistant"]
    assert "".join(x.rendered for x in embedded) == "<|im_start|>user\nwho is it?<|im_end|>\n<|im_start|>assistant\nnobody\nreally nobody<|im_end|>\n<|im_start|>user\nsure?<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n"


def test_clashing_names_and_no_rows(spark):
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in conversations()[:20]], SCHEMA + ", salt int, part int, rendered int")
    assert chat.chat_turns(frame).columns == ["conv_id", "turn", "part", "role", "opens", "rendered"] and chat.chat_turns(frame).count() >= 20
    assert chat.chat_turns(frame.limit(0)).collect() == []
