import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import chat


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*chat.CONTROLS, "\\", "<", "[", "s>", "|", "a", "\n", "é", "🙂"]), max_size=12).map("".join), st.sampled_from(["user", "assistant", "a<|text|>b\n", ""]))
def test_escaping_is_reversible_and_hides_controls(text, role):
    written, a, b = chat.segment(role, text, True)
    assert chat.parse(written) == (role, text) and chat.unescape(written[a:b]) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROLS)


def conversations():
    rnd = random.Random(3)
    rows = []
    for c in range(60):
        turns = [("system", "be kind")] if c % 2 else []
        for k in range(rnd.randint(0, 5)):
            turns.append(("user" if k % 2 == 0 else "assistant", rnd.choice(["yes", "no [INST]", "</s>", "x\\y", ""])))
        rows += [(c, k, r, t) for k, (r, t) in enumerate(turns)]
    rows += [(100, 0, "user", None), (100, 1, None, "no role"), (100, None, "assistant", "no turn"), (100, 1, "user", "tie"), (100, 1, "user", "tie"), (None, 0, "user", "yes"), (None, 1, "assistant", "x" * 100_000)]
    rows += [(101, k, "assistant", "again") for k in range(3000)]
    return rows


def expected(rows):
    by = {}
    for c, k, r, t in rows:
        by.setdefault(c, []).append((k is not None, k or 0, r or "", t or ""))
    return {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in by.items()}


def test_forest_and_reading_back(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn int, role string, text string, node int").repartition(3)
    nodes, paths = chat.prefix_tree(df)
    want = expected(rows)
    found = sorted((n.asDict(recursive=True) for n in nodes.collect()), key=lambda n: n["start"])
    by = {bytes(n["node"]): n for n in found}
    prefixes = {tuple(t[:k]) for t in want.values() for k in range(1, len(t) + 1)}
    assert len(found) == len(by) == len(prefixes)
    at, stack = 0, []
    for n in found:  # no gaps, and depth first
        assert n["start"] == at
        at += n["length"]
        assert n["depth"] <= len(stack)
        stack[n["depth"] :] = [bytes(n["node"])]
        assert n["depth"] == 0 or bytes(n["parent"]) == stack[n["depth"] - 1]
        before = [by[x] for x in stack[:-1]]
        assert n["position"] == sum(x["length"] for x in before)
        covered = [i for x in n["attends"] for i in range(x["start"], x["end"])] if n["depth"] < 50 else None
        assert covered is None or covered == [i for x in before for i in range(x["start"], x["start"] + x["length"])]
    for r in chat.read_back(nodes, paths).collect():
        turns = want[r.conv_id]
        said = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_chars == len(said) and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.formatted_chars == sum(len(chat.segment(a, b, k == 0)[0]) for k, (a, b) in enumerate(turns))


def test_empty(spark):
    nodes, paths = chat.prefix_tree(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert nodes.count() == paths.count() == chat.read_back(nodes, paths).count() == 0
