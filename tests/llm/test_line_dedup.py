import random
import re

from spanloom.llm import line_dedup


def brute(rows):
    key = lambda i: 2**63 - 1 if i is None else i
    first = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        for s in range(len(lines) - 2):
            w = tuple(lines[s : s + 3])
            first[w] = min(first.get(w, (key(i), s)), (key(i), s))
    out = []
    for i, t in rows:
        if t is None:
            out.append((str(i), None, 0, 0))
            continue
        lines, gone = t.split("\n"), set()
        for s in range(len(lines) - 2):
            if first[tuple(lines[s : s + 3])] < (key(i), s):
                gone |= {s, s + 1, s + 2}
        out.append((str(i), "\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone)))
    return sorted(out, key=str)


def cases():
    rnd = random.Random(7)
    rows = [(i * 3, "\n".join(rnd.choices(["a", "b", "c", "", "d\r"], k=rnd.randint(1, 25)))) for i in range(120)]
    shared = "\n".join(f"line {k}" for k in range(6))
    rows += [(2000 + i, f"own {i}\n{shared}\nend {i}") for i in range(60)]
    return rows + [(1, None), (2, ""), (4, "one"), (5, "one\ntwo"), (7, "\n\n\n\n"), (None, shared), (None, None), rows[3], (9, "x\n" * 20_000)]


def test_matches_brute_force(spark):
    rows = cases()
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, _row int").repartition(3)
    out = line_dedup.line_dedup(docs)
    assert out.columns == ["doc_id", "text", "_row", "n_lines", "n_removed"]
    assert sorted(((str(r.doc_id), r.text, r.n_lines, r.n_removed) for r in out.collect()), key=str) == brute(rows)


def test_rows_that_share_only_an_id(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc\nd"), (2, "z\na\nb\nc")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in line_dedup.line_dedup(docs).collect()) == [(1, "a\nb\nc"), (1, "a\nb\nc\nd"), (2, "z")]


def test_empty_and_native(spark):
    assert line_dedup.line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(1, "a\nb\nc")], "doc_id long, text string")
    assert not re.search("Python|Pandas|Arrow", line_dedup.line_dedup(docs)._jdf.queryExecution().toString())
