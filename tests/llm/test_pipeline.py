import random

import public_tokenizers
from test_simhash import brute_fingerprint
from test_substring_dedup import brute as brute_substrings
from tokenizers import Tokenizer

import corpus_pipeline


def corpus(tmp_path, spark):
    rnd = random.Random(12)
    vocabulary = ["w%d" % i for i in range(400)]
    block = ["\n".join(" ".join(rnd.choices(vocabulary, k=6)) for _ in range(4)) for _ in range(3)]
    passage = " ".join(rnd.choices(vocabulary, k=60))
    rows, labels = [], []
    for i in range(240):
        lines = [" ".join(rnd.choices(vocabulary, k=rnd.randint(3, 14))) for _ in range(rnd.randint(1, 12))]
        if i % 5 == 0:
            lines.insert(rnd.randint(0, len(lines)), rnd.choice(block))
        if i % 6 == 0:
            lines.append(passage)
        if i % 8 == 3:
            lines.append("vileword " + " ".join(rnd.choices(vocabulary, k=4)) + " vileword")
        rows.append((i, "\n".join(lines)))
        labels.append((i, 1, int(i % 8 == 3)))
    rows += [(1000 + k, rows[k][1] + " end") for k in range(0, 60, 3)] + [(2000, None), (2001, ""), (2002, "  "), (None, "no id " + passage), (2003, "solo " * 30_000)]
    docs = [(i, t, "en", "src", None if t is None else len(t), "x") for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, _row string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows


def key(i):
    return 2**63 - 1 if i is None else i


def brute_lines(rows):
    first = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        for s in range(len(lines) - 2):
            w = tuple(lines[s : s + 3])
            first[w] = min(first.get(w, (key(i), s)), (key(i), s))
    out = []
    for i, t in rows:
        lines, gone = (t or "").split("\n"), set()
        for s in range(len(lines) - 2):
            if first[tuple(lines[s : s + 3])] < (key(i), s):
                gone |= {s, s + 1, s + 2}
        out.append((i, t if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return out


def brute_near(rows):
    fps = {key(i): brute_fingerprint(t, 5) for i, t in rows}
    kept = sorted(fps)
    root = {i: i for i in kept}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(kept):
        for b in kept[n + 1 :]:
            if bin(fps[a] ^ fps[b]).count("1") <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [(i, t) for i, t in rows if find(key(i)) == key(i)]


def test_each_stage_on_what_the_one_before_kept(spark, tmp_path):
    rows = corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "SimHash near-dedup", "substring dedup", "best-fit packing"]
    order = lambda x: sorted(x, key=str)
    for k, (_, apply) in enumerate(corpus_pipeline.STAGES):
        out = apply(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            out.write.parquet(f"{tmp_path}/stage{k}")
            out = spark.read.parquet(f"{tmp_path}/stage{k}")
            got = [(r.doc_id, r.text) for r in out.collect()]
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())
        if k == 0:
            assert order(got) == order((i, t) for i, t in rows if "vileword" not in (t or ""))
        elif k == 1:
            want = brute_lines(rows)
            assert order(got) == order(want) and want != rows
        elif k == 2:
            want = brute_near(rows)
            assert order(got) == order(want) and len(want) < len(rows)
        elif k == 3:
            want = [(i, w) for i, _, _, w in brute_substrings(rows)]
            assert order((i, (t or "").split()) for i, t in got) == order(want)
        else:
            tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            tok.encode_special_tokens = True
            found = out.collect()
            assert sum(r.length for r in found) == sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
            final = sorted(map(str, ((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found)))
        docs, rows = out, got
    ran = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, ((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in ran))) == final


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
