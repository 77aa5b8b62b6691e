import base64
import random
from collections import Counter

import duckdb
import public_tokenizers
import pyarrow as pa
import tiktoken
from test_quality import document, odd_texts
from test_quality import plain as plain_quality

import __spark_entry__ as entry
import corpus_pipeline
from keystrata.llm import bpe, common, mixing, quality


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs)
        if name != "tokens":
            assert docs.columns == names
    all_ids = {r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    ids = [{r[0] for r in d.select("doc_id").collect()} for d in kept]
    assert all_ids >= ids[0] >= ids[1] >= ids[2] >= ids[3] == ids[4]
    good = {r[0] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
    bad = {r[0] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 0").collect()}
    assert len(good & ids[0]) >= 0.97 * len(good) and len(bad & ids[0]) <= 0.3 * len(bad)
    # no text stands twice after the near duplicates, and no 50 words after the passages
    texts = [r[0] for r in kept[1].select("text").collect()]
    assert len(set(texts)) == len(texts)
    windows = [tuple(w[i : i + 50]) for r in kept[2].select("text").collect() for w in [r[0].split()] for i in range(len(w) - 49)]
    assert len(windows) - len(set(windows)) <= 0.001 * len(windows)
    assert kept[3].count() == kept[2].count()
    v = bpe.vocabulary(bpe.VOCABULARY)
    assert all(v.decode(r["tokens"]).tobytes().decode() == r["text"] and r["n_tokens"] == len(r["tokens"]) for r in kept[4].select("text", "tokens", "n_tokens").collect())


def test_every_operator_is_registered():
    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def plain_run(spark, folder, docs):
    """(doc_id, text, source, n_chars, tokens) of run(), stage by stage over lists: docs are (doc_id, text, lang, source, n_chars) without near copies but exact ones."""
    m = quality.train(common.table(spark, folder, "documents"), common.table(spark, folder, "labels"))
    kept = [d for d in docs if (lambda q: q[1] > 0 and q[0] >= quality.KEEP)(plain_quality(d[1], m))]
    least, out = {}, []
    for d in kept:
        if d[0] is not None:
            least[d[1]] = min(d[0], least.get(d[1], d[0]))
    seen = set()
    for d in kept:
        if d[0] is None or (d[0] == least[d[1]] and (d[0], d[1]) not in seen):
            out.append(d)
            seen.add((d[0], d[1]))
    k, where = 50, {}
    for d in out:
        w = d[1].split()
        for p in range(len(w) - k + 1) if d[0] is not None else ():
            where.setdefault(tuple(w[p : p + k]), []).append((d[0], p))
    later = {x for at in where.values() for x in at if x != min(at)}
    cut = []
    for d in out:
        w = d[1].split()
        gone = {q for p in range(len(w)) if (d[0], p) in later for q in range(p, p + k)}
        if gone and len(gone) == len(w):
            continue
        cut.append((*d[:4], len(d[1])) if not gone else None)
        if gone:
            pieces, now, at = [], [], 0
            text = d[1]
            spans = []
            for x in w:
                at = text.index(x, at)
                spans.append((at, at + len(x)))
                at += len(x)
            for i in range(len(w) + 1):
                if i < len(w) and i not in gone:
                    now.append(i)
                elif now:
                    pieces.append(text[spans[now[0]][0] : spans[now[-1]][1]])
                    now = []
            t = "\n".join(pieces)
            cut[-1] = (d[0], t, d[2], d[3], len(t))
    con = duckdb.connect()
    con.register("documents", pa.table({n: pa.array(c, kind) for n, c, kind in zip(("doc_id", "source", "n_chars"), zip(*((d[0], d[3], d[4]) for d in cut)), (pa.int64(), pa.string(), pa.int64()))}))
    times = {(i, s): n for i, s, n in con.execute(mixing.SAMPLE_SQL).fetchall()}
    with open(bpe.VOCABULARY, "rb") as f:
        plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    return Counter({(*d[:2], d[3], d[4], tuple(plain.encode_ordinary(d[1]))): times[d[0], d[3]] for d in cut if (d[0], d[3]) in times})


def written(spark, folder, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_run_as_a_plain_version(spark, tmp_path):
    r = random.Random(12)
    passage = " ".join("".join(r.choices("klmnop", k=5)) for _ in range(55))
    docs, labels = [], []
    for i in range(110):
        t = document(r, i % 5 > 0)
        if i % 9 == 1:
            t = f"{t}\n{passage}\n{document(r, True)}"
        docs.append((i, t, "en", "big" if i % 4 else "small", len(t)))
        labels.append((i, int(i % 5 > 0), 0))
    docs += [(200 + i, docs[3][1], "en", "copies", len(docs[3][1])) for i in range(20)] + [docs[7], docs[7]]
    docs += [(300 + i, t, None, None, None if t is None else len(t)) for i, t in enumerate(odd_texts())] + [(400, passage, "en", "big", len(passage))]
    folder = str(tmp_path)
    written(spark, folder, docs, labels)
    want = plain_run(spark, folder, docs)
    got = Counter((x["doc_id"], x["text"], x["source"], x["n_chars"], tuple(x["tokens"])) for x in corpus_pipeline.run(spark, folder).collect())
    assert got == want and len(want) > 60


def test_run_on_empty_and_odd_tables(spark, tmp_path):
    written(spark, f"{tmp_path}/a", [], [])
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").collect() == []
    rows = [(1, "one good line of text here", "en", "s", 26, "x", 5, True), (None, "another line without a number", "en", None, None, "y", 6, False), (2, "one good line of text here", "en", "s", 26, "z", 7, None), (3, None, None, None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `key` string, tokens int, `c0.x` boolean").write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/b/labels.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/b")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "c0.x", "tokens", "n_tokens"]
    assert sorted(str(x["doc_id"]) for x in out.collect()) == ["1", "None"]
