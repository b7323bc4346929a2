"""Operator 5 and the pipeline against brute force."""
import random
import re
from collections import defaultdict

import corpus_pipeline
from pyspark.sql import functions as F

from llm_edge import EDGE
from tillpoint.llm import jaccard_join
from tillpoint.llm.components import components
from tillpoint.llm.jaccard_join import Banding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text or "")
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    """(classes as sets of row numbers, links of each row)"""
    sets = [shingles(t) for _, t in rows]
    index = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            index[g].append(i)
    common = defaultdict(int)
    for hits in index.values():
        for x in range(len(hits)):
            for y in range(x):
                common[hits[y], hits[x]] += 1
    pairs = {p for p, n in common.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n) - 1e-9}
    same = defaultdict(list)
    for i, (_, t) in enumerate(rows):
        same[t or ""].append(i)
    pairs |= {(x, y) for g in same.values() for x in g for y in g if x < y}
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in pairs:
        links[x] += 1
        links[y] += 1
        root[find(x)] = find(y)
    classes = defaultdict(set)
    for i in range(len(rows)):
        classes[find(i)].add(i)
    return list(classes.values()), links


def check(frame, rows):
    got = jaccard_join.link_documents(frame).collect()
    classes, links = brute(rows)
    want = []
    for members in classes:
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        want += [(rows[i][0], min(ids, default=None), links[i]) for i in members]
    assert sorted(((g.doc_id, g.class_id, g.n_links) for g in got), key=repr) == sorted(want, key=repr)
    return classes


def test_banding_reaches_its_recall():
    b = Banding.for_recall(0.8, 0.999)
    assert 1 - (1 - 0.8 ** b.rows) ** b.bands >= 0.999 and b.bands * b.rows <= jaccard_join.MAX_HASHES


def test_links_on_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(docs, [tuple(r) for r in docs.select("doc_id", "text").collect()])


def near_copies(n, words=120, seed=2):
    """`n` copies of a text with 0 to 8 words changed each."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    out = []
    for i in range(n):
        copy = list(base)
        for at in rng.sample(range(words), rng.randrange(9)):
            copy[at] = f"x{rng.randrange(10 ** 6)}"
        out.append((i, " ".join(copy)))
    return out


def test_links_in_a_large_group_of_near_copies(spark, monkeypatch):
    """Buckets and groups of many blocks: every link is found, in a fixed number of rounds."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 64)
    monkeypatch.setattr(jaccard_join, "BUCKET_BLOCK", 32)
    rows = near_copies(500) + [(1000 + i, t.replace("w1 ", "y ")) for i, t in near_copies(150, seed=3)]
    check(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), rows)


def test_links_of_repeated_rows(spark):
    """Rows with equal text and no id are one text, counted as often as they stand there."""
    rows = [(None, f"{k} " + " ".join(map(str, range(40)))) for k in range(3) for _ in range(30)]
    check(spark.createDataFrame(rows, "doc_id bigint, text string"), rows)


def test_links_edge(spark, edge, empty):
    check(edge, [r[:2] for r in EDGE])
    assert jaccard_join.link_documents(empty).count() == 0
    assert jaccard_join.keep_one(empty).count() == 0


def test_a_large_group_of_near_copies_over_several_blocks(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(300)]
    texts = []
    for i in range(600):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(300)] = f"n{rng.randrange(10 ** 9)}"
        texts.append((i, " ".join(w)))
    frame = spark.createDataFrame(texts, "doc_id bigint, text string")
    check(frame, texts)
    kept = jaccard_join.keep_one(frame).collect()
    assert [r.doc_id for r in kept] == [0]


def test_links_across_the_rim_of_a_hub(spark):
    """Chains of texts, each linked to the next, whose far ends are well below the threshold: no hub is near all."""
    rng = random.Random(8)
    texts = []
    for _ in range(40):
        w = [f"w{rng.randrange(10 ** 6)}" for _ in range(200)]
        for _ in range(12):
            texts.append((len(texts), " ".join(w)))
            at = rng.randrange(180)
            w[at:at + 8] = [f"n{rng.randrange(10 ** 9)}" for _ in range(8)]
    check(spark.createDataFrame(texts, "doc_id bigint, text string"), texts)


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(100, 300)] + [(7, 7), (1, 9), (9, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 100 for i in range(100, 301)}, 7: 7, 1: 1, 9: 1, 5: 1}


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        path = corpus_pipeline.scratch_path(spark, f"test-{name}")
        out.write.parquet(path)
        after = spark.read.parquet(path)
        if name != "best_fit_packing":
            assert after.columns == docs.columns
        kept[name], before, docs = after, docs, after
        if name == "ngram_jaccard_join":
            rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
            classes, _ = brute(rows)
            assert sorted(r.doc_id for r in after.select("doc_id").collect()) == sorted(min(rows[i][0] for i in c) for c in classes)
        if name == "source_mixing":
            assert after.count() == before.count() and after.exceptAll(before).isEmpty()
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    first = kept["quality_classifier"].select("doc_id").distinct()
    good, bad = (labels.where(F.col("quality") == q).select("doc_id").distinct() for q in (1, 0))
    assert first.join(good, "doc_id").count() > 0.98 * good.count()
    assert first.join(bad, "doc_id").count() < 0.1 * bad.count()
    assert kept["best_fit_packing"].select("doc_id").distinct().count() == kept["source_mixing"].select("doc_id").distinct().count()


def test_pipeline_edge(spark, edge, docs, tmp_path):
    """Null, repeated, blank and very long rows, and columns with clashing names, through all stages."""
    extra = [c for c in edge.columns if c not in docs.columns]
    more = docs.withColumns({c: F.lit(None).cast(edge.schema[c].dataType) for c in extra}).select(*edge.columns)
    edge.union(more).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = corpus_pipeline.scratch_path(spark, f"edge-{name}")
        stage(spark, rows, str(tmp_path)).write.parquet(path)
        kept = spark.read.parquet(path)
        assert kept.columns == edge.columns and kept.exceptAll(rows).isEmpty()
        rows = kept
    last = corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path)).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in rows.select("doc_id").collect()}


def test_pipeline_of_nothing(spark, empty, tmp_path):
    for t in ("documents", "labels"):
        frame = empty if t == "documents" else spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
        frame.write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_packing_keeps_the_mix(spark):
    """Sources of unlike lengths: the documents of the leading sequences follow the weights (sizes 4000 and 1000: 2 to 1)."""
    rows = [(i, "word " * 300, "long") for i in range(4000)] + [(i, "tiny", "short") for i in range(4000, 5000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    path = corpus_pipeline.scratch_path(spark, "test-mix")
    corpus_pipeline.mix(spark, docs, "").write.option("maxRecordsPerFile", 400).parquet(path)
    mixed = spark.read.parquet(path)
    placed = corpus_pipeline.pack(spark, mixed, "").select("doc_id", "sequence_id", "offset", "length").collect()
    assert sorted(r.doc_id for r in placed) == list(range(5000))
    by_sequence = defaultdict(list)
    for r in placed:
        by_sequence[r.sequence_id].append(r)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for s in by_sequence.values():
        spans = sorted((r.offset, r.offset + r.length) for r in s)
        assert spans[-1][1] <= 2048 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    leading = [r.doc_id for k in sorted(by_sequence) for r in by_sequence[k]][:2048]
    assert abs(sum(i < 4000 for i in leading) - 2048 * 2 / 3) < 32
    order = {r.row.doc_id: r.position for r in corpus_pipeline.mixing.written_order(mixed).collect()}
    assert sorted(order.values()) == list(range(5000)) and {order[i] for i in leading} == set(range(2048))
