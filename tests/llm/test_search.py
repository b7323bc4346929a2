"""Operators 11 to 13 against brute force."""
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_edge import EDGE
from tillpoint.llm import ranked_search, spelling, vector_links

SCHEMA = "vec_id bigint, embedding array<double>, label string, v int, grp string, node bigint"


def components_of(n, links):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[top(a)] = top(b)
    return [top(i) for i in range(n)]


def brute_vectors(rows, threshold=0.93):
    """Rows (vec_id, vector, label) -> sorted (vec_id, n_links, component_id, kept)."""
    def sound(v, label):
        return label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    units = [(u := np.array(v) / max(map(abs, v))) / np.linalg.norm(u) if sound(v, label) else None for _, v, label in rows]
    links = [(i, j) for i, j in combinations(range(len(rows)), 2)
             if units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j])
             and float(units[i] @ units[j]) >= threshold]
    degree = Counter(x for pair in links for x in pair)
    of = components_of(len(rows), links)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[of[i]] = min(r[0], least.get(of[i], r[0]))
    return sorted(((r[0], degree[i], least.get(of[i]), r[0] == least.get(of[i])) for i, r in enumerate(rows)), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "mine", 2) for r in rows], SCHEMA)


def linked(f, **options):
    return sorted((tuple(r) for r in vector_links.link_vectors(f, **options).select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def clustered(n, size=16, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i % 3 and rows:
            base = np.array(rows[int(rng.integers(len(rows)))][1])
            v = base + rng.normal(0, rng.choice([0.0, 0.05, 0.3]) * np.linalg.norm(base) / math.sqrt(size), size)
        else:
            v = rng.normal(0, 1, size)
        rows.append((int(i * 7 % n), v.tolist(), "ab"[i % 5 == 0]))
    return rows


def test_vectors_edge(spark):
    big = [1e300, -1e300, 2e300]
    rows = [(1, None, "a"), (2, [], "a"), (3, [0.0, 0.0], "a"), (4, [1.0, None], "a"), (5, [1.0, float("nan")], "a"), (6, [1.0, float("inf")], "a"),
            (7, [1.0, 0.0], None), (8, [1.0, 0.0], "a"), (8, [1.0, 0.0], "a"), (None, [1.0, 0.1], "a"), (None, [-1.0, 0.0], "a"), (9, [1.0, 0.0], "b"),
            (10, [2.0, 0.0], "b"), (11, [1.0, 0.0, 0.0], "b"), (12, big, "c"), (13, [x / 1e290 for x in big], "c"), (14, [1e-310, 1e-310], "c"), (15, [1.0, 1.0], "c")]
    assert linked(frame(spark, rows)) == brute_vectors(rows)
    assert vector_links.link_vectors(frame(spark, [])).count() == 0


def test_vectors_in_small_windows(spark):
    """Windows, chunks and blocks far smaller than the groups: united vectors are still compared all against all."""
    rows = clustered(600)
    # one group of near copies beyond any window
    rng = np.random.default_rng(1)
    rows += [(1000 + i, (np.ones(16) + rng.normal(0, 0.02, 16)).tolist(), "a") for i in range(150)]
    got = linked(frame(spark, rows), window=16, chunk=40, block=32)
    want = brute_vectors(rows)
    assert sum(r[1] for r in got) >= 0.9 * sum(r[1] for r in want)
    hot = [r for r in got if r[0] >= 1000]
    assert all(r[1] >= 149 for r in hot) and len({r[2] for r in hot}) == 1
    assert all(g[1] <= w[1] for g, w in zip(got, want))  # no link below the threshold


def test_vectors_whole_groups(spark):
    rows = clustered(400, seed=9)
    assert linked(frame(spark, rows)) == brute_vectors(rows)


def test_passes_grow_with_the_group():
    assert vector_links.passes_for(500) == 1
    assert vector_links.passes_for(5_000) < vector_links.passes_for(10_000_000) < 100


def brute_ranking(docs, items, k=50):
    term = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    bags = [(i, Counter(term.findall((t or "").translate(fold)))) for i, t in docs]
    n_docs = sum(1 for _, b in bags if b)
    total = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        asked = set(term.findall((text or "").translate(fold)))
        scored = []
        for i, b in bags:
            n = sum(b.values())
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 20 * (50 + 50 * n * n_docs // total))) for t in asked if t in b)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def ranked(docs, items, **options):
    return sorted((tuple(r) for r in ranked_search.rank_documents(docs, items, **options).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_ranking_on_the_corpus(spark, docs, rows):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    asked = [tuple(r) for r in items.select("item_id", "text").collect()]
    want = brute_ranking([tuple(r) for r in rows], asked)
    assert ranked(docs, items) == want
    # more than one block of queries
    assert ranked(docs, items, query_block=max(1, len(asked) // 3)) == want


def test_ranking_edge(spark, edge, empty):
    asked = [(1, "one two"), (1, "one two"), (2, None), (3, ""), (4, "nowhere"), (None, "word x ES"), (5, "THREE İstanbul 12345 \x00 byte")]
    items = spark.createDataFrame([(*a, 9) for a in asked], "item_id bigint, text string, rank int")
    assert ranked(edge, items) == brute_ranking([r[:2] for r in EDGE], asked)
    assert ranked(empty, items) == [] and ranked(edge, items.limit(0)) == []


def test_ball_tree_is_exact_and_prunes():
    """Trees of many levels, ties and copies included; no bound lies below a score."""
    rng = np.random.default_rng(3)
    docs = [sorted(rng.choice(60, int(rng.integers(1, 12)), replace=False).tolist()) for _ in range(900)] + [[1, 2, 3]] * 200
    sizes = np.array([len(d) for d in docs])
    terms, values = np.concatenate(docs), rng.integers(1, 10**9, int(sizes.sum()))
    values[-600:] = 5
    queries = ranked_search.Queries([[1, 2], [3], [4, 5, 6, 59], list(range(60))])
    best, ids = ranked_search.Best(4, 50), rng.permutation(len(docs)).astype(np.int64)
    root = ranked_search.Ball(np.arange(len(docs)), sizes, terms, values, queries, 60)
    ranked_search.search(root, queries, best, ids, np.zeros(len(docs), np.int64))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for q, row in enumerate(queries.rows):
        want = []
        for i, d in enumerate(docs):
            s = sum(int(v) for t, v in zip(d, values[starts[i]:starts[i + 1]]) if t in row)
            assert s <= root.bound[q]
            if s:
                want.append((-s, int(ids[i])))
        assert [(-s, i) for s, i in zip(best.kept[q][0].tolist(), best.kept[q][1].tolist())] == sorted(want)[:50]


def one_edit(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    if len(u) > len(v):
        u, v = v, u
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1:] == u for i in range(len(v)))


def brute_spelling(rows):
    n = Counter()
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(fold)
            h = zlib.crc32(f"{'' if id is None else id}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    n = {w: c for w, c in n.items() if c >= 3 and len(w) >= 5}
    near = defaultdict(set)
    by_gap = defaultdict(set)
    for w in n:  # words that are near share a word with a gap, or are one
        for i in range(len(w)):
            by_gap[w[:i] + w[i + 1:]].add(w)
        by_gap[w].add(w)
    for group in by_gap.values():
        for u, v in combinations(group, 2):
            if one_edit(u, v):
                near[u].add(v)
                near[v].add(u)
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 2 * n[w]:
                form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=repr)


def variants(docs, **options):
    return sorted((tuple(r) for r in spelling.spelling_variants(docs, **options).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def test_spelling_on_the_corpus(spark, docs, rows):
    want = brute_spelling([tuple(r) for r in rows])
    assert len(want) > 500
    assert variants(docs) == want
    # partitions far smaller than the words that begin alike
    assert variants(docs, most=20) == want


def test_spelling_edge(spark, edge, empty):
    assert variants(edge) == brute_spelling([r[:2] for r in EDGE])
    assert variants(empty) == []
    odd = [(1, "aaaaa " * 9 + "aaaaaa " * 4 + "aaaaaaa " * 3), (None, "Élan élan " * 4 + "straße strasse straßen " * 5), (2, "b" * 3000 + " "), (2, "b" * 3000), (3, "b" * 3000),
           (4, "x" + "b" * 2999), (4, "x" + "b" * 2999), (5, "x" + "b" * 2999), (6, None), (7, "×÷×÷× " * 3 + "kelvin Kelvin kelvins " * 4)]
    assert variants(spark.createDataFrame(odd, "doc_id bigint, text string"), most=2) == brute_spelling(odd)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=6), min_size=2, max_size=60))
def test_composition_finds_every_pair_once(words):
    got = sorted(tuple(sorted(p)) for p in spelling.Acceptor(sorted(words)).near_pairs())
    assert got == sorted((u, v) for u, v in combinations(sorted(words), 2) if one_edit(u, v))
