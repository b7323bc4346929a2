"""Operators 3, 4, 6, 8, 9 and 10: brute force, held-out accuracy, and defined edge results."""
import hashlib
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_edge import EDGE
from tillpoint.llm import fingerprints, language_id, mixing, quality_model, quality_rules, url_filter
from tillpoint.llm.catalog import OP6_SQL, URL_RULES, op3, op4

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text):
    """Buckets of the 1- to 3-grams, one by one, in whole numbers."""
    c, m, out = [ord(x) for x in text.lower()], 1 << 32, Counter()
    one = [x * 2654435761 % m for x in c]
    for i, x in enumerate(one):
        out[x >> 32 - language_id.BITS] += 1
        if i + 1 < len(one):
            two = ((x ^ one[i + 1] >> 7) * 2246822519 + 1) % m
            out[two >> 32 - language_id.BITS] += 1
            if i + 2 < len(one):
                out[((two ^ one[i + 2] >> 11) * 3266489917 + 2) % m >> 32 - language_id.BITS] += 1
    return out


def test_tf_idf_by_brute_force(spark, docs, rows):
    idf = language_id.inverse_frequencies(docs.select("text"))
    bags = [grams(r.text or "") for r in rows]
    df = Counter(b for bag in bags for b in bag)
    assert all(abs(idf[b] - (math.log((1 + len(bags)) / (1 + df[b])) + 1)) < 1e-12 for b in range(0, language_id.BUCKETS, 7))
    for r, bag in list(zip(rows, bags))[:40]:
        at, x = language_id.tf_idf(r.text or "", idf)
        want = {b: (1 + math.log(n)) * idf[b] for b, n in bag.items()}
        norm = math.sqrt(sum(v * v for v in want.values())) or 1
        assert dict(zip(at.tolist(), x.round(9).tolist())) == {b: round(v / norm, 9) for b, v in want.items()}


def test_ftrl_by_brute_force():
    """Every step in plain loops: gradients of the softmax, per-coordinate rates, the proximal weights."""
    rng = np.random.default_rng(1)
    rows = [(np.sort(rng.choice(50, 6, replace=False)), rng.random(6)) for _ in range(30)]
    classes, k = rng.integers(0, 3, 30), 3
    alpha, beta, l1, l2 = language_id.ALPHA, language_id.BETA, language_id.L1, language_id.L2
    z, n = defaultdict(float), defaultdict(float)

    def weight(b, c):
        x = z[b, c]
        return 0.0 if abs(x) <= l1 else -(x - math.copysign(l1, x)) / ((beta + math.sqrt(n[b, c])) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(2):
        for i in order.permutation(30):
            at, x = rows[i]
            score = [sum(v * weight(b, c) for b, v in zip(at, x)) for c in range(k)]
            e = [math.exp(s - max(score)) for s in score]
            steps = []
            for b, v in zip(at, x):
                for c in range(k):
                    g = v * (e[c] / sum(e) - (classes[i] == c))
                    steps.append((b, c, g, (math.sqrt(n[b, c] + g * g) - math.sqrt(n[b, c])) / alpha * weight(b, c)))
            for b, c, g, pull in steps:
                z[b, c] += g - pull
                n[b, c] += g * g
    got = language_id.fit_ftrl(rows, classes, k, epochs=2)
    assert all(abs(got[b, c] - weight(b, c)) < 1e-9 for b in range(50) for c in range(k))
    assert (got[50:] == 0).all() and (got[:50] == 0).any()


def test_temperature_by_grid():
    rng = np.random.default_rng(2)
    classes = rng.integers(0, 4, 400)
    logits = rng.normal(0, 1, (400, 4)) + 2 * np.eye(4)[classes]
    for scale in (0.3, 1.0, 6.0):
        def loss(t):
            return -np.log(language_id.softmax(scale * logits / t)[np.arange(400), classes]).mean()

        best = min((loss(t), t) for t in np.exp(np.linspace(math.log(0.05), math.log(20), 2000)))
        assert loss(language_id.fit_temperature(scale * logits, classes)) <= best[0] + 1e-6


def test_language_held_out_accuracy(spark):
    got = op3(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right / n > 0.97


def test_language_edge(spark, edge, empty):
    model = language_id.train_language_model(edge, F.lit(True), 40)
    got = language_id.identify_languages(edge, model).collect()
    assert len(got) == len(EDGE)
    assert all(g.lang_pred == "und" and g.score == 0 for g in got if g.doc_id in (1, 2))
    assert all(0 <= g.score <= 1 for g in got)
    none = language_id.train_language_model(empty, F.lit(True))
    assert {r.lang_pred for r in language_id.identify_languages(edge, none).collect()} == {"und"}
    assert language_id.identify_languages(empty, model).count() == 0


def test_quality_held_out_accuracy(spark):
    got = op4(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").where("quality is not null"), "doc_id").where("held_out")
    right, n = got.agg(F.sum((F.col("quality") == F.col("predicted")).cast("int")), F.count("*")).first()
    assert n > 50 and right / n > 0.95


def test_compiled_rules_score_as_the_model(spark, edge, docs):
    model = quality_model.train_quality_model(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    assert model.rules
    import numpy as np
    rows = quality_model.with_statistics(edge.select("text")).select(*quality_model.STATISTICS, model.column().alias("s")).collect()
    assert np.allclose(model.score(np.array([r[:-1] for r in rows])), [r.s for r in rows])
    out = quality_model.score_quality(edge, model)
    assert out.count() == len(EDGE) and {"words", "bands", "key"} <= set(out.columns)


def test_quality_without_labels(spark, edge, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality_model.score_quality(edge, quality_model.train_quality_model(edge, none)).where("predicted = 1").count() == len(EDGE)
    assert quality_model.score_quality(empty, quality_model.train_quality_model(empty, none)).count() == 0


URLS = [None, "", "no scheme", "http://A.Net/x", "http://net", "http://net/", "https://x.example.net/en/1?q", "https://example.net/en", "http://org/fr/a#b",
        "http://xorg/fr/", "http://a.b.org/fr/", "ftp://example.com/de/x://y", "http://example.com/de", "://", "http://É.ÉX.net/x", "http://net?x/"]


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for verdict, s in URL_RULES:
        h, p = s[:s.index("/")], s[s.index("/"):]
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(s), s, verdict))
    _, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


@pytest.mark.parametrize("most", [0, 4_000_000])
def test_urls(spark, most, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_RULES", most)
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(0, None, "y")], "page_id bigint, url string, host string")
    got = url_filter.judge_urls(pages, URL_RULES).collect()
    assert {g.page_id: tuple(g)[1:] for g in got} == {i: brute_url(u) for i, u in enumerate(URLS)}
    assert url_filter.judge_urls(pages.limit(0), URL_RULES).count() == 0


def test_digest_array_confirms_strings(monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda b: len(b))  # every string of a length collides
    array = url_filter.DigestArray(url_filter.DigestArray.pack([("block", "aa"), ("allow", "bb"), ("block", "ccc")]))
    assert [array.string(i) if i >= 0 else None for i in array.find(["bb", "aa", "xx", "ccc", "d"])] == [b"bb", b"aa", None, b"ccc", None]


def test_url_oracle_sql_is_registered():
    assert "rules" in OP6_SQL


def every_block(counts, weights):
    """[(slot, source)] of all blocks, by slot."""
    plan = mixing.by_source(mixing.phases(counts, weights))
    got = sorted((t, str(s), k) for s, n in counts.items() for k, t in enumerate(mixing.slot_of(plan, s, np.arange(n)).tolist()))
    assert [t for t, *_ in got] == list(range(sum(counts.values())))  # each slot has one block
    return [(t, s) for t, s, _ in got]


def most_deviation(got, weights, upto):
    """Blocks that a source ever has more or less than its exact share of the slots so far."""
    total, seen, most = sum(weights.values()), dict.fromkeys(map(str, weights), 0), 0
    for t, s in got[:upto]:
        seen[s] += 1
        most = max(most, *(abs(seen[str(x)] - Fraction(t + 1) * w / total) for x, w in weights.items())) if t % 7 == 0 or t < 3000 else most
    return most


def test_pfair_deviation_below_one_block(spark, docs, empty):
    got = sorted(mixing.mix_order(docs, block_docs=2).select("slot", "source").distinct().collect())
    total = docs.count()
    assert mixing.mix_order(docs).select("position").distinct().count() == total
    sizes = {r.source: r.n for r in docs.groupBy("source").agg(F.count("*").alias("n")).collect()}
    weights = mixing.tempered({s: n ** 0.5 for s, n in sizes.items()}, 1)
    first_end = next(iter(mixing.phases({s: -(-n // 2) for s, n in sizes.items()}, weights)))
    blocks = Counter(g.source for g in got)
    assert blocks == {s: -(-n // 2) for s, n in sizes.items()} and [g.slot for g in got] == list(range(len(got)))
    upto = sum(end for _, end, _ in first_end[2].values())
    assert most_deviation([(g.slot, str(g.source)) for g in got], weights, upto) < 1
    assert mixing.mix_order(empty).count() == 0


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1, "c": 1}, {"a": 0.7, "b": 0.2995, None: 0.0005}, {f"s{i}": i for i in range(1, 40)}, {"a": Fraction(1, 3), "b": Fraction(2, 3)}])
def test_pfair_deviation_over_many_periods(weights):
    """Every source stays less than one block from its exact weight, over 30 hyperperiods and more."""
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    whole, total = mixing.whole_weights(weights), sum(exact.values())
    assert all(Fraction(whole[s], sum(whole.values())) == w / total for s, w in exact.items())
    length = 31 * sum(whole.values())
    counts = {s: max(1, math.ceil(length * w / total)) for s, w in exact.items()}
    got = every_block(counts, whole)
    assert most_deviation(got, exact, 30 * sum(whole.values())) < 1


def test_pfair_phases():
    """Each phase follows the weights of the sources that are left, from its first slot on."""
    counts, weights = {"a": 90, "b": 40, "c": 7, "d": 1}, {"a": 3, "b": 3, "c": 5, "d": 2}
    got = every_block(counts, weights)
    for start, _, sources in mixing.phases(counts, weights):
        n = sum(end - first for first, end, _ in sources.values())
        assert most_deviation([(t - start, s) for t, s in got[start:start + n]], {s: weights[s] for s in sources}, n) < 1


def test_mixing_two_thousand_sources(spark):
    rows = [(None, "big" if i % 3 == 0 else f"s{i % 2000}" if i % 2000 else None) for i in range(9000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, source string")
    got = mixing.mix_order(frame, block_docs=1).collect()
    assert Counter(g.source for g in got) == Counter(s for _, s in rows) and len({g.position for g in got}) == 9000
    assert sorted(g.position for g in got) == list(range(9000))
    # the pool's sources keep their places from the first to the last
    light = [g.position for g in got if g.source != "big"]
    assert abs(sum(light) / len(light) - 4500) < 2500


def test_mixing_clashing_names(spark):
    names = ["h", "bucket", "rank", "nth", "slot", "block", "position", "before", "slots", "s", "row", "code", "own", "n", "k", "at"]
    rows = [(i, f"t{i}", "ab"[i % 2], *range(i, i + len(names))) for i in range(60)]
    frame = spark.createDataFrame(rows, ", ".join(["doc_id bigint, text string, source string", *(f"`{n}` int" for n in names)]))
    out = mixing.mixed(frame, block_docs=2)
    assert out.columns == frame.columns and sorted(map(tuple, out.collect())) == rows
    assert mixing.mix_order(frame).count() == 60


def test_mixing_keeps_every_row(spark, edge):
    assert sorted(map(tuple, mixing.mixed(edge, block_docs=2).collect()), key=repr) == sorted(map(tuple, edge.collect()), key=repr)
    weighted = mixing.mix_order(edge, weights={"a": 0.9, "b": 0.1}, block_docs=1)
    assert weighted.select("position").distinct().count() == len(EDGE)


def brute_rules(text):
    w = WORD.findall(text or "")
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = set()
    for i, t in enumerate(zip(w, w[1:], w[2:])):
        if windows[t] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_rule_counts(spark, docs, rows, edge, empty):
    for frame, data in ((docs, [tuple(r) for r in rows]), (edge, EDGE)):
        got = quality_rules.judge_documents(frame).collect()
        want = []
        for r in data:
            n, chars, symbols, dup, repeat = brute_rules(r[1])
            want.append((r[0], n, chars, symbols, dup, repeat, n < 50 or 100 * repeat > 50 * n))
        assert sorted((tuple(g)[:7] for g in got), key=repr) == sorted(want, key=repr)
        assert not any(g.kept and g.base_failed for g in got)
    assert quality_rules.judge_documents(empty).count() == 0
    assert quality_rules.keep_good(empty).count() == 0


def test_vote_model_recovers_chances():
    """Votes drawn from known chances, both ways and abstaining: the estimates come near them and so does the balance."""
    import random
    rng, patterns = random.Random(3), Counter()
    truth = {True: [(0.02, 0.08, 0.9), (0.01, 0.04, 0.95), (0.05, 0.15, 0.8), (0.02, 0.03, 0.95), (0.01, 0.29, 0.7)],
             False: [(0.6, 0.2, 0.2), (0.5, 0.1, 0.4), (0.7, 0.1, 0.2), (0.4, 0.2, 0.4), (0.5, 0.3, 0.2)]}
    for _ in range(20_000):
        good = rng.random() < 0.8
        patterns[tuple(rng.choices((-1, 0, 1), x)[0] for x in truth[good])] += 1
    model = quality_rules.VoteModel(list("abcde")).fit(list(patterns.items()))
    assert abs(model.good - 0.8) < 0.03
    for good, rules in truth.items():
        for k, chances in zip("abcde", rules):
            assert all(abs(model.chance[k][v, good] - x) < 0.06 for v, x in zip((-1, 0, 1), chances))


def brute_posterior(votes):
    """The documents' posteriors by expectation-maximisation over documents, one by one, in plain loops."""
    n, k = len(votes), len(votes[0])
    prior, more = quality_rules.PRIOR_VOTE, quality_rules.PRIOR_SHARE * len(votes)
    chance, good = [dict(prior) for _ in range(k)], quality_rules.PRIOR_GOOD

    def post(v):
        a, b = good, 1 - good
        for i, x in enumerate(v):
            a *= chance[i][x, True]
            b *= chance[i][x, False]
        return a / (a + b)

    for _ in range(quality_rules.ROUNDS):
        q = [post(v) for v in votes]
        new = []
        for i in range(k):
            new.append({(x, c): (sum((p if c else 1 - p) for p, v in zip(q, votes) if v[i] == x) + more * prior[x, c]) / (sum(p if c else 1 - p for p in q) + more)
                        for x in (-1, 0, 1) for c in (True, False)})
        good, chance = (sum(q) + more * quality_rules.PRIOR_GOOD) / (n + more), new
    return [post(v) for v in votes]


def test_posterior_by_brute_force(spark, docs):
    got = quality_rules.judge_documents(docs).collect()
    votes = [tuple(g[f"vote_{k}"] for k in quality_rules.votes()) for g in got]
    assert all(abs(g.posterior - p) < 1e-6 for g, p in zip(got, brute_posterior(votes)))
    assert all(g.kept == (not g.base_failed and g.posterior >= quality_rules.KEEP_FROM) for g in got)


def test_estimates_leave_their_start_and_decide(spark):
    """On the real table: balance and chances move off the prior, and one weak bad vote does not reject a document."""
    counted = quality_rules.with_counts(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")).drop("text")
    cast = counted.select("doc_id", "n_words", *(v.alias(f"vote_{k}") for k, v in quality_rules.votes().items())).cache()
    model = quality_rules.fit_votes(cast)
    assert abs(model.good - quality_rules.PRIOR_GOOD) > 0.005
    moved = [abs(model.chance[k][v, c] - x) for k in model.names for (v, c), x in quality_rules.PRIOR_VOTE.items()]
    assert sum(m > 0.02 for m in moved) > 0.8 * len(moved)
    bad = sum((F.col(f"vote_{k}") < 0).cast("int") for k in model.names)
    judged = cast.withColumn("bad", bad).withColumn("good", model.column() >= quality_rules.KEEP_FROM).where("n_words >= 50")
    assert judged.where("bad > 0 and good").count() > 0
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = judged.join(labels, "doc_id").select("quality", "good", "bad").collect()
    right = sum(r.good == (r.quality == 1) for r in rows)
    assert right >= sum((r.bad == 0) == (r.quality == 1) for r in rows) and right > 0.99 * len(rows)
    # a document between the zones of most rules is rejected without a bad vote
    assert model.posterior(tuple(0 for _ in model.names)) < quality_rules.KEEP_FROM
    cast.unpersist()


def test_rules_keep_clean_and_reject_junk(spark):
    got = quality_rules.judge_documents(spark.read.parquet(f"{SF}/documents.parquet")).join(
        spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("n_words >= 50").collect()
    clean = [g.kept for g in got if g.quality == 1]
    junk = [g.kept for g in got if g.quality == 0]
    assert sum(clean) / len(clean) > 0.98 and sum(junk) / len(junk) < 0.35


def shingles(text):
    w = WORD.findall(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def test_fingerprints(spark, docs, rows, edge, empty):
    for frame, data in ((docs, [tuple(r) for r in rows]), (edge, EDGE)):
        got = fingerprints.edited_fingerprints(frame).collect()
        assert len(got) == len(data)
        by_text, errors = defaultdict(set), []
        ids = [r[0] for r in data]
        alone = [r for r in data if ids.count(r[0]) == 1] if frame is docs else []
        order = sorted({r[0]: r[1] for r in data if r[0] is not None}.items(), reverse=True)
        following = {a[0]: b[1] for a, b in zip(order, order[1:] + order[:1])}
        have = {g.doc_id: g for g in got}
        alone = [r for r in alone if ids.count(dict(zip([a[0] for a in order], [b[0] for b in order[1:] + order[:1]]))[r[0]]) == 1]
        for doc_id, text in ((r[0], r[1]) for r in alone):
            g, n = have[doc_id], len(text)
            edit = text[:n - n // 3] + following[doc_id][:n // 3]
            assert g.n_chars == n and g.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
            by_text[text].add(g.fingerprint)
            errors += [abs(g.near_edited - jaccard(text, edit)), abs(g.near_next - jaccard(text, following[doc_id]))]
        assert all(len(v) == 1 for v in by_text.values())
        if errors:
            assert max(errors) < 0.17 and sum(errors) / len(errors) < 0.03
        assert all(0 <= g.near_edited <= 1 and len(g.fingerprint) == fingerprints.BINS for g in got)
    assert fingerprints.edited_fingerprints(empty).count() == 0
