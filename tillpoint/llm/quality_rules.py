"""Operator 9: quality rules by weak supervision, in DataFrame functions only.

Each rule looks at one count of the document and votes 1 (good), -1 (bad) or, between the two, 0 (abstains).
Expectation-maximisation estimates the share of good documents and, for each rule, how often it casts each vote on good
and on bad documents, from the counts of vote patterns over all documents (at most 3^11 rows, however many
documents); the posterior that a document is good is then a column expression. It replaces the test that all rules must pass:
one bad vote among good ones may be outweighed, and abstentions that are rare among good documents count against one.

Two classes of documents can be told apart in many ways (by length, by language). What names the classes is a prior of
PRIOR_SHARE of the documents: a rule votes good on most good documents and bad on a part of the bad ones, as junk
breaks some rules, never all. It weighs the same at every size and leaves a corpus without junk as it is.

Words are runs of anything but space, tab and the line and page breaks. Null text has no words and fails
the base rules; so does an empty one. Null and repeated doc_ids keep a row each; other columns are
ignored; an empty table gives no rows. Repeated words are found by sorting a document's 64-bit window
hashes inside its row, so a document of n words costs n log n and no shuffle.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpoint.llm.common import save, words_column

SYMBOLS = r"[#*$%&|<>]"
#: Chance of (vote, document is good) before any document is seen; as many more documents, as a share of all, for how much that
#: counts in each class; the share of good documents at the start.
PRIOR_VOTE = {(1, True): 0.85, (0, True): 0.13, (-1, True): 0.02, (1, False): 0.45, (0, False): 0.2, (-1, False): 0.35}
PRIOR_SHARE, PRIOR_GOOD = 0.02, 0.9
#: Posterior from which a document is kept, and rounds of estimation.
KEEP_FROM, ROUNDS = 0.5, 100


def with_counts(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the votes' other counts to (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    base = docs.withColumn("_words", words_column(F.col("text")))
    base = base.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")) != ""))
    n = F.size("_words")
    base = base.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))  # once a word
    window = lambda i: F.struct(F.xxhash64(*(F.get("_hashes", i + k) for k in range(3))).alias("h"), i.alias("at"))
    windows = F.when(n >= 3, F.array_sort(F.transform(F.sequence(F.lit(0), n - 3), window)))
    base = base.withColumn("_windows", F.coalesce(windows, F.array().cast("array<struct<h:bigint,at:int>>")))
    same = lambda x, j: F.coalesce(F.get("_windows", j)["h"] == x["h"], F.lit(False))
    twice = F.filter("_windows", lambda x, j: ((j > 0) & same(x, j - 1)) | same(x, j + 1))
    base = base.withColumn("_starts", F.sort_array(F.transform(twice, lambda x: x["at"])))
    covered = F.aggregate("_starts", F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n")),
                          lambda a, s: F.struct((s + 3).alias("end"), (a["n"] + 3 - F.greatest(F.lit(0), a["end"] - s)).alias("n")),
                          lambda a: a["n"])
    next_same = F.size(F.filter("_hashes", lambda w, i: (i > 0) & (w == F.get("_hashes", i - 1))))
    counts = {
        "n_words": n, "word_chars": F.length(F.array_join("_words", "")), "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)),
        "n_lines": F.size("_lines"), "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": covered, "n_distinct": F.size(F.array_distinct("_hashes")), "n_next_same": next_same,
        "n_uppers": F.regexp_count(text, F.lit(r"\p{Lu}")), "n_marks": F.regexp_count(text, F.lit("[!?]")),
        "n_others": F.regexp_count(text, F.lit(r"[^\p{L}\p{M}\x20\x09-\x0D]")),
        "n_wordless": F.size(F.filter("_words", lambda w: ~F.rlike(w, F.lit(r"\p{L}")))),
    }
    return base.withColumns({k: v.cast("bigint") for k, v in counts.items()}).drop("_words", "_hashes", "_lines", "_windows", "_starts")


def votes() -> dict[str, Column]:
    """The rules: 1, -1 or 0 each, over the counts."""
    c = F.col

    def rule(bad: Column, good: Column) -> Column:
        return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0)).cast("int")

    def at_most(count: str, of: str, good: int, bad: int) -> Column:
        """Good up to one `good`-th of `of`, bad from one `bad`-th on."""
        return rule((c(count) * bad >= c(of)) & (c(count) > 0), c(count) * good <= c(of))

    n, chars = c("n_words"), c("word_chars")
    return {
        "length": rule(n < 30, n >= 80),
        "word_length": rule((chars < 3 * n) | (chars > 8 * n), (10 * chars >= 42 * n) & (10 * chars <= 65 * n)),
        "distinct": rule((n >= 20) & (c("n_distinct") * 4 < n), c("n_distinct") * 5 >= 2 * n),
        "symbols": at_most("n_symbols", "n_words", 50, 10),
        "letters": at_most("n_others", "word_chars", 15, 8),
        "wordless": at_most("n_wordless", "n_words", 30, 10),
        "lines": rule((c("n_dup_lines") >= 2) & (c("n_dup_lines") * 10 >= 3 * c("n_lines")), c("n_dup_lines") * 20 <= c("n_lines")),
        "repeats": rule((n >= 20) & (c("n_repeat_words") * 10 >= 3 * n), c("n_repeat_words") * 10 <= n),
        "capitals": at_most("n_uppers", "word_chars", 12, 6),
        "marks": at_most("n_marks", "n_words", 20, 5),
        "next_word": at_most("n_next_same", "n_words", 20, 6),
    }


class VoteModel:
    """The share of good documents, and how often each rule casts each vote on good and on bad ones."""

    def __init__(self, names: list[str]):
        self.names, self.good = names, PRIOR_GOOD
        self.chance = {k: dict(PRIOR_VOTE) for k in names}

    def log_odds(self, name: str, vote: int) -> float:
        """What a vote adds to the log odds of a good document."""
        return math.log(self.chance[name][vote, True] / self.chance[name][vote, False])

    def start(self) -> float:
        return math.log(self.good / (1 - self.good))

    def posterior(self, pattern: tuple[int, ...]) -> float:
        z = self.start() + sum(self.log_odds(k, v) for k, v in zip(self.names, pattern))
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0

    def fit(self, patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> VoteModel:
        """Expectation-maximisation over (pattern, number of documents); each class has the prior's documents on top."""
        total = sum(n for _, n in patterns)
        more = PRIOR_SHARE * total
        for _ in range(rounds if total else 0):
            weights = [(p, n, self.posterior(p)) for p, n in patterns]
            of = {True: sum(n * q for _, n, q in weights), False: sum(n * (1 - q) for _, n, q in weights)}
            self.good = (of[True] + more * PRIOR_GOOD) / (total + more)
            for i, k in enumerate(self.names):
                cast = {key: more * prior for key, prior in PRIOR_VOTE.items()}
                for p, n, q in weights:
                    cast[p[i], True] += n * q
                    cast[p[i], False] += n * (1 - q)
                self.chance[k] = {(vote, good): c / (of[good] + more) for (vote, good), c in cast.items()}
        return self

    def column(self) -> Column:
        z = F.lit(self.start())
        for k in self.names:
            vote = F.col(f"vote_{k}")
            z = z + F.when(vote > 0, F.lit(self.log_odds(k, 1))).when(vote < 0, F.lit(self.log_odds(k, -1))).otherwise(F.lit(self.log_odds(k, 0)))
        return 1 / (1 + F.exp(-z))


def fit_votes(cast: DataFrame) -> VoteModel:
    """The vote model of a table with the vote_ columns: only the counts of their patterns reach the driver."""
    columns = [f"vote_{k}" for k in votes()]
    counts = cast.groupBy(*columns).agg(F.count("*").alias("n")).collect()
    return VoteModel(list(votes())).fit([(tuple(r[k] for k in columns), r["n"]) for r in counts])


def judge_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior, votes)."""
    rules = votes()
    counted = save(with_counts(docs.select("doc_id", "text")).drop("text"), "rule-counts")
    cast = counted.select("*", *(v.alias(f"vote_{k}") for k, v in rules.items()))
    columns = [f"vote_{k}" for k in rules]
    model = fit_votes(cast)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = cast.withColumn("base_failed", failed).withColumn("posterior", model.column())
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP_FROM)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior", *columns)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents the rules keep, all columns.

    Documents and their counts are written once; the vote model is fitted on all of them and the verdicts
    are taken from that table, so no text is looked at twice and no filter is pushed into the counting.
    """
    rules, names = votes(), docs.columns
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), "text")
    counted = save(with_counts(row).drop("text"), "rule-counts")
    cast = counted.select("_row", "n_words", "n_repeat_words", *(v.alias(f"vote_{k}") for k, v in rules.items()))
    model = fit_votes(cast)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return cast.where(~failed & (model.column() >= KEEP_FROM)).select(*(F.col("_row").getField(c).alias(c) for c in names))
