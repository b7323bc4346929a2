"""Operator 13: spelling variants by composing the vocabulary's acceptor with a one-edit transducer and itself.

Words are maximal runs of letters (A-Z, a-z and U+00C0 to U+00FF), A-Z lower-cased, one of EDIT_ONE_IN spoilt by
dropping a letter (see `spoilt`); those of at least MIN_LETTERS and MIN_COUNT occurrences are the vocabulary.

Both runs of the acceptor read the same letters until the edit, so the composition's states before it are the
acceptor's own, and the words are dealt out by the state they reach first:

* words that begin alike, MOST_WORDS at the most, form a partition: its acceptor is built and minimised, for each
  state the pairs of endings that one edit here lets both runs accept are found once, and are given out for every
  beginning that reaches the state;
* where more words begin alike, the partition is split by the next letter. A pair whose first difference is at
  a split state must agree from there on, letter by letter, so such words meet by the rest they must share: at most
  one word a letter, and one without a letter.

Each pair belongs to the state of its first difference, so it is found once. A partition gives one row a word (how many
are near, and the most frequent of them), never one a pair.

A null text has no words; a null id counts as an empty one; repeated rows count again; other columns are ignored;
an empty table gives no rows. Ties of the most frequent near word go to the smallest in code-point order.
"""
from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.llm.common import drop, save, small_batches, text_chunks

EDIT_ONE_IN, MIN_LETTERS, MIN_COUNT = 97, 5, 3
#: Words of one partition's acceptor; distinct words a counting task holds before it gives them out.
MOST_WORDS, HELD_WORDS = 8000, 400_000

#: Latin-1 bytes: letters lower-cased (A-Z only), all else blank.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def spoilt(word: bytes, before: int) -> bytes:
    """The word, less one letter if the checksum of `<doc_id>:<word>` says so; `before` is that of `<doc_id>:`."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), before)
    if h % EDIT_ONE_IN:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (word, n): counts of a stretch of documents."""
    total: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    for batch, texts in text_chunks(batches, "text"):
        for id, text in zip(batch.column("doc_id").to_pylist(), texts):
            before = zlib.crc32(b"%s:" % (id or "").encode())
            # a letter is one Latin-1 byte; what Latin-1 lacks becomes a mark, which is no letter either
            for word, n in Counter(text.encode("latin-1", "replace").translate(_LETTERS).split()).items():
                if len(word) >= MIN_LETTERS and len(word := spoilt(word, before)) >= MIN_LETTERS:
                    total[word] += n
            if len(total) > HELD_WORDS:
                yield out()
                total.clear()
    if total:
        yield out()


def vocabulary(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all words of the documents with enough letters and occurrences."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id}`").cast("string").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(_count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


class Acceptor:
    """The minimised acceptor of sorted distinct words. States are numbers; equal numbers accept equal endings."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.span: list[tuple[int, int]] = []  # lengths of the shortest and the longest ending
        known: dict[tuple, int] = {}
        path: list[list] = [[{}, False]]
        last = ""

        def state(arcs: dict[str, int], final: bool) -> int:
            key = (final, tuple(arcs.items()))
            if key not in known:
                known[key] = len(self.arcs)
                ends = [self.span[s] for s in arcs.values()]
                self.arcs.append(arcs)
                self.final.append(final)
                self.span.append((0 if final else min((a for a, _ in ends), default=0) + 1, max((b for _, b in ends), default=-1) + 1))
            return known[key]

        def close(length: int) -> None:
            while len(path) - 1 > length:
                arcs, final = path.pop()
                path[-1][0][last[len(path) - 1]] = state(arcs, final)

        for word in words:
            same = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                same += 1
            close(same)
            path.extend([{}, False] for _ in word[same:])
            path[-1][1] = True
            last = word
        close(0)
        self.start = state(*path[0])

    def shared(self, p: int, q: int, without: str = "") -> list[str]:
        """Endings that both states accept, but for those that begin with `without`."""
        out, todo = [], [(p, q, "")]
        while todo:
            p, q, ending = todo.pop()
            if self.final[p] and self.final[q]:
                out.append(ending)
            a, b = self.arcs[p], self.arcs[q]
            for letter in (a.keys() if p == q else a.keys() & b.keys()):
                if ending or letter != without:
                    x, y = a[letter], b[letter]
                    (lo, hi), (lo2, hi2) = self.span[x], self.span[y]
                    if lo <= hi2 and lo2 <= hi:
                        todo.append((x, y, ending + letter))
        return out

    def edits(self, p: int) -> list[tuple[str, str]]:
        """Pairs of endings of a state that differ by one edit at their first letter, which the rest after it ends."""
        out, arcs = [], self.arcs[p]
        for (a, x), (b, y) in combinations(arcs.items(), 2):
            out += [(a + ending, b + ending) for ending in self.shared(x, y)]
        for a, x in arcs.items():  # `a` dropped; before another `a` the pair differs later
            out += [(a + ending, ending) for ending in self.shared(x, p, a)]
        return out

    def near_pairs(self) -> Iterator[tuple[str, str]]:
        """Every pair of accepted words that differ by exactly one edit, once."""
        of_state = [self.edits(p) for p in range(len(self.arcs))]
        todo = [(self.start, "")]
        while todo:
            p, beginning = todo.pop()
            for u, v in of_state[p]:
                yield beginning + u, beginning + v
            todo += [(s, beginning + a) for a, s in self.arcs[p].items()]


def _route(split: frozenset[str]):
    """(word, n) -> (key, word, n, role): the word's partition, and for each split state on its way the rests it may share."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                i = 0
                while i <= len(word) and word[:i] in split:
                    if i < len(word):
                        rows.append((f"{word[:i]}|{word[i + 1:]}", word, n, 1))
                    rows.append((f"{word[:i]}|{word[i:]}", word, n, 2))
                    i += 1
                if i <= len(word):
                    rows.append((word[:i], word, n, 0))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.int32()))]
                                             if rows else [pa.array([], k) for k in (pa.string(), pa.string(), pa.int64(), pa.int32())], ["key", "word", "n", "role"])
    return run


def near_in_partition(beginning: str, words: list[str], counts: list[int]) -> list[tuple]:
    """(word, near words, count of the most frequent one, that one) of the words of a partition that have any."""
    n = dict(zip(words, counts))
    found: dict[str, list] = {}
    k = len(beginning)
    for u, v in Acceptor([w[k:] for w in words]).near_pairs():
        u, v = beginning + u, beginning + v
        for a, b in ((u, v), (v, u)):
            rank = (-n[b], b)
            have = found.get(a)
            if have is None:
                found[a] = [1, rank]
            else:
                have[0] += 1
                have[1] = min(have[1], rank)
    return [(w, m, -c, best) for w, (m, (c, best)) in found.items()]


def near_at_split(key: str, words: list[str], counts: list[int], roles: list[int]) -> list[tuple]:
    """The same for words that share a beginning and, after one letter (role 1) or none (role 2), the rest."""
    beginning, rest = key.split("|")
    k = len(beginning)
    with_letter = sorted((-n, w) for w, n, r in zip(words, counts, roles) if r == 1)
    out = []
    bare = next(((-n, w) for w, n, r in zip(words, counts, roles) if r == 2), None)
    # before an equal letter the pair with the bare word differs later
    to_bare = [x for x in with_letter if bare and x[1][k] != rest[:1]]
    for x in with_letter:
        near = [y for y in with_letter[:2] if y != x][:1] + [bare] * (x in to_bare)
        if near:
            best = min(near)
            out.append((x[1], len(with_letter) - 1 + (x in to_bare), -best[0], best[1]))
    if to_bare:
        out.append((bare[1], len(to_bare), -to_bare[0][0], to_bare[0][1]))
    return out


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (key, word) -> (word, n_near, best_n, best) of each partition."""
    key, words, counts, roles = None, [], [], []
    out: list[tuple] = []

    def done() -> list[tuple]:
        if len(words) < 2:
            return []
        return near_at_split(key, words, counts, roles) if "|" in key else near_in_partition(key, words, counts)

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))],
                                          ["word", "n_near", "best_n", "best"])

    for batch in batches:
        for k, w, n, r in zip(*(batch.column(c).to_pylist() for c in ("key", "word", "n", "role"))):
            if k != key:
                out += done()
                key, words, counts, roles = k, [], [], []
            words.append(w)
            counts.append(n)
            roles.append(r)
        if len(out) > 50_000:
            yield rows()
            out = []
    out += done()
    if out:
        yield rows()


def split_states(words: DataFrame, most: int) -> set[str]:
    """Beginnings that more than `most` words share (the empty one always): at most words / most of each length."""
    split, level, depth = {""}, [""], 0
    while level:
        depth += 1
        begin = words.where(F.length("word") >= depth).select(F.substring("word", 1, depth).alias("b"))
        if depth > 1:
            above = words.sparkSession.createDataFrame([(b,) for b in level], "a string")
            begin = begin.join(above, F.col("a") == F.expr(f"substring(b, 1, {depth - 1})"), "left_semi")
        level = [r.b for r in begin.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > most).select("b").collect()]
        split.update(level)
    return split


def near_words(words: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """(word, n_near, best_n, best): for each of the (word, n) that has any, its near words' number and the most frequent."""
    split = frozenset(split_states(words, most))
    routed = words.select("word", "n").mapInArrow(_route(split), "key string, word string, n bigint, role int")
    found = routed.repartition("key").sortWithinPartitions("key", "word").mapInArrow(_compose, "word string, n_near bigint, best_n bigint, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("c"), F.col("best").alias("b"))).alias("top")).select(
        "word", "n_near", (-F.col("top.c")).alias("best_n"), F.col("top.b").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each (word, form): the last form that can be reached; steps double from round to round."""
    now = save(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("via"), F.col("root").alias("beyond"))
        new = save(now.join(onward, F.col("root") == F.col("via"), "left").select(
            "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        drop(now)
        moved = not new.where("moved").isEmpty()
        now = new.select("word", "root")
        if not moved:
            return now


def spelling_variants(docs: DataFrame, id: str = "doc_id", text: str = "text", most: int = MOST_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the documents' vocabulary: a word's form is its most frequent near word,
    if that is at least twice as frequent; its root is the end of the chain of forms."""
    words = save(vocabulary(docs, id, text), "vocabulary")
    near = words.join(near_words(words, most), "word", "left")
    is_form = F.col("best_n") >= 2 * F.col("n")
    near = save(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"),
                            F.when(is_form, F.col("best_n")).alias("form_n")), "near-words")
    last = roots(near.where("form is not null"))
    return near.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
