"""Operators 1, 2 and 7 against the tokenizers library on whole texts."""
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from llm_edge import EDGE
from tillpoint.llm import packing, token_counts, token_files
from tillpoint.llm.units import UnitEncoder

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


LOADED = {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}
ENCODERS = {p: UnitEncoder(p, keep=3) for p in (WORD, BYTE)}


def ids_of(path, texts):
    t = LOADED[path]
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("path", [WORD, BYTE])
@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab'sé1!.<|>\n\t\r   \x1c\x0b\u0301İ中\u2003\xa0", "<|endoftext|>", " ", "  "]), max_size=25).map("".join), max_size=4))
def test_units_join_to_the_ids_of_the_text(path, texts):
    enc = ENCODERS[path]
    for _ in range(2):
        assert [np.frombuffer(b, enc.dtype).tolist() for b in enc.encode(texts)] == ids_of(path, texts)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_that_forgets(docs, path):
    """Few remembered units, whole documents and short ones: the same ids as the library's, call after call."""
    enc = UnitEncoder(path, keep=50)
    texts = [r.text or "" for r in docs.collect()][:60] + ["", " ", "a  b", "\0", "one two", "one two", "x" * 500 + " y " + "x" * 500]
    for i in (1, 7, 60):
        got = [b for at in range(0, len(texts), i) for b in enc.encode(texts[at:at + i])]
        assert [np.frombuffer(b, enc.dtype).tolist() for b in got] == ids_of(path, texts)


def check_files(spark, frame, rows):
    got = token_files.read_token_digests(spark, token_files.write_token_files(frame, WORD, 1)).collect()
    assert len(got) == len(rows)
    want = sorted(((r[0], len(i) + 1, crc(i + [1])) for r, i in zip(rows, ids_of(WORD, [r[1] for r in rows]))), key=repr)
    assert sorted(((g.doc_id, g.n_tokens, g.ids_crc32) for g in got), key=repr) == want
    got.sort(key=lambda g: g.start)
    assert [g.start for g in got] == np.cumsum([0, *(g.n_tokens for g in got)])[:-1].tolist()
    order = [-1 << 62 if g.doc_id is None else g.doc_id for g in got]
    assert order == sorted(order)


def test_token_files(spark, docs, rows):
    check_files(spark, docs, rows)


def test_token_files_edge(spark, edge, empty):
    check_files(spark, edge, EDGE)
    assert token_files.read_token_digests(spark, token_files.write_token_files(empty, WORD, 1)).count() == 0


def test_one_short_document_and_dictionary_check(spark, docs, rows):
    path = token_files.write_token_files(docs, WORD, 1)
    dict_hash, dictionary = token_files.load_dictionary(spark, path)
    assert dictionary
    block = spark.read.parquet(f"{path}/blocks").first().asDict(recursive=True)
    i = min(3, len(block["doc_ids"]) - 1)
    one = {**block, **{k: block[k][i:i + 1] for k in ("doc_ids", "starts", "counts")}, "offsets": block["offsets"][i:i + 2]}
    (doc_id, _, ids), = token_files.read_documents(one, dictionary, dict_hash)
    assert ids.tolist() == ids_of(WORD, [dict(map(tuple, rows))[doc_id]])[0] + [1]
    with pytest.raises(ValueError):
        list(token_files.read_documents(one, dictionary, "another"))


@pytest.mark.parametrize("hot", [0, 50, 100_000])
def test_token_counts(spark, docs, rows, edge, empty, hot, monkeypatch):
    real = token_counts.hot_units
    monkeypatch.setattr(token_counts, "hot_units", lambda d, v: real(d, v, n_units=hot) if hot else {})
    for frame, data in ((docs, rows), (edge, EDGE), (empty, [])):
        got = token_counts.count_tokens(frame, BYTE, 512).collect()
        want = [(r[0], len((r[1] or "").encode()), len(i), len(i) > 512) for r, i in zip(data, ids_of(BYTE, [r[1] for r in data]))]
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def check_packing(got, data, size):
    want = defaultdict(list)
    for r, ids in zip(data, ids_of(BYTE, [r[1] for r in data])):
        start = 0
        for piece, n in enumerate(packing.cut_lengths(len(ids) + 1, size)):
            want[r[0]].append((piece, start, n, crc((ids + [0])[start:start + n])))
            start += n
    have = defaultdict(list)
    for g in got:
        have[g.doc_id].append((g.piece, g.start, g.length, g.ids_crc32))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    bins = defaultdict(list)
    for g in got:
        bins[g.sequence_id].append((g.offset, g.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(bins), -(-sum(g.length for g in got) // size)


def test_packing(spark, docs, rows, edge, empty):
    n, least = check_packing(packing.pack_documents(docs, BYTE, 0, 2048)[1].collect(), rows, 2048)
    assert n <= least * 1.02 + 1
    check_packing(packing.pack_documents(edge, BYTE, 0, 64)[1].collect(), EDGE, 64)
    assert packing.pack_documents(empty, BYTE, 0, 2048)[1].count() == 0


def test_whole_sequences(docs):
    pieces, placed = packing.pack_documents(docs.limit(40), BYTE, 0, 2048)
    whole = {r.sequence_id: len(r.ids) for r in packing.sequences(pieces, 2048).collect()}
    sums = defaultdict(int)
    for g in placed.collect():
        sums[g.sequence_id] += 4 * g.length
    assert sorted(whole.values()) == sorted(sums.values())


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 40), min_size=1, max_size=30))
def test_best_two_fit_packs_every_piece_once(histogram):
    plan = packing.best_two_fit(histogram, 100)
    used = defaultdict(int)
    for times, lengths in plan:
        assert times > 0 and sum(lengths) <= 100
        for x in lengths:
            used[x] += times
    assert used == histogram


def test_best_two_fit_replaces_the_smallest():
    # greedy fills 10 with 6 + 3; 2 + 2 fit the gap left by the 3 more tightly
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0] == (1, [6, 2, 2])
