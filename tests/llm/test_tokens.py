import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from carelane.llm import token_counts as C
from carelane.llm import token_files as K
from carelane.llm.common import shared_dir
from carelane.llm.files import Ranges, Replaced
from carelane.llm.pretokens import WordEndPreTokens, byte_level_encoder, piece_count

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
word, byte = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
ids_of = lambda t, text: t.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aéÑß'st <|>\n\t09_!İ²½ⅷⅰ\u0301\x1c\x85\u3000", max_size=40))
def test_whole_text_equals_pre_tokens(text):
    assert np.frombuffer(byte_level_encoder(BYTE)(text), "<u2").tolist() == ids_of(byte, text)
    assert sum(piece_count(WORD)(WordEndPreTokens(WORD)(text))) == len(ids_of(word, text))


@pytest.mark.parametrize("text", ["<|endoftext|>", "a<|endoftext|><|startoftext|> b", "<|ENDOFTEXT|>", "don't WE'LL 'S", "x" * 9000])
def test_special_strings(text):
    assert np.frombuffer(byte_level_encoder(BYTE)(text), "<u2").tolist() == ids_of(byte, text)
    assert sum(piece_count(WORD)(WordEndPreTokens(WORD)(text))) == len(ids_of(word, text))


@pytest.mark.parametrize("after", ["'s", "7\u0327 ", "\u0301x x"])
def test_every_code_point_as_the_library_has_it(after):
    # All of the planes that have assigned points, and some of those that are empty or private as a whole.
    points = [c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x34000 or 0xE0000 <= c < 0xE0200 or c % 64 == 1 or c & 0xFFFF > 0xFFF0)]
    texts = [" a ".join(chr(c) + after for c in points[k : k + 256]) for k in range(0, len(points), 256)]
    pre, count, encode = WordEndPreTokens(WORD), piece_count(WORD), byte_level_encoder(BYTE).encode_all
    for k in range(0, len(texts), 200):
        some = texts[k : k + 200]
        assert [sum(count(pre(t))) for t in some] == [len(e) for e in word.encode_batch_fast(some, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u2").tolist() for x in encode(some)] == [e.ids for e in byte.encode_batch_fast(some, add_special_tokens=False)]


@pytest.mark.parametrize("text", ["\u0130\u05b6", "\u0130\u0327", "a \u0130\u0327 b", "<|ENDOFTEXT|>\u0130<|endoftext|>\u0327"])
def test_text_is_normalised_once(text):
    assert sum(piece_count(WORD)(WordEndPreTokens(WORD)(text))) == len(ids_of(word, text))


def test_counts(odd, clashing, none):
    got, again = (sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in C.count_tokens(docs, WORD).collect()) for docs in (odd, clashing))
    assert got == again
    want = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()), len(ids_of(word, r["text"])), len(ids_of(word, r["text"])) > 2048) for r in odd.collect())
    assert got == want
    assert C.count_tokens(none, WORD).count() == 0


def test_counts_over_many_blocks(docs_of, monkeypatch):
    rows = [(i, f"word{i % 7} other{i} the the, {'x' * (i % 5)}") for i in range(200)]
    monkeypatch.setattr(C, "BLOCK_DOCS", 3)
    got = {r["doc_id"]: r["n_tokens"] for r in C.count_tokens(docs_of(rows), WORD).collect()}
    assert got == {i: len(ids_of(word, t)) for i, t in rows}


def files(spark, docs):
    folder = shared_dir(spark)
    catalog = K.write_shards(docs, BYTE, folder)
    return folder, catalog, K.write_index(catalog, folder, bucket_keys=4)


def test_round_trip(spark, odd, clashing, none):
    folder, catalog, buckets = files(spark, clashing)
    got = K.read_back(K.lookup(catalog, folder, buckets), folder, K.shard_bases(catalog)).collect()
    rows = sorted(odd.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or ""))
    start, want = 0, []
    for r in rows:
        ids = [*ids_of(byte, r["text"]), K.END_ID]
        want.append((r["doc_id"] or -1, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r["doc_id"] or -1, r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(want)
    folder, catalog, buckets = files(spark, none)
    assert K.read_back(K.lookup(catalog, folder, buckets), folder, K.shard_bases(catalog)).count() == 0


def test_unknown_keys_fail_the_fingerprint(spark, docs_of):
    folder, _, buckets = files(spark, docs_of([(i, f"t{i}") for i in range(50)]))
    ask = spark.createDataFrame([(7, 0), (7, 1), (1000, 0)], "doc_id long, occurrence long")
    assert [(r["doc_id"], r["occurrence"]) for r in K.lookup(ask, folder, buckets).collect()] == [(7, 0)]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 20_000])
def test_perfect_hash_is_minimal(n):
    h = K.mix(np.arange(n, dtype=np.uint64), 3)
    assert sorted(K.PerfectHash.build(h).slots(h)) == list(range(n))


def test_one_id_over_many_shards_and_the_least_id(spark, docs_of):
    least = -(2**63)
    rows = [(None, f"t{k}") for k in range(40)] + [(least, "a"), (least, "a")] + [(5, "same")] * 60 + [(6, None)]
    folder = shared_dir(spark)
    catalog = K.write_shards(docs_of(rows), BYTE, folder, partitions=9)
    assert catalog.select("shard").distinct().count() == 9
    keys = [(r["doc_id"], r["occurrence"]) for r in catalog.orderBy("shard", "first").collect()]
    assert keys == [(None, k) for k in range(40)] + [(least, 0), (least, 1)] + [(5, k) for k in range(60)] + [(6, 0)]
    buckets = K.write_index(catalog, folder, bucket_keys=7)
    got = K.read_back(K.lookup(catalog, folder, buckets), folder, K.shard_bases(catalog)).collect()
    assert len(got) == len(rows) and len({r["start"] for r in got}) == len(rows)


def test_a_task_that_runs_again_replaces_its_file(tmp_path):
    for attempt, data in ((1, b"first"), (2, b"second")):
        out = Replaced(f"file://{tmp_path}/x", "shard", attempt)
        out.write(data)
        out.close()
    assert Ranges(f"file://{tmp_path}/x").whole("shard") == b"second"
    assert [p.name for p in (tmp_path / "x").iterdir()] == ["shard"]


def test_a_store_that_does_not_move_over_files(tmp_path):
    class Careful:
        def __init__(self, fs):
            self.fs = fs

        def move(self, a, b):
            if self.fs.get_file_info(b).is_file:
                raise OSError("exists")
            self.fs.move(a, b)

        def __getattr__(self, name):
            return getattr(self.fs, name)

    for attempt in (1, 2):
        out = Replaced(f"file://{tmp_path}", "shard", attempt)
        out.fs = Careful(out.fs)
        out.write(b"%d" % attempt)
        out.close()
    assert Ranges(f"file://{tmp_path}").whole("shard") == b"2"
