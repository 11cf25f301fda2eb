import os
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from carelane.llm import jaccard_join as J
from carelane.llm import packing as P
from carelane.llm import substring_dedup as S
from carelane.llm.textbatch import Words, slices, word_hashes

ROOT = Path(__file__).resolve().parents[2]


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


T = thue_morse(1024)
C = T.translate(str.maketrans("ab", "ba"))


def hashes(texts, fold=True):
    out = []
    for _, _, data, offsets in slices(pa.array(texts)):
        words = Words(data, offsets, fold)
        out += words.hashes.tolist()
    return out


def test_word_hashes_depend_on_the_word_alone():
    rng = random.Random(1)
    some = ["".join(rng.choice("abCé\u0000") for _ in range(n)) for n in [*range(1, 40), 63, 64, 65, 66, 127, 1024, 5000]]
    alone = [hashes([w])[0] for w in some]
    assert len({*alone}) == len({w.lower() for w in some})
    assert hashes([" ".join(some)]) == alone == hashes(["x " + w for w in some])[1::2]
    assert hashes(["AbC"]) == hashes(["abc"]) and hashes(["AbC"], False) != hashes(["abc"], False)


def test_words_that_differ_in_length_or_trailing_zero_bytes_differ():
    words = [b"a" * i + b"\x00" * j for i in range(20) for j in range(20) if i + j]
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    got = word_hashes(data, ends - [len(w) for w in words], ends)
    assert len({*got.tolist()}) == len({*words})


def test_very_long_words_stay_apart(spark, docs_of):
    """Words whose sums under any polynomial hash modulo 2^64 are equal."""
    rows = [(1, f"{T} p q"), (2, f"{C} p q"), (3, f"{T} x y {C} x y"), (4, "w" * 2000 + " p q"), (5, "w" * 1999 + "v p q")]
    got = {r["doc_id"]: r for r in J.join(docs_of(rows), 3, 90).collect()}
    assert [got[i]["component_id"] for i in range(1, 6)] == [1, 2, 3, 4, 5] and got[3]["n_shingles"] == 4
    assert all(r["dedup"]["n_removed"] == 0 for r in S.dedup(docs_of(rows[:2])).collect())
    assert len({r["cluster"] for r in P.pack_documents(docs_of(rows[:2])).collect()}) == 2


def test_units_of_equal_digests_and_unequal_checks_stay(spark, docs_of, monkeypatch):
    """All digests of 64 bits are made equal: the checks alone keep units apart."""
    plain = S.line_units
    monkeypatch.setattr(S, "line_units", lambda *a: (lambda d, *rest: (d * np.uint64(0) + np.uint64(7), *rest))(*plain(*a)))
    rows = S.ranked(docs_of([(1, "one line"), (2, "another line"), (3, "one line")]))
    # On the driver, as the workers have the unpatched module.
    found = set()
    for i, text in ((1, "one line"), (2, "another line"), (3, "one line")):
        for _, _, data, offsets in slices(pa.array([text])):
            digest, check, *_ = S.units(Words(data, offsets), ("line",))
            found.add((i, int(digest[0]), int(check[0])))
    assert {d for _, d, _ in found} == {7}
    by_doc = {i: c for i, _, c in found}
    assert by_doc[1] == by_doc[3] != by_doc[2]
    assert rows.count() == 3


def test_windows_against_all_windows():
    """Selected windows: of every run of so many windows inside a text the one of least digest, and no others; their
    digests and checks are those of their words."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 120))) for _ in range(30)] + ["a b " * 60]
    for _, _, data, offsets in slices(pa.array(texts)):
        words = Words(data, offsets)
        size, stride = 10, 4
        digest, check, first, last = S.passage_units(words, size, stride)
        grams, want = words.grams(size), set()
        for a, b in zip(words.at, words.at[1:], strict=False):
            inside = range(a, b - size + 1)
            for lo in range(a - stride + 1, b - size + 1):
                run = [k for k in range(lo, lo + stride) if k in inside]
                if run:
                    want.add(min(run, key=lambda k: (int(grams[k]), k)))
        assert sorted(want) == first.tolist() and (last - first == size).all()
        assert digest.tolist() == grams[first].tolist()
        text = data.tobytes()
        by_words = {}
        for k, c in zip(first.tolist(), check.tolist(), strict=True):
            by_words.setdefault(tuple(text[words.starts[j] : words.ends[j]] for j in range(k, k + size)), set()).add(c)
        assert all(len(c) == 1 for c in by_words.values())
        assert len({c for own in by_words.values() for c in own}) == len(by_words)


@pytest.mark.parametrize("stop", [True, False])
def test_work_folders_go_when_the_program_ends(tmp_path, stop):
    program = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from carelane.session import session
from carelane.llm.common import materialise
from carelane.streaming.folders import work_folder
spark = session("local[1]", spark__checkpoint__dir="file://{tmp_path}", spark__ui__enabled="false")
assert materialise(spark.range(5)).count() == 5
spark.range(3).write.parquet(work_folder(spark))
import os; assert len([f for _, _, fs in os.walk({str(tmp_path)!r}) for f in fs]) > 2
{"spark.stop()" if stop else ""}
"""
    done = subprocess.run([sys.executable, "-c", program], capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "Error" not in done.stderr
    assert [f for _, _, files in os.walk(tmp_path) for f in files] == []


