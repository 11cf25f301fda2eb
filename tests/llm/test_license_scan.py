import random
import re

import pytest
from pyspark.sql import functions as F

from carelane.llm import license_scan as L
from tests.llm.conftest import ODD


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text, templates, phrases, percent):
    """n_words, phrase places and matches by all blocks of all templates."""
    words = plain_words(text)
    places = sorted((i, p) for p, (_, phrase) in enumerate(phrases) if (ps := plain_words(phrase)) for i in range(len(words) - len(ps) + 1) if words[i : i + len(ps)] == ps)
    found = []
    for t, (_, body) in enumerate(templates):
        own = plain_words(body)
        if not own or not words:
            continue
        size = L.LEAST_BLOCK
        while size < 2 * len(own):
            size *= 2
        half, begin = size // 2, 0
        while True:
            both = len(set(words[begin : begin + size]) & set(own))
            if 100 * both >= percent * len(set(own)):
                found.append((t, begin, min(begin + size, len(words)), both))
            begin += half
            if begin + half >= len(words):
                break
    return len(words), places, sorted(found)


def got_of(scanned):
    return {r["doc_id"]: (r["n_words"], [(p["word"], p["phrase"]) for p in r["phrases"]], [(m["template"], m["first"], m["end"], m["words"]) for m in r["matches"]]) for r in scanned.collect()}


def random_docs(seed, n):
    rng = random.Random(seed)
    notices = [t for _, t in L.TEMPLATES]
    rest = ["the", "of", "software", "license", "MIT", "Apache", "general", "public", "café", "x1", "GPL's", "日本", "by", "nc", "4", "0", "version", "2", "under", "licensed"]
    docs = []
    for i in range(n):
        parts = [" ".join(rng.choice(rest) for _ in range(rng.randrange(0, 60)))]
        for _ in range(rng.randrange(0, 4)):
            words = rng.choice(notices).split()
            for _ in range(rng.randrange(0, 5)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(rest)
            parts += [rng.choice(["\n", "-", " (", "\x00"]).join(words) if rng.random() < 0.2 else " ".join(words), " ".join(rng.choice(rest) for _ in range(rng.randrange(0, 90)))]
        docs.append((i, rng.choice(["\n", " ", "\n\n"]).join(parts)))
    return docs


@pytest.mark.parametrize(("seed", "percent"), [(1, 90), (2, 60), (3, 100), (4, 1)])
def test_against_all_blocks(spark, docs_of, seed, percent):
    rows = random_docs(seed, 60)
    got = got_of(L.scan(docs_of(rows).repartition(3), percent=percent))
    for i, text in rows:
        assert got[i] == plain(text, L.TEMPLATES, L.PHRASES, percent), i
    assert sum(len(m) for _, _, m in got.values()) > 20


def test_own_templates_with_odd_words(spark, docs_of):
    long = "w" * 400
    templates = [("a", f"{long} {'w' * 399} end"), ("b", ""), ("c", "Ünïcode wörds only"), ("d", "abcdefgX abcdefgY abcdefgX")]
    rows = [(1, f"{long} {'w' * 399} end"), (2, f"{long}w {'w' * 399} end"), (3, "ünïcode WÖRDS only"), (4, "ünïcode wörds ONLY now"), (5, "abcdefgy abcdefgx"), (6, "abcdefgz abcdefgx"), (7, f"{'v' + 'w' * 399} {long} end")]
    got = got_of(L.scan(docs_of(rows), templates, [("p", f"end {long}")], 100))
    for i, text in rows:
        assert got[i] == plain(text, templates, [("p", f"end {long}")], 100), i


def test_odd_rows_and_clashing_columns(spark, odd, clashing, none):
    extra = [(20, "mit mit license mit"), (21, "general public"), (22, "license")]
    for df in (odd, clashing):
        out = L.labelled(L.scan(df)).collect()
        assert len(out) == len(ODD)
        for r in out:
            texts = [t for i, t in ODD if i == r["doc_id"]]
            assert r["n_words"] in [len(plain_words(t)) for t in texts]
            assert (r["n_base"], r["first_word"], r["last_word"], r["labels"], r["score"]) == (0, None, None, "", 0.0)
    assert L.labelled(L.scan(none)).collect() == []
    got = {r["doc_id"]: r for r in L.labelled(L.scan(spark.createDataFrame(extra, "doc_id long, text string"))).collect()}
    assert (got[20]["n_base"], got[20]["first_word"], got[20]["last_word"], got[20]["base_labels"], got[20]["score"]) == (1, 1, 1, "mit", 1.0)
    assert got[21]["n_base"] == got[22]["n_base"] == 0


def test_phrases_do_not_cross_texts(spark, docs_of):
    got = {r["doc_id"]: r["n_base"] for r in L.labelled(L.scan(docs_of([(1, "the MIT"), (2, "license"), (3, "mit\nLICENSE, mit license")]).coalesce(1))).collect()}
    assert got == {1: 0, 2: 0, 3: 2}


def test_long_text_and_notice_across_lines(spark, docs_of):
    notice = dict(zip("mit lgpl".split(), (L.TEMPLATES[0][1], L.TEMPLATES[6][1]), strict=True))
    text = "plain words here " * 40_000 + notice["mit"].replace(" ", "\n") + " more words " * 1_000
    got = L.labelled(L.scan(docs_of([(1, text), (2, "plain words " * 40_000)]))).orderBy("doc_id").collect()
    assert (got[0]["labels"], got[0]["score"]) == ("mit", 1.0)
    assert (got[1]["labels"], got[1]["score"], got[1]["n_words"]) == ("", 0.0, 80_000)


def test_too_many_template_words(docs_of):
    with pytest.raises(ValueError, match="200000"):
        L.scan(docs_of([(1, "x")]), [("a", "w " * 200_001)])


def test_no_shuffle_of_texts(spark, docs_of):
    plan = L.labelled(L.scan(docs_of([(1, "mit license")])))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert L.scan(docs_of([(1, "a")]).withColumn("doc_id", F.lit("k")), [], []).first()["n_words"] == 1
