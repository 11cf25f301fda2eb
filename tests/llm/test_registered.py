"""Every registered query over whole small tables, held against plain computations of its contract."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from carelane.llm import media_columns as M
from carelane.llm import packing as P
from carelane.llm import quality_rules as Q
from carelane.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_quality import brute as plain_statistics
from tests.llm.test_url_filters import parts, rule_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text", "source"]).to_pydict()
    return {i: (x, s) for i, x, s in zip(t["doc_id"], t["text"], t["source"], strict=True)}


def run(spark, name):
    got = QUERIES[name](spark, SF).collect()
    assert got
    return got


def words(text):
    return (text or "").encode().split()


def test_op1(spark, texts):
    got = run(spark, "op1_toxicity")
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert len({r["predicted"] for r in got}) == 2


def test_op2(spark):
    urls = pq.read_table(f"{SF}/pages.parquet", columns=["page_id", "url"]).to_pydict()
    got = {r["page_id"]: r for r in run(spark, "op2_url_filters")}
    assert sorted(got) == sorted(urls["page_id"])
    for i, u in zip(urls["page_id"], urls["url"], strict=True):
        rule, verdict = rule_of(*parts(u))
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (*parts(u), rule)
        assert got[i]["verdict"] == (verdict or ("block" if got[i]["score"] >= 0.5 else "allow"))


def test_op3(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, (t, _) in texts.items()}
    got = run(spark, "op3_token_counts")
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in got} == want
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got)


def test_op4(spark, texts):
    got = run(spark, "op4_best_fit_packing")
    total, bins = Counter(), defaultdict(list)
    for r in got:
        total[r["doc_id"]] += r["length"]
        bins[r["bin"]].append(r)
    assert {i: total[i] for i in texts} == {i: len(words(t)) for i, (t, _) in texts.items()}
    for rows in bins.values():
        assert sum(r["length"] for r in rows) <= P.CAPACITY
        for kind in ("source", "cluster"):
            known = [r[kind] for r in rows if r[kind] is not None]
            assert len(known) == len(set(known))
    assert all(r["source"] == texts[r["doc_id"]][1] for r in got)


def test_op5(spark, texts):
    want = {}
    for i, (t, _) in texts.items():
        data = (t or "").encode()
        p = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        want[i] = (len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), M.feature_of(p))
    got = run(spark, "op5_media_columns")
    assert {r["doc_id"]: (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["feature"]) for r in got} == want


def test_op7(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, want = 0, []
    for i in sorted(texts):
        ids = [*library.encode(texts[i][0] or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in run(spark, "op7_token_files")) == want


def test_op8(spark, texts):
    got = run(spark, "op8_quality_rules")
    assert {r["doc_id"]: tuple(r[c] for c in Q._STATS) for r in got} == {i: plain_statistics(t) for i, (t, _) in texts.items()}
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) for r in got)
    assert all(r["kept"] == (not r["base_failed"] and r["score"] >= Q.THRESHOLD) for r in got)


def test_op9(spark, texts):
    got = {r["doc_id"]: r for r in run(spark, "op9_substring_dedup")}
    assert sorted(got) == sorted(texts)
    seen = set()
    for i in sorted(texts):
        r, text = got[i], texts[i][0] or ""
        left, at = "", 0
        for s in r["spans"]:
            left, at = left + text[at : s["start"]], s["end"]
        assert left + text[at:] == (r["text"] or "")
        assert (r["n_words"], r["n_words"] - r["n_removed"]) == (len(words(text)), len(words(r["text"])))
        # No whole line of an earlier document is left, but where the first of its words is.
        whole = {" ".join(x.lower().split()) for x in (r["text"] or "").split("\n") if x.split()}
        if not r["spans"]:
            assert not whole & seen
        seen |= {" ".join(x.lower().split()) for x in text.split("\n") if x.split()}


def test_op10(spark, texts):
    got = run(spark, "op10_source_mixing")
    assert {r["doc_id"] for r in got} == set(texts)
    assert all((r["source"], r["n_tokens"]) == (texts[r["doc_id"]][1], len(words(texts[r["doc_id"]][0]))) for r in got)
    most, least = max(r["repetition"] for r in got), min(r["repetition"] for r in got)
    assert most / least <= 2.0 + 1e-6
    places = Counter((r["doc_id"], r["epoch"]) for r in got)
    assert max(places.values()) == 1


def shown(rows):
    return sorted(tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_license_scan", "op13_conversation_repair"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(ORACLE_SQL[name]).select(*columns).fetchall()
    assert shown(got.select(*columns).collect()) == shown(want) and want
