import hashlib
import tarfile
import zlib

from hypothesis import given
from hypothesis import strategies as st

from carelane.llm import media_columns as M
from carelane.llm.common import shared_dir


@given(st.binary(max_size=3000))
def test_picture_round_trip(data):
    payload = data + M.PAD * (max(1, -(-len(data) // 576)) * 576 - len(data))
    media = M.to_png(payload)
    assert M.from_png(media) == payload
    assert M.png_header(media[: M.HEAD_BYTES]) == (576, len(payload) // 576, 8)
    assert M.feature_of(payload) == M.feature_of(bytes(payload))


def read(docs, spark, **how):
    folder = shared_dir(spark)
    catalog = M.store(docs, folder, **how)
    rows = M.read_features(M.fill_metadata(M.addresses(catalog, 4), folder), folder)
    return folder, catalog, catalog.select("doc_id", "n_bytes", "digest").join(rows, "digest").collect()


def test_whole_texts(spark, odd, clashing, none):
    folder, catalog, got = read(clashing, spark, shard_bytes=3000)
    want = []
    for r in odd.collect():
        p = M.payload_of(r["text"])
        want.append((r["doc_id"] or -1, len((r["text"] or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == sorted(want)
    assert len({(r["media_sha256"], r["feature"], r["media_bytes"]) for r in got}) == len({w[3] for w in want})
    for row in catalog.collect():
        with tarfile.open(f"{folder.removeprefix('file://')}/{row['shard']}") as t:
            member = t.getmember(row["digest"].hex() + ".png")
            assert (member.offset_data, member.size) == (row["offset"], row["length"])
    assert read(none, spark)[2] == []
