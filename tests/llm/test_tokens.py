"""Packing and token files against the tokenizers library itself."""

import random
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm.common import shared_dir
from quillspark.llm.packing import pack
from quillspark.llm.token_files import Shard, hash_blocks, numbers, read_token_files, shard_bytes, write_token_files
from quillspark.llm.token_ids import Encoder, default_path

from .cases import awkward, empty


def library_ids(texts):
    t = Tokenizer.from_file(default_path())
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_library():
    texts = ["", " ", "a", " a", "a ", "a  b", "it's 'quoted' don't", "x\ny", "x.\nYes, no!\n\nz", "é à 漢字 1,234.5", "tab\tx y", "<|endoftext|> x", "a\x1c b", "word.\nnext; b", "a.b c_d"]
    r = random.Random(5)
    signs = ["a", "b", "'", "s", "ll", " ", " ", "\n", "\t", "1", ",", "!", "é", "×", "漢", "\x0b", "\x1c"]
    texts += ["".join(r.choice(signs) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    want = library_ids(texts)
    for e in (Encoder(default_path()), Encoder(default_path(), bits=4)):
        got = []
        for column in (pa.array([*texts[:40], None]), pa.array(texts[40:])):
            for a, b, ids, begin in e.slices(column):
                got += [ids[begin[k] : begin[k + 1]].tolist() for k in range(b - a)]
        assert got.pop(40) == [] and got == want


@pytest.mark.parametrize("open_windows,parts", [(1, 3), (4, 5), (64, 40)])
def test_pack_covers_every_id_once(spark, open_windows, parts):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(parts)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = pack(docs, default_path(), open_windows=open_windows, fan_in=4).collect()
    ids = {d: x + [1] for d, x in zip(texts, library_ids(texts.values()))}
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for d, rows in by_doc.items():
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[d])
            assert r.ids_crc32 == crc(ids[d][at : at + r.length])
            at += r.length
        assert at == len(ids[d])
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(by_seq) <= -(-total // 2048) + open_windows + 1


def test_pack_awkward_rows(spark):
    docs = awkward(spark)
    got = pack(docs, default_path(), keep_ids=True).collect()
    assert sum(r.start == 0 for r in got) == docs.count()
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.collect()}
    assert all(len(r.ids) == 4 * r.length for r in got)
    assert pack(empty(spark), default_path()).count() == 0


def test_perfect_hash_is_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 20000))
    levels, blocks = hash_blocks(keys)
    assert sorted(numbers(keys, levels.astype(np.int64), lambda wanted: blocks[wanted])) == list(range(len(keys)))


def test_a_lookup_reads_little_of_a_shard():
    keys, kind = np.arange(0, 300_000, 3), np.dtype("<u2")
    raw = b"".join(shard_bytes(keys, [np.full(50, k % 60_000, kind).tobytes() for k in keys.tolist()], kind))
    shard = Shard(pa.BufferReader(raw))
    assert [(s, len(i), int(i[0])) for _, s, i in shard.records(np.array([60_003, 60_004]))] == [(20_001 * 50, 50, 3)]
    assert shard.read.bytes_read < 20_000 < len(raw) / 500
    assert sum(1 for _ in Shard(pa.BufferReader(raw)).records(keys[::-1].copy())) == len(keys)


def test_rows_of_one_key_may_fill_many_shards(spark):
    rows = [(7, f"text {k}") for k in range(40)] + [(5, "five"), (9, "nine"), (9, "nine")]
    folder = f"file://{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    manifest = write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), folder, default_path(), shard_ids=20)
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in read_token_files(spark.createDataFrame([(7,), (5,), (9,), (8,), (7,)], "doc_id long"), folder, manifest).collect())
    assert manifest.count() > 5 and [d for _, d, _ in got] == [5] + [7] * 40 + [9] * 2
    assert all(a[0] + a[2] == b[0] for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("shard_ids", [1, 5000, 1 << 23])
def test_token_files_round_trip(spark, shard_ids):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    folder = f"file://{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    manifest = write_token_files(docs, folder, default_path(), shard_ids=shard_ids)
    got = {r.doc_id: r for r in read_token_files(docs.select("doc_id"), folder, manifest).collect()}
    start = 0
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    for r, ids in zip(rows, library_ids([r.text for r in rows])):
        ids = ids + [2]
        g = got[r.doc_id]
        assert (g.start, g.n_tokens, zlib.crc32(g.ids)) == (start, len(ids), crc(ids))
        start += len(ids)
    strange = spark.range(10**6, 10**6 + 500)
    assert read_token_files(strange, folder, manifest).count() == 0


def test_token_files_awkward_rows(spark):
    docs = awkward(spark)
    docs = docs.unionByName(docs.where("doc_id is null").withColumn("text", F.lit("another without an id")))
    folder = f"file://{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    manifest = write_token_files(docs, folder, default_path())
    got = read_token_files(docs.select("doc_id"), folder, manifest).orderBy("start").collect()
    order = lambda d: (d is not None, d or 0)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in docs.collect()), key=order) and [r.doc_id for r in got][:3] == [None, None, 1]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:])) and got[0].start == 0
    texts = [r.text or "" for r in docs.collect()]
    assert sorted(bytes(r.ids) for r in got) == sorted(np.array(ids + [2], "<u4").tobytes() for ids in library_ids(texts))
    assert {r.doc_id for r in read_token_files(docs.where("doc_id = 1").select("doc_id"), folder, manifest).collect()} == {1}
    none = write_token_files(empty(spark), folder + "x", default_path())
    assert none.count() == 0 and read_token_files(docs.select("doc_id"), folder + "x", none).count() == 0
