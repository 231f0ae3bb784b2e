import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from colloquy.llm import op2_shards as op
from colloquy.llm.common import Staging
from colloquy.llm.mph import Index
from tests.llm.test_op10 import ODD, TWINS


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path(op.VOCABULARY))


def digests(rows, library):
    """Brute force over (doc_id, text) rows."""
    out, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_index_is_minimal_perfect_and_knows_foreign_keys():
    keys = np.random.default_rng(1).choice(2**62, 50_000, replace=False)
    n = np.arange(len(keys))
    made = Index.loads(Index.build(keys, n, n * 3, n % 7).dumps())
    known, ordinal, offset, length = made.get(keys)
    assert known.all() and (ordinal == n).all() and (offset == n * 3).all() and (length == n % 7).all()
    assert made.get(np.arange(1, 10_000))[0].mean() < 0.001
    assert not Index.loads(Index.build(keys[:0], n[:0], n[:0], n[:0]).dumps()).get(keys[:5])[0].any()


def test_files_equal_the_library(spark, library, monkeypatch):
    monkeypatch.setattr(op, "SHARD_IDS", 50)
    rows = [(10 - i, t) for i, t in enumerate(ODD)] + [(3, "again # \" !"), (3, None), (None, "no key"), (None, None), (10**12, "<|endoftext|> is text"), (11**11, "hi <|endoftext|> there"), (2000, TWINS[0]), (2001, TWINS[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "'x' as payload", "2 as key")
    staging = Staging(spark, "test-shards")
    shards = op.write_shards(df, staging, "ids")
    got = [tuple(r) for r in op.read_digests(shards).collect()]
    # the two rows of key 3 lie in the order of their texts' hashes
    of = lambda rs: sorted((r[0] is not None, r[0] or 0, r[2], r[3]) for r in rs)
    assert of(got) == of(digests(rows, library))
    assert [r[1] for r in sorted(got, key=lambda r: r[1])] == np.cumsum([0, *(r[2] for r in sorted(got, key=lambda r: r[1]))])[:-1].tolist()
    once = {k: t for k, t in rows if k is not None and k != 3}
    found = {r.key: r.ids for r in op.find(shards, [*once, 3, 12345]).collect()}
    assert set(found) == {*once, 3}
    assert all(found[k] == [*library.encode(t or "", add_special_tokens=False).ids, 2] for k, t in once.items())
    for row in shards.collect():
        for key, ids in zip(row["keys"], op.lookup(row.asDict(), [k or 0 for k in row["keys"]])):
            if key is not None:
                assert ids[-1] == 2
    staging.drop()


def test_empty_table(spark):
    staging = Staging(spark, "test-shards")
    assert op.read_digests(op.write_shards(spark.createDataFrame([], "doc_id long, text string"), staging, "ids")).collect() == []
    staging.drop()


def test_query(spark, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted((tuple(r) for r in op.op2_token_shards(spark, "/root/testdata/sf0.001").collect()), key=lambda r: r[1]) == digests(rows, library)


def test_one_repeated_key_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(op, "PARTITION_BYTES", 1 << 10)
    monkeypatch.setattr(op, "SHARD_IDS", 100)
    df = spark.createDataFrame([(i // 900, f"text {i % 7}") for i in range(1000)], "doc_id long, text string")
    staging = Staging(spark, "test-shards")
    shards = op.write_shards(df, staging, "ids")
    assert max(r.n for r in shards.groupBy("part").sum("n_docs").withColumnRenamed("sum(n_docs)", "n").collect()) < 500
    assert op.read_digests(shards).count() == 1000 and op.find(shards, [0, 1]).count() == 2
    staging.drop()
