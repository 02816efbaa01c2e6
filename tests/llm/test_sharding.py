import zlib

import numpy as np
import pytest

from eventmill.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000, 4097])
def test_permutation_and_inverse(n):
    places = sharding.permute(np.arange(n), n)
    assert sorted(places) == list(range(n))
    assert (sharding.permute(places, n, back=True) == np.arange(n)).all()


def test_odd_rows(odd_docs):
    rows = sharding.shard_rows(odd_docs, shards=4).collect()
    assert len(rows) == odd_docs.count()
    counts = [sorted(r.slot for r in rows if r.shard == s) for s in range(4)]
    assert all(c == list(range(len(c))) for c in counts)
    assert max(map(len, counts)) - min(map(len, counts)) <= 1
    want = sorted((len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in odd_docs.collect())
    assert sorted((r["size"], r.text_crc32) for r in rows) == want
    places = sharding.permute(np.arange(len(rows)), len(rows))
    assert all((r.shard, r.slot) == (places[r.row_number] % 4, places[r.row_number] // 4) for r in rows)


def test_same_shards_however_rows_are_dealt(odd_docs):
    known = odd_docs.filter("doc_id is not null")
    one, other = (
        sorted(tuple(r) for r in sharding.shard_rows(d).drop("row_number").collect())
        for d in (known, known.repartition(5, "text"))
    )
    assert one == other


def test_empty(no_docs):
    assert sharding.shard_rows(no_docs).count() == 0


def test_written_in_slot_order(spark, odd_docs, tmp_path):
    placed = sharding.shard_rows(odd_docs, shards=2)
    sharding.write_shards(placed, str(tmp_path / "out"), block=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == odd_docs.count()
    assert all(r["max(slot)"] // 4 == r.block for r in back.groupBy("shard", "block").max("slot").collect())
