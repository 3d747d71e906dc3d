import zlib

import numpy as np

from condeval.llm import sharding as S

DDL = "doc_id bigint, text string, shard string"


def plain_jump(key, shards):
    shard, target = -1, 0
    while target < shards:
        shard = target
        key = (key * 2862933555777941757 + 1) % 2**64
        target = int((shard + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return shard


def test_jump_matches_the_published_loop():
    keys = np.random.default_rng(0).integers(0, 2**63, 2000).astype(np.uint64) * np.uint64(2)
    for shards in (1, 2, 8, 9, 100):
        assert S.jump(keys, shards).tolist() == [plain_jump(int(k), shards) for k in keys]


def test_growth_moves_only_into_the_new_shard():
    keys = np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64)
    for shards in (1, 8, 30):
        before, after = S.jump(keys, shards), S.jump(keys, shards + 1)
        moved = before != after
        assert (after[moved] == shards).all() and abs(moved.mean() - 1 / (shards + 1)) < 0.02


def test_slots_sizes_and_sums(spark, monkeypatch):
    rows = [(i, f"text {i % 50}" if i % 7 else None, "x") for i in range(500)]
    rows += [(3, rows[3][1], "x"), (None, "é😀", "x"), (None, "", "x"), (600, "long " * 100_000, "x")]
    table = spark.createDataFrame(rows, DDL)
    whole = sorted(map(str, S.sharded(table).collect()))
    monkeypatch.setattr(S, "SLICE_ROWS", 5)
    got = S.sharded(table.repartition(7)).collect()
    assert sorted(map(str, got)) == whole
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(
        (str(k), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t, _ in rows
    )
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "key" and (r.grown_shard == r.shard or r.grown_shard == 8)
    assert set(slots) == set(range(8)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    places = {}
    for r in got:
        places.setdefault(r.doc_id, set()).add(r.shard)
    assert all(len(v) == 1 for v in places.values())
    assert S.sharded(table.limit(0)).count() == 0


def test_shards_are_those_of_the_published_loop(spark):
    """The query's own shards, from the same hash of the key, one by one."""
    table = spark.range(-200, 800).selectExpr("id AS doc_id", "'t' AS text")
    hashes = {r.doc_id: r.h for r in table.selectExpr("doc_id", "xxhash64(doc_id) AS h").collect()}
    for r in S.sharded(table).collect():
        key = hashes[r.doc_id] % 2**64
        assert (r.shard, r.grown_shard) == (plain_jump(key, 8), plain_jump(key, 9))


def test_shards_are_written(spark, tmp_path):
    table = spark.createDataFrame([(i, "t") for i in range(60)], "doc_id bigint, text string")
    S.write_shards(table, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 60 and back.where("shard = 3").count() > 0
