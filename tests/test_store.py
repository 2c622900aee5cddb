import uuid

import numpy as np
import pytest

from vectrail.operators.store import DiskStore, VectorStore
from vectrail.sources import vectorfile as B


def rows(spark, pairs, key="bigint"):
    return spark.createDataFrame([(i, [float(x) for x in v], n) for n, (i, v) in enumerate(pairs)], f"id {key}, values array<float>, order bigint")


def values(store):
    return sorted((r["id"], list(r["values"])) for r in store.rows.collect())


def test_memory_store(spark):
    store = VectorStore.create(spark, "m", 2)
    assert store.count() == 0 and store.search([1.0, 0.0], 3).count() == 0
    store = store.add(rows(spark, [(1, [1, 0]), (2, [0, 1])])).add(rows(spark, [(1, [5, 5])]))
    assert store.count() == 3
    store, found = store.remove(1)
    assert found and values(store) == [(1, [5.0, 5.0]), (2, [0.0, 1.0])]
    assert store.remove(9)[1] is False
    with pytest.raises(Exception, match="does not have 2 dimensions"):
        store.add(rows(spark, [(1, [1, 0, 0])])).rows.collect()
    for name, n in ((None, 2), ("x", 0)):
        with pytest.raises(ValueError):
            VectorStore.create(spark, name, n)


def test_disk_store(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    store = DiskStore(spark, "d", path, 2)
    assert store.count() == 0 and store.compact() is False
    store.add(rows(spark, [(1, [1, 0]), (2, [0, 1]), (1, [2, 0])]))
    assert store.count() == 3
    assert store.remove(1) is True and store.remove(1) is False
    assert values(store) == [(2, [0.0, 1.0])]
    store.add(rows(spark, [(1, [7, 7])]))
    again = DiskStore(spark, "d", path, 2)
    assert values(again) == [(1, [7.0, 7.0]), (2, [0.0, 1.0])]
    assert again.compact() is True and again.count() == 2
    again.vacuum()
    assert values(DiskStore(spark, "d", path, 2)) == values(again)
    with pytest.raises(ValueError):
        DiskStore(spark, "d", path, 3)
    with pytest.raises(ValueError):
        DiskStore(spark, "d", path, 2, "string")


def test_an_empty_store_has_a_dimension(spark, tmp_path):
    path = f"file://{tmp_path}/empty"
    DiskStore(spark, "d", path, 3)
    with pytest.raises(ValueError, match="3 dimensions"):
        DiskStore(spark, "d", path, 8)


def test_a_named_batch_is_added_once(spark, tmp_path):
    store = DiskStore(spark, "d", f"file://{tmp_path}/s", 2)
    store.add(rows(spark, [(1, [1, 0]), (2, [0, 1])]))
    for _ in range(2):
        store.add(rows(spark, [(3, [1, 1])]), "x")
    assert sorted(r["id"] for r in store.rows.collect()) == [1, 2, 3]


def test_removals_of_repeated_orders(spark):
    twice = VectorStore("m", 2, VectorStore.of("m", 2, rows(spark, [(1, [1, 0]), (2, [0, 1])])).rows.unionByName(VectorStore.of("m", 2, rows(spark, [(1, [1, 0]), (1, [5, 5])])).rows))
    assert values(twice.remove(1)[0]) == [(1, [1.0, 0.0]), (1, [5.0, 5.0]), (2, [0.0, 1.0])]
    keys = spark.createDataFrame([(1,), (7,)], "k bigint")
    assert values(twice.remove_first(keys)) == [(1, [1.0, 0.0]), (1, [5.0, 5.0]), (2, [0.0, 1.0])]


def test_only_committed_files_are_read(spark, tmp_path, monkeypatch):
    B.register(spark)
    path = f"file://{tmp_path}/v"
    store = VectorStore.of("m", 2, rows(spark, [(n, [n, 1]) for n in range(50)]).repartition(3))
    store.save(path, "bigint")
    store.save(path, "bigint")
    (tmp_path / "v" / "part-000000-000000-lost.vec").write_bytes(b"short")  # of a task that was lost in mid-write
    one = next(f for f in (tmp_path / "v").glob("*.vec") if f.stat().st_size > 5)
    (tmp_path / "v" / "part-000000-000000-again.vec").write_bytes(one.read_bytes())  # of a task that ran twice
    found = VectorStore.load(spark, "b", 2, path, "bigint")
    assert sorted(r["id"] for r in found.rows.collect()) == sorted([*range(50)] * 2)
    assert found.rows.select("seq").distinct().count() == 100
    store.rows.select("id", "values", "magnitude").write.format("vectorfile").options(keyType="bigint", dimension="2").mode("overwrite").save(path)
    assert VectorStore.load(spark, "b", 2, path, "bigint").count() == 50
    (tmp_path / "w" / B.MANIFESTS).mkdir(parents=True)
    (tmp_path / "w" / "part-0.vec").write_bytes(b"short")  # a first write that never committed
    assert VectorStore.load(spark, "b", 2, f"file://{tmp_path}/w", "bigint").count() == 0


def test_files_are_bounded(tmp_path, monkeypatch):
    import pyarrow as pa

    class Context:
        @staticmethod
        def get():
            return Context

        @staticmethod
        def partitionId():
            return 0

    monkeypatch.setattr("pyspark.TaskContext", Context)
    monkeypatch.setattr(B, "FILE_BYTES", 100)
    batch = pa.RecordBatch.from_pydict({"id": [1, 2, 3], "values": [[1.0, 2.0]] * 3, "magnitude": [1.0] * 3}, schema=pa.schema([("id", pa.int64()), ("values", pa.list_(pa.float32())), ("magnitude", pa.float32())]))
    writer = B.Writer({"path": f"file://{tmp_path}/f", "dimension": "2"}, False)
    written = writer.write(iter([batch] * 5))
    assert len(written.names) == 3
    writer.commit([written])
    with pytest.raises(ValueError, match="15 records"):
        B.Writer({"path": f"file://{tmp_path}/f", "dimension": "2", "records": "16"}, False).write(iter([batch] * 5))


def test_header_and_sizes():
    assert B.unpack_header(B.pack_header(768, 16, 100)) == (768, 16, 100)
    assert B.record_size(16, 768) == 3093 and B.record_size(4, 3) == 21
    assert B.record_type("guid", 768).itemsize == 3093
    bad = [bytes(20), bytes(5), B.HEADER.pack(B.MAGIC, 99, 1, 4, 0), B.pack_header(-1, 4, 0), B.pack_header(3, 4, -5), B.pack_header(3, 2000, 0)]
    for data in bad:
        with pytest.raises(ValueError):
            B.unpack_header(data)


@pytest.mark.parametrize("key, ids", [("bigint", [123456789, -1, 5]), ("int", [42, 0, -7]), ("guid", [str(uuid.UUID(int=i)) for i in (1, 2**100, 77)])])
def test_binary_round_trip(spark, tmp_path, key, ids):
    B.register(spark)
    path = f"file://{tmp_path}/v"
    kind = "string" if key == "guid" else key
    store = VectorStore.of("m", 4, rows(spark, [(i, [n, 0.5, -1, 2]) for n, i in enumerate(ids)], kind))
    store.save(path, key, single=True)
    back = VectorStore.load(spark, "b", 4, path, key)
    assert [(r["id"], list(r["values"])) for r in back.rows.orderBy("seq").collect()] == [(i, [n, 0.5, -1.0, 2.0]) for n, i in enumerate(ids)]
    with pytest.raises(Exception, match="dimensions"):
        VectorStore.load(spark, "b", 5, path, key).rows.collect()


def test_tombstones_splits_and_damage(spark, tmp_path):
    B.register(spark)
    kind = B.record_type("bigint", 2)
    data = np.zeros(5, kind)
    data["key"], data["values"], data["magnitude"] = np.arange(5), [[i, 1] for i in range(5)], 9
    data["status"][[1, 3]] = 1, 7
    (tmp_path / "a.vec").write_bytes(B.pack_header(2, 8, 5) + data.tobytes())
    path = f"file://{tmp_path}/a.vec"
    found = spark.read.format("vectorfile").option("recordsPerSplit", "2").load(path)
    assert sorted(r["id"] for r in found.where("status <> 1").collect()) == [0, 2, 3, 4]
    assert VectorStore.load(spark, "x", 2, path, "bigint").rows.first()["magnitude"] == 9.0  # taken as it stands
    (tmp_path / "b.vec").write_bytes(B.pack_header(2, 8, 9) + data.tobytes())
    with pytest.raises(Exception, match="ends within"):
        spark.read.format("vectorfile").load(f"file://{tmp_path}/b.vec").collect()
    with pytest.raises(Exception, match="bytes"):
        spark.read.format("vectorfile").option("keyType", "int").load(path).collect()
