"""Tensor files: round trips, byte ranges, what is read, torn files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runforge.sources import tensor_files as TF


def save(path, tensors):
    """A file as other programs write it; tensors are (name, code, array)."""
    at, told, data = 0, {"__metadata__": {"format": "pt"}}, b""
    for name, code, x in tensors:
        raw = TF.stored(x.ravel(), code)
        told[name] = {"dtype": code, "shape": list(x.shape), "data_offsets": [at, at + len(raw)]}
        at, data = at + len(raw), data + raw
    text = json.dumps(told).encode()
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(len(text).to_bytes(8, "little") + text + data)


@pytest.fixture
def models(tmp_path):
    rng = np.random.default_rng(1)
    one = [("z.weight", "F32", rng.normal(size=(50, 7))), ("a.bias", "F64", rng.normal(size=7)), ("half", "F16", rng.normal(size=(3, 2))),
           ("brain", "BF16", rng.normal(size=(4, 5))), ("ids", "I64", np.arange(6).reshape(3, 2)), ("cube", "F32", rng.normal(size=(2, 3, 4))),
           ("scalar", "F32", np.array(2.5)), ("empty", "F32", np.zeros((0, 4))), ("flags", "BOOL", np.array([1, 0, 1]))]
    two = [("z.weight", "F32", rng.normal(size=(9, 7)))]
    save(tmp_path / "m" / "one" / "x.safetensors", one)
    save(tmp_path / "m" / "two" / "y.safetensors", two)
    (tmp_path / "m" / "two" / "notes.txt").write_text("no tensor")
    return str(tmp_path / "m"), {"one": one, "two": two}


@pytest.mark.parametrize("partition_bytes", [64 << 20, 60])
def test_rows_of_every_type(spark, models, partition_bytes):
    root, held = models
    got = {(r.model, r.matrix_id, r.row_id): r.vec for r in TF.read_tensors(spark, root, partition_bytes=partition_bytes).collect()}
    want = {}
    for model, tensors in held.items():
        for name, code, x in tensors:
            x = TF.numbers(TF.stored(x.ravel(), code), code).reshape(x.shape)
            for k, row in enumerate([y.ravel() for y in x] if x.ndim > 1 else [x.ravel()]):
                want[model, name, k] = row.tolist()
    assert got == want


def test_manifest_in_the_models_own_order(spark, models):
    root, held = models
    rows = TF.read_manifest(spark, root).orderBy("model", "position").collect()
    assert [(r.model, r.name, tuple(r.shape), r.dtype, r.numel) for r in rows] == \
        [(m, n, x.shape, TF.TYPES[c][0], x.size) for m, t in held.items() for n, c, x in t]


class Counting:
    """A store that counts the bytes read from it."""

    def __init__(self, store):
        self.store, self.bytes = store, 0

    def get_file_info(self, what):
        return self.store.get_file_info(what)

    def open_input_file(self, path):
        outer, file = self, self.store.open_input_file(path)

        class Input:
            def __enter__(self):
                return self

            def __exit__(self, *a):
                file.close()

            def read(self, n):
                outer.bytes += n
                return file.read(n)

            seek, close = staticmethod(file.seek), staticmethod(file.close)

        return Input()


def scanned(monkeypatch, root, schema, **options):
    """Rows and bytes of a scan in this process."""
    from pyarrow import fs
    store = Counting(fs.LocalFileSystem())
    monkeypatch.setattr(TF, "open_store", lambda path: (store, path))
    reader = TF.TensorReader({"path": root, **options}, T._parse_datatype_string(schema))
    parts = reader.partitions()
    planned = store.bytes
    rows = [r for p in parts for r in reader.read(p)]
    return rows, planned, store.bytes - planned


def test_bytes_read(monkeypatch, models):
    root, held = models
    heads = sum(8 + int.from_bytes(open(f"{root}/{p}", "rb").read(8), "little") for p in ("one/x.safetensors", "two/y.safetensors"))
    data = sum(len(TF.stored(x.ravel(), c)) for t in held.values() for _, c, x in t)
    assert scanned(monkeypatch, root, TF.MANIFEST, rows="false")[1:] == (0, heads)
    assert scanned(monkeypatch, root, TF.TENSORS)[1:] == (heads, data)
    assert scanned(monkeypatch, root, "matrix_id string, row_id long")[1:] == (heads, 0)
    _, planned, read = scanned(monkeypatch, root, TF.TENSORS, models='["two"]', names='["*.weight"]')
    assert planned < heads and read == 9 * 7 * 4


def test_selections(spark, models):
    root, _ = models
    few = ["model", "matrix_id", "row_id"]
    for chosen, names, n in ((["two"], None, 9), (None, ["*.weight"], 59), (None, ["half", "i?s"], 6), (["x"], None, 0), (["two"], ["half"], 0)):
        df = TF.read_tensors(spark, root, chosen, names, columns=few)
        assert df.count() == n and df.columns == few
        assert TF.read_manifest(spark, root, chosen, names).count() == {9: 1, 59: 2, 6: 2, 0: 0}[n]


def test_plans_share_a_relation(spark, models):
    """Filters of one plan leave other plans over the same DataFrame alone."""
    m = TF.read_manifest(spark, models[0])
    assert [m.where(f"model = '{x}'").count() for x in ("one", "two")] == [9, 1] and m.count() == 10
    assert m.where("model = 'one'").join(m.where("model = 'two'").select("name"), "name").count() == 1


@pytest.mark.parametrize("shard_bytes", [1 << 30, 100])
def test_write_and_read_back(spark, tmp_path, shard_bytes):
    rng = np.random.default_rng(3)
    rows = [(m, f"t{t}", int(10 * r), rng.normal(size=4 + t).astype(np.float32).tolist(), "float32", False)
            for m in "ab" for t in range(6) for r in range(3 + t)]
    rows += [("a", "bias", 0, [1.0, 2.0], "float32", True), ("b", "half", 5, [0.5, -1.25], "bfloat16", False)]
    df = spark.createDataFrame(rows, "model string, matrix_id string, row_id long, vec array<float>, dtype string, flat boolean").repartition(5)
    root = str(tmp_path / "m")
    files = TF.write_tensors(df, root, shard_bytes).collect()
    assert sum(f.tensors for f in files) == 14 and (len(files) == 2) == (shard_bytes > 1000)
    import os
    assert all(os.path.getsize(f.file) == f.bytes for f in files)
    got = {(r.model, r.matrix_id, r.row_id): r.vec for r in TF.read_tensors(spark, root).collect()}
    order = {}
    for m, name, r, vec, *_ in sorted(rows, key=lambda x: x[:3]):
        order.setdefault((m, name), []).append(vec)
    assert got == {(*k, i): v for k, vs in order.items() for i, v in enumerate(vs)}
    shapes = {(r.model, r.name): (list(r.shape), r.dtype) for r in TF.read_manifest(spark, root).collect()}
    assert shapes["a", "bias"] == ([2], "float32") and shapes["b", "half"] == ([1, 2], "bfloat16") and shapes["a", "t2"] == ([5, 6], "float32")


def test_faults_name_the_file(spark, tmp_path):
    save(tmp_path / "m" / "torn.safetensors", [("w", "F32", np.ones((4, 4)))])
    whole = (tmp_path / "m" / "torn.safetensors").read_bytes()
    for data, why in ((whole[:-3], "tensor w is cut off"), (whole[:20], "the header is cut off"), (b"", "no whole tensor file"),
                      (whole.replace(b"F32", b"F99"), "unknown type")):
        (tmp_path / "m" / "torn.safetensors").write_bytes(data)
        with pytest.raises(Exception, match=f"torn.safetensors.*{why}|{why}"):
            TF.read_manifest(spark, str(tmp_path)).collect()
        with pytest.raises(Exception, match="torn.safetensors"):
            TF.read_tensors(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="unlike length"):
        TF.write_tensors(spark.createDataFrame([("a", "w", 0, [1.0]), ("a", "w", 1, [1.0, 2.0])], TF.TENSORS), str(tmp_path / "o"))


def test_tensors_feed_the_matrix_operators(spark, models):
    from runforge.operators import matrices as K
    root, held = models
    stats = K.matrix_stats(TF.read_tensors(spark, root, names=["z.*"]), ["model", "matrix_id"])
    got = {r.model: r.norm for r in stats.select("model", F.round("norm", 3).alias("norm")).collect()}
    assert got == {m: round(float(np.linalg.norm(t[0][2])), 3) for m, t in held.items()}
