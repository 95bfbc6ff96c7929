from __future__ import annotations

import datetime
import decimal
import http.server
import itertools
import json
import os
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geotable import __main__ as cli
from geotable.functions import bbox as B
from geotable.functions import geometry as G
from geotable.sources import binary, geojson
from geotable.sources import layout as L
from geotable.streaming import feeds

RECT = (10.0, 10.0, 40.0, 30.0)


def grid(spark, n=400):
    x, y = (F.col("id") % 20 * 5).cast("double"), F.floor(F.col("id") / 20).cast("double") * 5
    return spark.range(n).select(F.col("id").alias("fid"), G.point(x, y).alias("geometry"), F.col("id").alias("key"), F.concat(F.lit("n"), "id").alias("name"))


def brute(df, rect=RECT):
    return {r.key for r in B.filter_rect(df.withColumn("bbox", G.bbox("geometry")), rect).collect()}


def test_write_and_read(spark, tmp_path):
    path, df = str(tmp_path / "a"), grid(spark)
    binary.write(df.repartition(3), path, srid=25832, name="grid", title="T")
    back = binary.read(spark, path)
    assert {r.key for r in back.collect()} == set(range(400))
    assert sorted(r.fid for r in back.collect()) == list(range(400))
    assert {r.key for r in binary.read(spark, path, RECT).collect()} == brute(df)
    assert all(r.name == f"n{r.key}" for r in back.collect())
    info = binary.header_info(spark, path).collect()
    assert sum(int(r.features_count) for r in info) == 400 == binary.count_features(spark, path)
    assert {(r.crs.code, r["name"], r.title, r.geometry_type) for r in info} == {(25832, "grid", "T", 1)}


def test_ids_do_not_depend_on_the_rectangle(spark, tmp_path):
    path = str(tmp_path / "a")
    binary.write(grid(spark).coalesce(1), path)
    every = {r.key: r.fid for r in binary.read(spark, path).collect()}
    some = {r.key: r.fid for r in binary.read(spark, path, RECT, gap=0).collect()}
    wide = {r.key: r.fid for r in binary.read(spark, path, RECT, gap=1 << 20).collect()}
    assert some and some == wide and all(every[k] == v for k, v in some.items())


def test_split_into_parts(spark, tmp_path):
    path = str(tmp_path / "a")
    binary.write(grid(spark).coalesce(1), path)
    df = binary.read(spark, path, split=2000)
    assert df.rdd.getNumPartitions() > 5 and df.select("fid").distinct().count() == 400


def test_a_million_leaves_are_planned_in_no_time(tmp_path):
    n = 1_000_000
    x = np.arange(n) % 1000 * 0.3 - 150
    y = np.arange(n) // 1000 * 0.1 - 50
    boxes = np.stack([x, y, x + 0.01, y + 0.01], axis=1)
    body = L.write_feature({"type": 1, "parts": [{"path": [], "type": 1, "xy": [1.0, 2.0]}]}, [], [])
    path = str(tmp_path / "many.bin")
    with open(path, "wb") as f:
        f.write(L.MAGIC + L.write_header(L.Header(features_count=n)) + L.build_tree(boxes, np.arange(n) * len(body), 16))
        f.write(body * n)
    opened = binary.Opened.of(path)
    began = time.time()
    parts, _ = binary._batches(opened, None, binary.GAP, 8 << 20, 0)
    every, _ = binary._batches(opened, (-200.0, -200.0, 200.0, 200.0), 0, 8 << 20, 0)
    some, _ = binary._batches(opened, (0.0, 0.0, 0.2, 90.0), 0, 8 << 20, 0)
    assert time.time() - began < 6
    assert len(parts) > 5 and len(every) == len(parts) and all(len(p.ranges) == 1 for p in every)
    assert sum(len(runs) for p in some for _, _, runs in p.ranges) == 500
    # features follow each other from part to part
    stops = [(a, b, i) for p in parts for _, _, runs in p.ranges for a, b, i in runs]
    assert all(x[1] == y[0] and y[2] == (y[0] - opened.data_at) // len(body) for x, y in itertools.pairwise(stops)) and stops[-1][1] == opened.size
    monkey = binary.LEAVES
    try:  # larger indexes are sampled
        binary.LEAVES = 1000
        assert [p.ranges for p in binary._batches(opened, None, binary.GAP, 8 << 20, 0)[0]][-1][0][1] == opened.size
    finally:
        binary.LEAVES = monkey


def test_unindexed_files_are_split(spark, tmp_path):
    path = str(tmp_path / "a")
    binary.write(grid(spark).coalesce(1), path, index="false", count="false")
    df = binary.read(spark, path, split=3000)
    assert df.rdd.getNumPartitions() > 4
    got = {r.key: r.fid for r in df.collect()}
    assert sorted(got.values()) == list(range(400)) and got == {r.key: r.fid for r in binary.read(spark, path).collect()}
    assert binary.header_info(spark, path).first().features_count == 0 and binary.count_features(spark, path) == 400


@pytest.mark.parametrize("spool", [1 << 30, 500])
def test_batches_equal_features_one_by_one(spark, tmp_path, monkeypatch, spool):
    """What the batch encoder and decoder make equals what the table reader and writer make, for plain and unusual features mixed."""
    monkeypatch.setattr(binary, "SPOOL", spool)
    rng = np.random.default_rng(5)
    part = lambda **k: {"path": [], "type": 2, "ends": None, "xy": None, "z": None, "m": None, "t": None, "tm": None} | k
    line = lambda n, **k: {"type": 2, "parts": [part(xy=rng.normal(size=2 * n).tolist(), **k)]}
    shapes = [line(1 + i % 5) for i in range(60)] + [None, {"type": 1, "parts": [part(type=1, xy=[float("nan"), 1.0])]}, line(3, z=[1.0, 2.0, 3.0]), line(2, m=[0.5, 0.25]), line(0), {"type": 3, "parts": [part(type=3, xy=rng.normal(size=16).tolist(), ends=[4, 8])]}]
    odd = [line(2, t=[1.0, 2.0]), {"type": 6, "parts": [part(type=3, path=[0], xy=[0.0, 0.0, 1.0, 0.0, 1.0, 1.0, 0.0, 0.0])]}]
    schema = T.StructType([T.StructField("geometry", binary.data_type(G.TYPE)), T.StructField("k", T.LongType()), T.StructField("s", T.StringType()), T.StructField("b", T.BooleanType()), T.StructField("raw", T.BinaryType()), T.StructField("day", T.DateType())])
    for i, some in enumerate((shapes, shapes + odd)):
        rows = [(g, None if j % 7 == 0 else j, None if j % 5 == 0 else "é" * j, None if j % 3 == 0 else j % 2 == 0, b"\x00" * (j % 4), datetime.date(2024, 1, 1 + j % 28)) for j, g in enumerate(some)]
        df = spark.createDataFrame(rows, schema)
        path = str(tmp_path / f"w{i}")
        writer = binary.Writer({"name": "x"}, schema, path, False)
        batch = df.toArrow().combine_chunks().to_batches()[0]
        writer.commit([writer.write(iter([batch.slice(0, 20), batch.slice(20)]))])
        assert [p.name for p in (tmp_path / f"w{i}").iterdir() if p.name.startswith("_")] == []
        opened = binary.Opened.of(binary.files_of(path)[0])
        full = binary.schema_of(opened.header, None, True)
        whole = binary.read_part(binary._batches(opened, None, 0, 1 << 20, 0)[0][0], full, "FAILFAST", None)
        fast = [r for b in whole for r in b.to_pylist()]
        monkeypatch.setattr(binary.columnar, "decode", lambda *a: None)
        slow = [r for b in binary.read_part(binary._batches(opened, None, 0, 1 << 20, 0)[0][0], full, "FAILFAST", None) for r in b.to_pylist()]
        monkeypatch.undo()
        monkeypatch.setattr(binary, "SPOOL", spool)
        assert repr(fast) == repr(slow) and len(fast) == len(some)
        want = {repr((r[1:5], str(r[5]))) for r in rows}
        assert {repr(((r["k"], r["s"], r["b"], r["raw"]), r["day"])) for r in fast} == want


def test_ranges_over_http(spark, tmp_path):
    path = str(tmp_path / "a")
    binary.write(grid(spark).coalesce(1), path)
    raw = open(binary.files_of(path)[0], "rb").read()
    seen = []

    class Serve(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            a, b = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
            seen.append(self.headers.get("X-Key"))
            if a >= len(raw):
                self.send_response(416)
                self.send_header("Content-Range", f"bytes */{len(raw)}")
                self.end_headers()
                return
            part = raw[a : b + 1]
            self.send_response(206)
            self.send_header("Content-Range", f"bytes {a}-{a + len(part) - 1}/{len(raw)}")
            self.send_header("Content-Length", str(len(part)))
            self.end_headers()
            self.wfile.write(part)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Serve)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/a.bin"
        df = binary.read(spark, url, RECT, headers='{"X-Key": "k"}')
        assert {r.key for r in df.collect()} == brute(grid(spark)) and set(seen) == {"k"}
        assert sorted(r.fid for r in binary.read(spark, url).collect()) == list(range(400))
        assert int(binary.header_info(spark, url).first().features_count) == 400
        seen.clear()
        used = binary.usage(url, RECT)
        assert used["open_requests"] == 1 and len(seen) <= 3 and used["open_bytes"] <= 12_944 and used["requests"] <= 3
    finally:
        server.shutdown()


def test_search_by_levels_equals_the_whole_tree(tmp_path):
    rng = np.random.default_rng(3)
    for n, size in ((1, 2), (17, 16), (700, 4), (5000, 16)):
        low = rng.uniform(0, 100, (n, 2))
        boxes = np.concatenate([low, low + rng.uniform(0, 5, (n, 2))], axis=1)
        raw = L.build_tree(boxes, np.arange(n) * 10, size)
        for rect in ((10, 10, 20, 20), (0, 0, 200, 200), (-5, -5, -1, -1)):
            for gap in (0, 400, 1 << 20):
                reads = []
                ids, offsets, ends = L.search_levels(lambda a, k, reads=reads: reads.append(k) or raw[a : a + k], n, size, rect, gap)
                assert ids.tolist() == L.search_tree(raw, n, size, rect)
                assert offsets.tolist() == (ids * 10).tolist() and [e for e in ends.tolist()] == [i * 10 + 10 if i + 1 < n else -1 for i in ids.tolist()]
                assert sum(reads) <= len(raw) * 2


def test_without_index_a_rectangle_is_filtered(spark, tmp_path):
    path, df = str(tmp_path / "a"), grid(spark)
    binary.write(df, path, index="false")
    assert {r.key for r in binary.read(spark, path, RECT).collect()} == brute(df)
    assert binary.read(spark, path, table="index").count() == 0


def test_pushdown(spark, tmp_path):
    path, df = str(tmp_path / "a"), grid(spark)
    binary.write(df, path)
    got = B.filter_rect(binary.read(spark, path, pushdown="true"), RECT)
    assert {r.key for r in got.collect()} == brute(df)


def test_columns_and_geometry_options(spark, tmp_path):
    path = str(tmp_path / "a")
    binary.write(grid(spark), path)
    df = binary.read(spark, path, columns=["name"], geometry="false")
    assert df.columns == ["fid", "bbox", "name"] and df.where("name is null").count() == 0


def test_all_attribute_types(spark, tmp_path):
    meta = lambda n: {"attribute_type": n}
    schema = T.StructType(
        [
            T.StructField("geometry", binary.data_type(G.TYPE)), T.StructField("b", T.ByteType()), T.StructField("ub", T.ShortType(), True, meta("UByte")), T.StructField("bool", T.BooleanType()),
            T.StructField("s", T.ShortType()), T.StructField("us", T.IntegerType(), True, meta("UShort")), T.StructField("i", T.IntegerType()), T.StructField("ui", T.LongType(), True, meta("UInt")),
            T.StructField("l", T.LongType()), T.StructField("ul", T.DecimalType(20, 0)), T.StructField("f", T.FloatType()), T.StructField("d", T.DoubleType()), T.StructField("str", T.StringType()),
            T.StructField("j", T.StringType(), True, meta("Json")), T.StructField("dt", T.StringType(), True, meta("DateTime")), T.StructField("bin", T.BinaryType()),
        ]
    )
    point = {"type": 1, "parts": [{"path": [], "type": 1, "ends": None, "xy": [1.0, 2.0], "z": None, "m": None, "t": None, "tm": None}]}
    row = (point, -1, 255, True, -1, 65535, -1, 4294967295, -1, decimal.Decimal(18446744073709551615), 0.5, 1.7976931348623157e308, "X", "X", "2020-02-29T12:34:56Z", bytearray(b"X"))
    nulls = (point, *[None] * 15)
    binary.write(spark.createDataFrame([row, nulls], schema), str(tmp_path / "a"))
    got = binary.read(spark, str(tmp_path / "a")).where("str is not null").first()
    assert tuple(got[n] for n in schema.names[1:]) == row[1:]
    none = binary.read(spark, str(tmp_path / "a")).where("str is null").first()
    assert all(none[n] is None for n in schema.names[1:])
    kinds = [f.metadata["attribute_type"] for f in binary.read(spark, str(tmp_path / "a")).schema.fields[3:]]
    assert kinds == [n for n, _ in binary.ATTRIBUTES]


def test_geometries_there_and_back(spark, tmp_path):
    from test_functions import SHAPES

    df = spark.createDataFrame([(i, s) for i, s in enumerate(SHAPES)] + [(99, None)], "i int, j string").withColumn("geometry", G.from_geojson("j"))
    binary.write(df.coalesce(1), str(tmp_path / "a"))
    back = {r.i: (r.o, r.j) for r in binary.read(spark, str(tmp_path / "a")).select("i", "j", G.to_geojson("geometry").alias("o")).collect()}
    assert all(o == j for o, j in back.values()) and len(back) == len(SHAPES) + 1


def test_promotion(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "i int").withColumn("geometry", G.of_box(B.make(F.lit(0), F.lit(0), F.lit(1), F.lit(1))))
    binary.write(df, str(tmp_path / "a"), promote_to_multi="true")
    assert binary.read(spark, str(tmp_path / "a")).select(G.to_wkt("geometry").alias("w")).first().w == "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)))"


def test_malformed_files(spark, tmp_path):
    good = tmp_path / "good"
    binary.write(grid(spark, 50).coalesce(1), str(good))
    raw = next(p for p in good.iterdir() if p.suffix == ".bin").read_bytes()
    for name, bad in {
        "magic": b"nonsense" + raw[8:], "short": raw[:10], "cut": raw[:40], "huge": raw[:8] + b"\xff\xff\xff\xff" + raw[12:], "newer": raw[:3] + b"\x09" + raw[4:],
    }.items():
        (tmp_path / name).write_bytes(bad)
        with pytest.raises(Exception):  # noqa: B017, PT011
            binary.read(spark, str(tmp_path / name)).count()
    (tmp_path / "tail").write_bytes(raw[:-7])
    with pytest.raises(Exception):  # noqa: B017, PT011
        binary.read(spark, str(tmp_path / "tail")).collect()
    assert binary.read(spark, str(tmp_path / "tail"), mode="DROPMALFORMED").count() == 49


def test_bad_ends_by_mode(spark, tmp_path):
    xy = np.arange(4.0)
    ok, bad = ({"type": 3, "parts": [{"path": [], "type": 3, "ends": e, "xy": xy}]} for e in (None, [2, 1]))
    rows = [L.write_feature(g, [], []) for g in (ok, bad, ok)]
    (tmp_path / "f.bin").write_bytes(L.MAGIC + L.write_header(L.Header(index_node_size=0)) + b"".join(rows))
    read = lambda m: binary.read(spark, str(tmp_path / "f.bin"), mode=m)
    assert read("DROPMALFORMED").count() == 2
    assert [r.geometry is None for r in read("PERMISSIVE").orderBy("fid").collect()] == [False, True, False]
    with pytest.raises(Exception, match="ends"):
        read("FAILFAST").collect()


def test_unknown_count_reads_to_the_end(spark, tmp_path):
    rows = [L.write_feature({"type": 1, "parts": [{"path": [], "type": 1, "ends": None, "xy": [float(i), 0.0]}]}, [], []) for i in range(3)]
    (tmp_path / "f.bin").write_bytes(L.MAGIC + L.write_header(L.Header(features_count=0)) + b"".join(rows))
    assert binary.read(spark, str(tmp_path / "f.bin")).count() == 3 == binary.count_features(spark, str(tmp_path / "f.bin"))


def test_header_there_and_back():
    h = L.Header("n", [1.0, 2.0, 3.0, 4.0], 6, True, False, True, False, [L.Column("a", 5, "t", "d", 7, 8, 9, False, True, True, "{}")], 5, 4, L.Crs("EPSG", 4326, "w", "d", "wkt", "c"), "t", "d", "{}")
    assert L.read_header(L.write_header(h)[4:]) == h
    assert L.read_header(L.write_header(L.Header())[4:]) == L.Header()


def test_last_of_repeated_values_wins_and_bad_columns_fail():
    cols = [L.Column("a", 5)]
    pair = L.write_properties([1], cols)
    assert L.read_properties(pair + L.write_properties([2], cols), cols) == {0: 2}
    with pytest.raises(L.Malformed):
        L.read_properties(b"\x05\x00" + pair[2:], cols)


def test_geojson_files(spark, tmp_path):
    feats = [
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [i, i]}, "properties": {"name": f"n{i}", "v": i + 0.5}} for i in range(3)
    ] + [{"type": "Feature", "geometry": None, "properties": {"name": None}}]
    (tmp_path / "c.json").write_text(json.dumps({"type": "FeatureCollection", "features": feats}))
    df = geojson.read(spark, str(tmp_path / "c.json"))
    got = df.orderBy("fid").collect()
    assert [r.fid for r in got] == [0, 1, 2, 3] and got[1].v == 1.5 and got[3].geometry is None and got[3].bbox is None
    for lines in (True, False):
        out = str(tmp_path / f"o{lines}")
        geojson.write(df, out, lines)
        back = geojson.read(spark, out, lines=lines)
        assert {(r.name, r.v) for r in back.collect()} == {("n0", 0.5), ("n1", 1.5), ("n2", 2.5), (None, None)}


def test_geojson_properties_of_many_types(spark, tmp_path):
    props = [{"k": 1, "v": 1.5, "o": {"a": [1, 2]}, "w x": None, "VOID": 1}, {"k": "s", "v": 2, "w x": True, "a`b": 1, "VOID": 2}, {}]
    feats = [{"type": "Feature", "geometry": None, "properties": p} for p in props] + [{"type": "Feature", "geometry": None, "properties": None}]
    (tmp_path / "c.json").write_text(json.dumps({"type": "FeatureCollection", "features": feats}))
    df = geojson.read(spark, str(tmp_path / "c.json"))
    got = df.orderBy("fid").collect()
    assert [r.k for r in got] == ["1", "s", None, None] and [r.v for r in got] == [1.5, 2.0, None, None]
    assert got[0].o.a == [1, 2] and got[1]["w x"] is True and got[1]["a`b"] == 1 and got[1]["VOID"] == 2
    assert geojson.read(spark, str(tmp_path / "c.json"), properties="v double").columns == ["fid", "bbox", "geometry", "v"]
    assert geojson.read(spark, str(tmp_path / "c.json"), infer="first_row").orderBy("fid").first().k == 1


def test_stream_takes_new_files_once(spark, tmp_path):
    src, sink, check = (str(tmp_path / n) for n in ("src", "sink", "check"))
    binary.write(grid(spark, 40).coalesce(1), src)
    feeds.run_once(feeds.read_stream(spark, src), sink, check).awaitTermination(60)
    assert spark.read.parquet(sink).count() == 40
    binary.write(grid(spark, 10).coalesce(1), src)
    feeds.run_once(feeds.read_stream(spark, src), sink, check).awaitTermination(60)
    assert spark.read.parquet(sink).count() == 50


def test_windowed_extent(spark, tmp_path):
    src = str(tmp_path / "e")
    data = [("2024-01-01T00:00:01Z", 1.0), ("2024-01-01T00:00:02Z", 5.0), ("2024-01-01T00:01:02Z", 2.0), ("2024-01-01T01:00:00Z", 0.0)]
    spark.createDataFrame(data, "t string, x double").select(feeds.event_time("t").alias("ts"), B.of_point("x", "x").alias("bbox")).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = feeds.windowed_extent(stream, "ts", "1 minute", "0 seconds").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = spark.table("w").orderBy("window").collect()
    assert [(r.n, r.minx, r.maxx) for r in got] == [(2, 1.0, 5.0), (1, 2.0, 2.0), (1, 0.0, 0.0)]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "c.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]},"properties":{"a":1}}]}')
    cli.main(["convert", "--input", str(tmp_path / "c.json"), "--output", str(tmp_path / "o")])
    cli.main(["convert", "--input", str(tmp_path / "o"), "--inputformat", "features", "--output", str(tmp_path / "w"), "--outputformat", "wkt"])
    text = "".join(p.read_text() for p in (tmp_path / "w").iterdir() if p.name.startswith("part"))
    assert text.strip() == "POINT (1 2)"
    cli.main(["info", "--input", str(tmp_path / "o"), "--dump", "0"])
    cli.main(["info", "--input", str(tmp_path / "o")])
    assert "POINT (1 2)" in capsys.readouterr().out
    assert os.path.isdir(tmp_path / "o")


def test_null_lists_survive_the_way_to_a_writer(spark):
    """Every kind of null in a geometry: of itself, its parts, a part's lists; and empty lists beside them."""
    from geotable.functions.dense import dense, restored

    part = lambda **k: {"path": [], "type": 2, "ends": None, "xy": None, "z": None, "m": None, "t": None, "tm": None} | k
    shapes = [
        None, {"type": None, "parts": None}, {"type": 1, "parts": []}, {"type": 2, "parts": [part(xy=[1.0, 2.0, None, 4.0], z=[], ends=[1, 2], tm=[decimal.Decimal(7)])]},
        {"type": 6, "parts": [part(path=[0], xy=[0.0] * 8, m=[1.0]), part(path=None, type=None, t=[2.0])]},
    ]
    df = spark.createDataFrame([(g,) for g in shapes], T.StructType([T.StructField("g", binary.data_type(G.TYPE))])).coalesce(1)
    there = df.select(dense("g").alias("g")).toArrow().combine_chunks().column("g").chunk(0)
    assert restored(there).to_pylist() == df.toArrow().column("g").to_pylist()
    assert restored(there.slice(1, 3)).to_pylist() == df.toArrow().column("g").to_pylist()[1:4]


def test_writing_takes_time_in_proportion_to_a_batch(spark, tmp_path):
    """In one batch of 60,000 rows Spark would walk each null list from its begin before every row."""
    from geotable.functions import wkb as W

    rows = grid(spark, 60_000).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "60000")
    try:
        began = time.time()
        binary.write(rows, str(tmp_path / "a"))
        assert W.with_wkb(rows).agg(F.count("wkb")).first()[0] == 60_000
        assert time.time() - began < 60
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert binary.count_features(spark, str(tmp_path / "a")) == 60_000


def test_promoted_lines_are_encoded_in_batches(spark, tmp_path, monkeypatch):
    part = {"path": [], "type": 2, "ends": None, "xy": [0.0, 1.0, 2.0, 3.0], "z": [5.0, 6.0], "m": None, "t": None, "tm": None}
    ring = part | {"type": 3, "xy": [0.0, 0.0, 1.0, 0.0, 1.0, 1.0, 0.0, 0.0], "z": None}
    schema = T.StructType([T.StructField("geometry", binary.data_type(G.TYPE)), T.StructField("k", T.LongType())])
    df = spark.createDataFrame([({"type": 2, "parts": [part]}, 1), ({"type": 3, "parts": [ring]}, 2), (None, 3), ({"type": 2, "parts": [part]}, 4)], schema)
    one, seen = binary.Writer._one, []
    monkeypatch.setattr(binary.Writer, "_one", lambda self, row, *a: seen.append(row["k"]) or one(self, row, *a))
    writer = binary.Writer({"promote_to_multi": "true"}, schema, str(tmp_path / "a"), False)
    writer.commit([writer.write(iter(df.toArrow().combine_chunks().to_batches()))])
    assert seen == [2]
    back = {r.k: r for r in binary.read(spark, str(tmp_path / "a")).select("k", "geometry.type", G.to_wkt("geometry").alias("t"), "bbox").collect()}
    assert back[1].t == back[4].t == "MULTILINESTRING Z ((0 1 5, 2 3 6))" and back[2].t.startswith("MULTIPOLYGON Z (((0 0") or back[2].t.startswith("MULTIPOLYGON (((0 0")
    assert back[3].t is None and tuple(back[1].bbox) == (0.0, 1.0, 2.0, 3.0)


def test_a_search_takes_few_requests_however_large_the_file(tmp_path, monkeypatch):
    n = 300_000
    x, y = np.arange(n) % 1000 * 0.3 - 150, np.arange(n) // 1000 * 0.3 - 45
    boxes = np.stack([x, y, x + 0.01, y + 0.01], axis=1)
    body = L.write_feature({"type": 1, "parts": [{"path": [], "type": 1, "xy": [1.0, 2.0]}]}, [], [])
    raw = L.MAGIC + L.write_header(L.Header(features_count=n)) + L.build_tree(boxes, np.arange(n) * len(body), 16) + body * n
    (tmp_path / "many.bin").write_bytes(raw)
    rect = (0.0, -200.0, 0.2, 200.0)  # a hit in every row of 1000, far from the next
    for gap in (None, binary.GAP):
        used = binary.usage(str(tmp_path / "many.bin"), rect, gap)
        assert used["open_requests"] == 1 and used["open_bytes"] == 12_944 and used["requests"] <= 10 and 0 <= used["wasted"] <= used["bytes"]
    monkeypatch.setattr(binary, "GAP", 1000)
    assert binary.usage(str(tmp_path / "many.bin"), rect, 1000)["requests"] > 100
    used = binary.usage(str(tmp_path / "many.bin"), rect)
    assert used["requests"] <= 10 and 0 <= used["wasted"] <= used["bytes"]
    wanted = [(r[0], r[2]) for gap in (None, 1000) for p in binary._batches(binary.Opened.of(str(tmp_path / "many.bin")), rect, gap, 1 << 16, 0)[0] for _, _, runs in p.ranges for r in runs]
    assert len(wanted) == 2 * 300 and wanted[:300] == wanted[300:]

    # over HTTP a range that is read in blocks is one request
    asked = []

    class Serve(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            a, b = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
            asked.append((a, b))
            part = raw[a : b + 1]
            self.send_response(206)
            self.send_header("Content-Range", f"bytes {a}-{a + len(part) - 1}/{len(raw)}")
            self.send_header("Content-Length", str(len(part)))
            self.end_headers()
            self.wfile.write(part)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Serve)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setattr(binary, "BLOCK", 1000)
    try:
        opened = binary.Opened.of(f"http://127.0.0.1:{server.server_port}/a.bin")
        asked.clear()
        part = binary.Part(opened, [(opened.data_at, opened.data_at + 500 * len(body), [(opened.data_at, opened.data_at + 500 * len(body), 0)])], 0)
        rows = sum(b.num_rows for b in binary.read_part(part, binary.schema_of(opened.header, None, True), "FAILFAST", None))
        assert rows == 500 and len(asked) == 1
    finally:
        server.shutdown()


@pytest.mark.parametrize("index", ["true", "false"])
def test_a_small_split_makes_a_bounded_number_of_parts(spark, tmp_path, index):
    path = str(tmp_path / "a")
    binary.write(grid(spark, 5000).coalesce(1), path, index=index, count=index)
    schema = binary.schema_of(binary.Opened.of(binary.files_of(path)[0]).header, None, True)
    parts = binary.Reader({"split": "1"}, schema, path).partitions()
    assert 500 < len(parts) <= binary.PARTS + 1
    rows = [r for p in parts for b in binary.read_part(p, schema, "FAILFAST", None) for r in b.select(["fid", "key"]).to_pylist()]
    assert [r["fid"] for r in rows] == list(range(5000)) and {r["key"] for r in rows} == set(range(5000))


def test_a_spool_is_read_once_however_its_order_jumps(tmp_path, monkeypatch):
    import io

    from pyarrow import fs

    monkeypatch.setattr(binary, "SPOOL", 10_000)
    rng, most, total = np.random.default_rng(7), [0], [0]

    class Files:
        """A file system that counts what is read."""

        def __init__(self):
            self.own = fs.LocalFileSystem()

        def __getattr__(self, name):
            return getattr(self.own, name)

        def open_input_file(self, at):
            class Counted:
                def __init__(self, f):
                    self.f = f

                def __enter__(self):
                    return self

                def __exit__(self, *_):
                    self.f.close()

                def seen(self, raw):
                    most[0], total[0] = max(most[0], len(raw)), total[0] + len(raw)
                    return raw

                def read_at(self, n, at):
                    return self.seen(self.f.read_at(n, at))

                def read(self):
                    return self.seen(self.f.read())

            return Counted(self.own.open_input_file(at))

    features = [bytes([i % 256]) * int(k) for i, k in enumerate(rng.integers(1, 200, 5000))]
    spool = binary._Spool(Files(), str(tmp_path / "s" / "x"))
    for k in range(0, 5000, 70):
        spool.add(features[k : k + 70])
    order, out = rng.permutation(5000), io.BytesIO()
    spool.copy(order, out)
    assert out.getvalue() == b"".join(features[i] for i in order)
    size = sum(map(len, features))
    assert size > 40 * binary.SPOOL and total[0] == 2 * size and most[0] < 1.2 * binary.SPOOL
    assert list((tmp_path / "s").iterdir()) == []


def test_collections_are_cut_between_members(spark, tmp_path, monkeypatch):
    import io

    from geotable.sources import collections

    rng = np.random.default_rng(11)
    odd = ["]}", '{"features":[', 'a"b', "\\", '\\"', "\\\\", "é{", "\n"]
    feats = [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [i, -i]}, "properties": {"i": i, "t": "".join(rng.choice(odd, 3)), "features": [{"x": [1]}]}} for i in range(300)]
    whole = {"type": "FeatureCollection", "bbox": [0, 1, 2, 3], "meta": {"features": [{"no": 1}]}, "features": feats, "after": [{"no": 2}]}
    for indent in (None, 1):
        for ascii_ in (True, False):
            raw = json.dumps(whole, indent=indent, ensure_ascii=ascii_).encode()
            for block in (7, 64, 1 << 20):
                monkeypatch.setattr(collections, "BLOCK", block)
                cuts = collections.pieces(io.BytesIO(raw).read, 500)
                assert len(cuts) > 20
                assert [json.loads(m) for a, b in cuts for m in collections.members(raw[a:b])] == feats
    assert collections.pieces(io.BytesIO(raw[:-2]).read, 500) == [] == collections.pieces(io.BytesIO(b" ").read, 5)
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a b%20.json").write_bytes(raw)
    (tmp_path / "c" / "b.json").write_text(json.dumps(feats[0]))
    (tmp_path / "c" / "c.json").write_text('{"type": "Point", "coordinates": [1, 2]}')
    got = geojson.read(spark, str(tmp_path / "c"), "i int, t string").orderBy("fid").collect()
    assert [(r.i, r.t) for r in got] == [(f["properties"]["i"], f["properties"]["t"]) for f in [*feats, feats[0]]] and [r.fid for r in got] == list(range(301))


def test_a_collection_is_written_as_it_comes(spark, tmp_path):
    df = spark.range(0, 2000, 1, 5).select(G.point("id", "id").alias("geometry"), F.col("id").alias("k")).orderBy(F.desc("k"))
    out = str(tmp_path / "o")
    geojson.write(df, out, lines=False)
    files = [p for p in (tmp_path / "o").iterdir() if p.name.startswith("part")]
    text = "".join(p.read_text() for p in files)
    assert len(files) == 1 and [f["properties"]["k"] for f in json.loads(text)["features"]] == list(range(1999, -1, -1))
    assert len(text.splitlines()) == 2002  # no row of all features
    geojson.write(df.limit(0), str(tmp_path / "e"), lines=False)
    assert geojson.read(spark, str(tmp_path / "e"), "k long").count() == 0
