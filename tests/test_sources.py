import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from findlode.engine import Engine
from findlode.operators import index, vectors
from findlode.sources import features, images, tables, truth
from findlode.streaming import feeds


def png(w, h):
    head = b"IHDR" + struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + head + struct.pack(">I", zlib.crc32(head))


def jpeg(w, h):
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", h, w) + b"\x01\x01\x11\x00"


def tiff(w, h):
    entries = struct.pack("<HHII", 256, 3, 1, w) + struct.pack("<HHII", 257, 4, 1, h)
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + entries


def test_images(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in {"a.png": png(100, 50), "in/b.JPG": jpeg(640, 480), "c.tif": tiff(9, 8), "d.jpg": b"no", "e.txt": b"x", "f.Png": png(1, 1)}.items():
        (tmp_path / name).write_bytes(data)
    new, other = images.additions(images.listed(spark, str(tmp_path)), spark.createDataFrame([(f"file:{tmp_path}/c.tif",)], "path string"))
    assert new.count() == 3 and sorted(r["reason"] for r in other.collect()) == ["exists", "not an image", "not an image"]
    docs, rejected = images.preprocessed(images.sized(spark, str(tmp_path)), "320x320")
    got = {r["filename"].rsplit("/", 1)[1]: (r["doc_id"], r["width"], r["height"], r["new_width"], r["new_height"]) for r in docs.collect()}
    assert got == {"a.png": (0, 100, 50, 100, 50), "c.tif": (1, 9, 8, 9, 8), "b.JPG": (2, 640, 480, 320, 240)}
    assert [r["path"].rsplit("/", 1)[1] for r in rejected.collect()] == ["d.jpg"]


def test_feature_files(spark, tmp_path):
    (tmp_path / "x.feat").write_text("3 2\n1 2 0 0.1 0 0.2 7 8 9\n3 4 0 0.3 0 0.4 1 2 3\n")
    rows = features.from_files(spark, str(tmp_path), "*.feat", features.read_text).orderBy("feat_id").collect()
    assert [r["vec"] for r in rows] == [[7, 8, 9], [1, 2, 3]] and (rows[1]["x"], rows[1]["c"]) == (3, 0.4)
    regions = np.array([[1, 2, 0.5, 0.25, 3]])
    assert np.allclose(features.read_regions(features.write_regions(regions))[0], regions)
    flat = np.arange(12, dtype=np.float32).reshape(3, 4)
    assert (features.read_flat(features.write_flat(flat)) == flat).all() and features.read_flat(features.write_flat(flat), 2).shape == (3, 2)
    fvecs = b"".join(struct.pack("<i2f", 2, *r) for r in ([1, 2], [3, 4]))
    assert features.read_fvecs(fvecs).tolist() == [[1, 2], [3, 4]]
    geo = struct.pack("<9fi", 10, 20, 2, 0, 1, 0, 0, 1, 0, 128) + bytes(range(128))
    shapes, vectors = features.read_siftgeo(geo * 2)
    assert np.allclose(shapes[0], [10, 20, 0.25, 0, 0.25]) and vectors[1].tolist() == list(range(128))


def test_ground_truth(spark, tmp_path):
    folder = tmp_path / "gt"
    folder.mkdir()
    for name, text in {"b_1_query.txt": "oxc1_img7 1 2 3.5 4", "b_1_good.txt": "img8\nimg9\n", "b_1_ok.txt": "", "b_1_junk.txt": "img1", "a_2_query.txt": "img3 0 0 1 1", "a_2_good.txt": "img4"}.items():
        (folder / name).write_text(text)
    queries, rows = truth.buildings(spark, str(folder))
    assert [(r["query_id"], r["query_name"], r["filename"], r["yu"]) for r in queries.orderBy("query_id").collect()] == [(0, "a_2", "img3.jpg", 1), (1, "b_1", "img7.jpg", 4)]
    assert sorted((r["query_id"], r["filename"], r["kind"]) for r in rows.collect()) == [(0, "img4.jpg", "pos"), (1, "img1.jpg", "ign"), (1, "img8.jpg", "pos"), (1, "img9.jpg", "pos")]
    (tmp_path / "h.txt").write_text("100000.jpg\n100001.jpg\n100002.jpg\n100100.jpg\n100101.jpg\n")
    queries, rows = truth.holidays(spark, str(tmp_path / "h.txt"))
    assert queries.count() == 2 and sorted(r["kind"] for r in rows.collect()) == ["ign", "ign", "pos", "pos", "pos"]
    (tmp_path / "s.txt").write_text("0 55 x7\n1 66\n")
    docs = spark.createDataFrame([(3, "q/PCI_sp_1_2_3_4_5_55_7_8.jpg"), (4, "PCI_sp_1_2_3_4_5_66_7_8.jpg")], "doc_id bigint, filename string")
    assert sorted(tuple(r) for r in truth.landmarks(spark, str(tmp_path / "s.txt"), docs).collect()) == [(0, 3, "pos"), (1, 4, "pos")]
    assert truth.panoramas(["0 2", "1 3"], per=2)[:3] == [(0, 2, "pos"), (0, 3, "pos"), (0, 6, "pos")]


def test_lists_and_configurations(spark, tmp_path):
    (tmp_path / "list.txt").write_text("a.jpg\n\nb.jpg\n")
    assert [tuple(r) for r in tables.file_list(spark, str(tmp_path / "list.txt")).collect()] == [(0, "a.jpg"), (1, "b.jpg")]
    values = tables.configuration("# note\na=1\nbroken\nb=x=y\na=2\n")
    assert values == {"a": "2", "b": "x=y"} and tables.configuration(tables.configuration_text(values)) == values
    rows = spark.createDataFrame([(0, 2, "a,b"), (1, 7, "c")], "set_id bigint, set_size bigint, set_files string")
    tables.exported_csv(rows, str(tmp_path / "csv"))
    tables.exported_json(rows, str(tmp_path / "json"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 2
    assert sorted(p.name for p in (tmp_path / "json").glob("bucket=*")) == ["bucket=2", "bucket=5"]
    assert tables.point(rows, "set_id", 1).first()["json"] == '{"set_id":1,"set_size":7,"set_files":"c"}'


def test_an_index_from_features_finds_what_was_moved(spark, tmp_path):
    """Images of random features; image 1 is image 0 moved, the others are unlike."""
    rng = np.random.default_rng(5)
    rows, number = [], 0
    centres = rng.standard_normal((8, 16)) * 3
    base = [(rng.uniform(0, 300), rng.uniform(0, 300), centres[k % 8] + rng.standard_normal(16)) for k in range(40)]
    for doc in range(6):
        for k in range(40):
            x, y, v = base[k] if doc < 2 else (rng.uniform(0, 300), rng.uniform(0, 300), centres[k % 2] + rng.standard_normal(16))
            rows.append((doc, number, x + 25.0 * (doc == 1), y - 10.0 * (doc == 1), 0.01, 0.0, 0.01, [float(a) for a in v]))
            number += 1
    table = spark.createDataFrame(rows, "doc_id bigint, feat_id bigint, x double, y double, a double, b double, c double, vec array<double>")
    words = spark.createDataFrame([(k, [float(a) for a in v]) for k, v in enumerate(centres)], "word bigint, vec array<double>")
    files = spark.createDataFrame([(d, f"img{d}.jpg") for d in range(6)], "file_id bigint, filename string")
    engine = Engine(spark, f"file://{tmp_path}/index", bits=16)
    assert engine.state() == "set_config"
    engine.build(table, words, files)
    engine.build(table, words, files)  # nothing is missing, nothing is done again
    assert engine.state() == "search_ready"
    box = spark.createDataFrame([(0, 0, None, None, None, None)], "query_id bigint, doc_id bigint, xl double, xu double, yl double, yu double")
    plain = engine.search(box, 6, spatial=False).orderBy("rank").collect()
    assert [r["doc_id"] for r in plain][:2] == [0, 1] and plain[0]["filename"] == "img0.jpg"
    found = {r["doc_id"]: r for r in engine.search(box).collect()}
    assert {0, 1} <= set(found) and found[1]["inliers"] >= 25
    assert abs(found[1]["h"][2] - 25) < 3 and abs(found[1]["h"][5] + 10) < 3
    match = engine.show_match(box, 1).first()
    assert len(match["pairs"]) == match["inliers"] >= 25
    outside = table.filter("doc_id = 0").select(table["doc_id"].alias("query_id"), table["feat_id"].alias("q_feat"), *"xyabc", "vec")
    again = engine.search_features(engine.represented(outside, 1), 6, spatial=False).collect()
    assert {r["doc_id"]: round(r["score"], 6) for r in again} == {r["doc_id"]: round(r["score"], 6) for r in plain}
    assert [r["file_id"] for r in engine.filelist(start=2, end=4).collect()] == [2, 3]
    # The first run knows fewer files; the second asks those that are new and nothing else.
    engine.visual_groups(files.filter("file_id >= 2").select("file_id"), 5, 1.0, batch=2)
    groups = engine.visual_groups(files.select("file_id"), 5, 1.0, batch=4)
    assert any({0, 1} <= set(r["members"]) for r in groups.collect())
    done = spark.read.parquet(f"file://{tmp_path}/index/vgroup_files").filter("doc_id is null")
    assert sorted(r["query_id"] for r in done.collect()) == [0, 1, 2, 3, 4, 5]
    assert not {0, 1} & {r["query_id"] for r in engine.unmatched(files.select("file_id"), 5, 1.0).collect()}
    assert engine.sets_page(groups).count() == groups.count() and engine.sets_with(groups, 1).count() == 1
    regions = spark.createDataFrame([(7, 0, 0.0, 0.0, 300.0, 300.0)], "region_id bigint, file_id bigint, x double, y double, w double, h double")
    sets, every = engine.visual_region_groups(regions, 5, 1.0)
    moved = every.filter("region_id != 7 and file_id = 1").first()
    assert abs(moved["x"] - 25) < 4 and abs(moved["y"] + 10) < 4
    assert any({7, moved["region_id"]} <= set(r["members"]) for r in sets.collect())
    one = engine.register(table.filter("doc_id = 0"), table.filter("doc_id = 1"), (0.0, 300.0, 0.0, 300.0)).first()
    assert one["inliers"] == 40 and abs(one["h"][2] - 25) < 1 and abs(one["h"][5] + 10) < 1


def test_a_signature_takes_no_more_than_64_dimensions(spark):
    rows = spark.createDataFrame([([1.0] * 65, [0.0] * 65)], "v array<double>, m array<double>")
    with pytest.raises(Exception, match="64 bits"):
        rows.select(vectors.signature(F.col("v"), F.col("m"))).collect()


def test_nearest_rows_in_blocks_are_those_of_a_plain_search(spark):
    rng = np.random.default_rng(9)
    data = rng.standard_normal((300, 8))
    data[200:220] = data[0]
    rows = spark.createDataFrame([(i, i % 3, [float(x) for x in v]) for i, v in enumerate(data)], "feat_id bigint, word bigint, vec array<double>").repartition(5)
    some = rows.filter("feat_id % 10 = 0")
    for apart in (False, True):
        got = {}
        for r in vectors.nearest_rows(some, rows, 3, apart, block=7).collect():
            got.setdefault(r["a"], []).append((r["place"], r["b"]))
        for a in range(0, 300, 10):
            d2 = ((data - data[a]) ** 2).sum(axis=1)
            order = [b for b in np.lexsort((np.arange(300), np.round(d2, 9))).tolist() if not apart or b % 3 != a % 3][:3]
            assert [b for _, b in sorted(got[a])] == order
    close = {(r["a"], r["b"]) for r in vectors.close_pairs(rows, some, 1.5, block=7).collect()}
    assert close == {(a, b) for b in range(0, 300, 10) for a in range(300) if ((data[a] - data[b]) ** 2).sum() < 2.25}


def test_streamed_queries_are_answered_as_in_a_batch(spark, tmp_path):
    docs = spark.createDataFrame([(0, "red fish"), (1, "blue fish"), (2, "green bird")], "doc_id bigint, text string")
    tf = index.term_counts(index.text_postings(docs)).cache()
    idf = index.idf(tf, docs).cache()
    norms = index.tfidf_norms(tf, idf).cache()
    spark.createDataFrame([(7, "blue fish"), (8, "bird")], "query_id bigint, text string").write.json(str(tmp_path / "q"))
    arriving = spark.readStream.schema("query_id bigint, text string").json(str(tmp_path / "q"))
    sink = lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
    feeds.answered(arriving, tf, idf, norms, 1, sink, str(tmp_path / "ck")).awaitTermination()
    assert sorted((r["query_id"], r["doc_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(7, 1), (8, 2)]
    [t.unpersist() for t in (tf, idf, norms)]


def test_streamed_activity_is_that_of_a_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = feeds.activity(stream).writeStream.outputMode("complete").format("memory").queryName("activity").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda r: (r["start"], r["event_type"], r["n"], r["users"])
    assert sorted(map(key, spark.table("activity").collect())) == sorted(map(key, feeds.activity(events).collect()))
