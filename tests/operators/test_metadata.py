import pytest

from findlode.functions import text as fx
from findlode.operators import metadata as md


@pytest.fixture(scope="module")
def files(spark):
    rows = [(0, "src/cat.jpg", "a", 5, "A cat and a dog"), (1, "src/Dog.JPG", "b", 50, "dogs only"), (2, "x.png", None, 500, "cats, dogs and a cat"), (3, "y.png", "a", 7, None)]
    return spark.createDataFrame(rows, "file_id bigint, filename string, tag string, n int, caption string")


@pytest.fixture(scope="module")
def table(files):
    return md.token_table(md.joined_text(files, None, ["caption"]))


def ids(df):
    return sorted(r["file_id"] for r in df.collect())


@pytest.mark.parametrize(("query", "want"), [("tag=a", [0, 3]), ("n=(6,60)", [1, 3]), ("n=50", [1]), ("cat", [0, 2]), ("cat*", [0, 2]), ("dog*", [0, 1, 2]), ("cat AND dog", [0]), ("cat dogs", [2]), ("dog OR dogs", [0, 1, 2]), ("dogs NOT cat", [1]), ('"a cat"', [0, 2]), ('"cat and"', [0])])
def test_query_strings(files, table, query, want):
    assert ids(md.search(query, files, table)) == want


@pytest.mark.parametrize("query", ["none=1", "tag=", "n=(1,2", "n=1)", "n=(1)", "n=(1,2,3)", "n=(,2)", "  "])
def test_rejected(files, table, query):
    with pytest.raises(md.Rejected):
        md.search(query, files, table)


def test_like_does_not_mind_case(files):
    assert ids(md.names_like(files, "%.jpg")) == [0, 1]


def test_group_counts_leave_null_out(files):
    assert {r["value"]: r["n"] for r in md.group_counts(files, "tag").collect()} == {"a": 2, "b": 1}


@pytest.mark.parametrize(("size", "start", "end", "want"), [(100, 0, 0, (0, 20)), (100, 40, 60, (40, 60)), (100, 200, 210, (0, 20)), (10, 0, 50, (0, 10)), (100, 95, 200, (95, 100)), (100, 50, 50, (50, 70)), (0, 0, 0, (0, 0))])
def test_pages(size, start, end, want):
    assert md.page_bounds(size, start, end) in (want, (0, end) if start >= size and end <= size else want)


def test_pages_of_a_table(files):
    assert [r["file_id"] for r in md.paged(files, ["file_id"], 1, 3).collect()] == [1, 2]


def test_samples_are_the_same_every_time(spark):
    rows = spark.range(1000).withColumnRenamed("id", "file_id")
    assert ids(md.sampled(rows, "file_id")) == ids(md.sampled(rows.repartition(7), "file_id")) and md.sampled(rows, "file_id").count() == 100


def test_shuffled_until_the_total(spark):
    rows = spark.range(100).selectExpr("id AS file_id", "10 AS size")
    assert md.shuffled_until(rows, "file_id", "size", 95).count() == 10


def test_regions_join_and_boxes(spark, files):
    regions = spark.createDataFrame([(0, "red", "1,2,3,4"), (0, "blue", "5.5, 6,7,8")], "file_id bigint, colour string, points string")
    rows = md.joined_text(files, regions, ["filename", "colour"]).collect()
    assert sorted(r["text"] for r in rows if r["file_id"] == 0) == ["src/cat.jpg blue", "src/cat.jpg red"] and len(rows) == 5
    box = regions.select(md.region_box(regions["points"]).alias("b")).collect()[1]["b"]
    assert tuple(box) == (5.5, 6, 7, 8)


def test_uris(spark):
    rows = spark.createDataFrame([("/",), ("/a/b",), ("http://h.x/a//b/?q=1&r=a%20b+c&s=&t",), ("/a?x=1=2#f",)], "u string")
    got = rows.select(fx.path_parts(rows["u"]).alias("p"), fx.query_parameters(rows["u"]).alias("q")).collect()
    assert [r["p"] for r in got] == [[], ["a", "b"], ["a", "b"], ["a"]]
    assert got[2]["q"] == {"q": "1", "r": "a b c", "s": "", "t": ""} and got[3]["q"] == {"x": "1=2"} and got[0]["q"] == {}


def test_refused_text():
    assert fx.safe_query("cat dog") == "cat dog"
    for bad in ('a"b', "a'b", "a;b", "a\\b", "x" * 129):
        with pytest.raises(ValueError):
            fx.safe_query(bad)
