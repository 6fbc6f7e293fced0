"""The paged JSON data source over local pages, as a table and as a stream."""

import json

import pytest

from marginalia.sources.paged import PagedJson


@pytest.fixture()
def listings(tmp_path):
    """Three listings: full pages and a short one; two pages without links; a broken page."""
    def put(name, *pages):
        for k, page in enumerate(pages, 1):
            (tmp_path / f"{name}-{k}.json").write_text(page if isinstance(page, str) else json.dumps(page))
        return f"file://{tmp_path}/{name}-{{page}}.json"

    entry = lambda k: {"link": f"http://s.org/{k}", "id": k}
    a = put("a", [entry(1), entry(2)], [entry(3), entry(3)], [entry(4)], [entry(5), entry(6)])  # the third page isn't full: the fourth isn't read
    b = put("b", [entry(10), entry(11)], [{"link": 5}, {}], [{"x": 1}, "text"], [entry(12), entry(13)])  # two pages without a link
    c = put("c", [entry(20), entry(21)], "{broken", [entry(22), entry(23)])
    return tmp_path, put, [a, b, c]


def load(spark, urls, **options):
    spark.dataSource.register(PagedJson)
    return spark.read.format("paged_json").options(listings="\n".join(urls), full=2, **options).load()


def test_pages_of_listings(spark, listings):
    _, _, urls = listings
    df = load(spark, urls)
    assert df.rdd.getNumPartitions() == 3
    found = sorted((urls.index(r["listing"]), r["page"], r["position"], r["link"][13:]) for r in df.collect())
    assert found == [(0, 1, 0, "1"), (0, 1, 1, "2"), (0, 2, 0, "3"), (0, 3, 0, "4"), (1, 1, 0, "10"), (1, 1, 1, "11"), (2, 1, 0, "20"), (2, 1, 1, "21")]
    assert {json.loads(r["entry"])["id"] for r in df.where("page = 1").collect()} == {1, 2, 10, 11, 20, 21}
    assert load(spark, urls[:1], pages=1).count() == 2 and load(spark, ["file:///nowhere/{page}.json"]).count() == 0
    with pytest.raises(Exception, match="listings"):
        load(spark, []).count()


def test_stream_of_new_pages(spark, listings, tmp_path):
    folder, put, _ = listings
    url = put("s", [{"link": "http://s.org/1"}, {"link": "http://s.org/2"}], [{"link": "http://s.org/3"}])
    spark.dataSource.register(PagedJson)

    def run():
        stream = spark.readStream.format("paged_json").options(listings=url, full=2).load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
        q.processAllAvailable()
        q.stop()
        return sorted(r["link"][-1] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == ["1", "2"]  # the second page isn't full yet
    (folder / "s-2.json").write_text(json.dumps([{"link": "http://s.org/3"}, {"link": "http://s.org/4"}]))
    assert run() == ["1", "2", "3", "4"]  # goes on from its offset, each page once
