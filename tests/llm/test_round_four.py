"""The archives are read back through their index: by lookup in the directory and by byte range."""

from riskloom.llm import warc


def _pages(spark, n=1500):
    return spark.range(n).selectExpr(
        "id AS page_id", "CASE WHEN id % 50 = 0 THEN NULL WHEN id % 7 = 0 THEN 'http://same.example/' WHEN id % 11 = 0 THEN concat('http://b.example/\r\n', id) "
        "ELSE concat('http://a', id % 13, '.example/', id) END AS url", "repeat(concat('<p>é', id % 900, '</p>'), 1 + cast(id % 40 AS int)) AS html")


def test_round_trip_is_looked_up_and_fetched(spark, monkeypatch):
    """Every row comes from a lookup and a fetch; nothing is taken from the pass that builds the index."""
    calls = []
    for name in ("locate", "fetch"):
        monkeypatch.setattr(warc, name, lambda *a, _f=getattr(warc, name), _n=name, **k: calls.append(_n) or _f(*a, **k))
    got = warc.round_trip(_pages(spark)).collect()
    assert calls == ["locate", "fetch"]
    assert sorted(r.page_id for r in got) == list(range(1500))
    assert {r.page_id for r in got if r.record_type == "revisit"} == {i for i in range(1500) if any(
        j % 900 == i % 900 and j % 40 == i % 40 for j in range(i % 900, i, 900))}


def test_fetch_reads_what_read_gives(spark):
    archive = warc.write(_pages(spark).repartition(3))
    whole = warc.read(archive)
    index = warc.build_index(whole)
    some = _pages(spark).where("page_id % 3 = 1").select("url")
    keys = {warc.url_key((r.url or "").replace("\r", "").replace("\n", "")) for r in some.collect()}
    found = warc.locate(index, some)
    want = {r.id: r for r in whole.collect() if warc.url_key(r.url) in keys}
    got = {r.id: r for r in warc.fetch(archive, found).collect()}
    assert got.keys() == want.keys() and 0 < len(got) < 1500
    same = ("url", "type", "payload_bytes", "payload_digest", "refers_to", "file", "offset", "length")
    assert all(got[i][c] == want[i][c] for i in want for c in same)
    pages = {str(r.page_id): r.html for r in _pages(spark).collect()}
    assert all(r.payload == (pages[i] if r.type == "response" else "") for i, r in got.items())
