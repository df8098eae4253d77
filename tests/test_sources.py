"""Literal cases of the landed sources."""

from __future__ import annotations

import io
import zipfile

import pandas as pd

from noticelake.sources import landed
from noticelake.sources import landed as L


def archive(**members: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


def test_archives(spark):
    inner = archive(**{"b.txt": b"two"})
    rows = [("good", archive(**{"a.txt": b"one", "n.zip": inner})), ("unsafe", archive(**{"../x": b"1", "/y": b"2"})), ("bad", b"PK\x03\x04nope"), ("bomb", archive(**{"z": b"0" * 3_000_000})), ("many", archive(**{f"m{k}": b"" for k in range(5)}))]
    out = {(r.path, r.member): (bytes(r.content) if r.content is not None else None, r.reject_reason) for r in L.expand_archives(spark.createDataFrame(rows, "path string, content binary"), members=4).collect()}
    assert out[("good", "good!/a.txt")] == (b"one", None) and out[("good!/n.zip", "good!/n.zip!/b.txt")] == (b"two", None)
    assert out[("unsafe", "unsafe!/../x")][1] == "unsafe_member" and out[("unsafe", "unsafe!//y")][1] == "unsafe_member"
    assert out[("bad", "bad")][1] == "bad_archive" and out[("bomb", "bomb!/z")][1] == "suspicious_ratio" and out[("many", "many")][1] == "archive_too_large"


def test_scan_documents(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "b.dat").write_bytes(archive(x=b"1"))
    (tmp_path / "c.TXT").write_bytes(b"plain")
    assert {r.path.rsplit("/", 1)[1]: r.kind for r in L.scan_documents(spark, str(tmp_path)).collect()} == {"a.pdf": "pdf", "b.dat": "zip", "c.TXT": "txt"}


def test_parser_mismatch_and_feed_limit(spark):
    page = spark.createDataFrame([(1, "https://a.org/x", "<li><h5>no link</h5></li>"), (2, "https://a.org/x", '<li><a href="/n/7/list">T &amp; U</a></li>')], "page_id int, url string, html string")
    got = {r.page_id: r for r in L.read_html_listings(page, L.Listing("<li>.*?</li>", 'href="(/n/([0-9]+)/list)"', "<a [^>]*>([^<]*)<")).collect()}
    assert got[1].error_code == "parser_mismatch" and (got[2].external_id, got[2].link, got[2].title) == ("7", "https://a.org/n/7/list", "T & U")
    feed = spark.createDataFrame([(1, "<rss>" + "".join(f"<item><link>https://a.org/{k}</link><title><![CDATA[t{k}]]></title></item>" for k in range(5)) + "</rss>")], "feed_id int, xml string")
    assert L.read_feed_listings(feed, max_items=3).count() == 3 and L.read_feed_listings(feed, max_items=0).count() == 5
    assert L.read_feed_listings(feed).first().external_id == "https://a.org/0"


def test_small_members_share_frames(spark, monkeypatch):
    """300 members of 100 archives: no frame of its own for each, and all of them whatever a frame may hold."""

    def numbered(k: int) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in range(3):
                z.writestr(f"m{n}", f"{k} {n}" * 10)
        return out.getvalue()

    class Frames:
        def select(self, *_):
            return self

        def mapInPandas(self, run, _):  # noqa: N802
            return list(run(iter([pd.DataFrame({"path": [f"a{k}" for k in range(100)], "content": [numbered(k) for k in range(100)]})])))

    want = {f"a{k}!/m{n}": (f"{k} {n}" * 10).encode() for k in range(100) for n in range(3)}
    for held, most in ((landed.HELD, 1), (1, 300), (1000, 60)):
        monkeypatch.setattr(landed, "HELD", held)
        frames = landed.expand_archives(Frames())
        assert {m: c for f in frames for m, c in zip(f["member"], f["content"])} == want and len(frames) <= most


def test_a_detail_payload_is_parsed_once(spark):
    paths = L.Details(["$.a", "$.b"], ["$.c"], "$.refs", "$.hints", "$.text", "$.files", "$.href", "$.label", "$.type", "$.bytes")
    out = L.read_json_details(spark.createDataFrame([(1, "https://x.org", '{"b": "t", "refs": "R1"}'), (2, "https://x.org", "no json")], "payload_id long, url string, json string"), paths)
    assert [(r.entity, r.references) for r in out.orderBy("payload_id").collect()] == [("t", ["R1"]), (None, [])]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("parseJson") <= 1
