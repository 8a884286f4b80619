import hashlib

import pytest

from synthlab.llm import warc as W

BORDER = "\r\n\r\nWARC/1.1\r\n"


def pages():
    long = "x" * 150
    return [(3, "http://a/ b", long), (1, "http://a/1", long), (2, None, long), (7, "u", "short"), (8, "u", "short"),
            (9, "u", None), (10, "u", ""), (None, "u", long), (11, "u", "é日本" * 40), (12, "u", "head\r\n\r\nbody" + "y" * 99),
            (13, "u", f"one{BORDER}WARC-Type: response\r\nContent-Length: 3\r\n\r\nabc{BORDER}" + "z" * 99 + BORDER),
            (14, "u", BORDER), (1, "http://a/1", long), (15, "u", "big " * 200_000), (16, "u", "WARC/1.1\r\n" * 20)]


def brute(rows):
    out = []
    for k, _, t in rows:
        data = (t or "").encode()
        group = [r[0] for r in rows if (r[2] or "").encode() == data and r[0] is not None]
        again = len(data) >= 100 and sum((r[2] or "").encode() == data for r in rows) > 1 and group and k != min(group)
        out.append((k, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", min(group) if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "x") for r in pages()], "page_id long, url string, html string, digest string")
    got = sorted((tuple(r) for r in W.page_records(df).collect()), key=str)
    assert got == brute(pages())
    back = W.read_warc(spark, W.archive_pages(df)).collect()
    bodies = {r["key"]: bytes(r["payload"]).decode() for r in back if r["record_type"] == "response" and r["key"]}
    assert all(bodies[str(k)] == (t or "") for k, _, t in pages() if str(k) in bodies) and "13" in bodies
    assert {r["date"] for r in back} == {"2020-01-01T00:00:00Z"}
    ids = {r["key"]: r["record_id"] for r in back}
    assert all(W.record_id(r["referred"]) == ids[r["referred"]] for r in back if r["referred"])
    assert W.page_records(df.limit(0)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    captures = [W.Capture(f"http://h/{i}", W.CAPTURED, "text/html", W.http_head(len(p), str(i)), p, str(i))
                for i, p in enumerate([b"", b"a\n\nb", b"http://x 1.2.3.4 2020 text/html 5\nabcde", b"\n" * 7])]
    data = W.arc_version_block("t.arc", version) + b"".join(W.arc_record(c, version, "t.arc", 0) for c in captures)
    assert list(W.parse_arc(data)) == captures
    with pytest.raises(ValueError):
        list(W.parse_arc(data[:-1]))
    with pytest.raises(ValueError):
        list(W.parse_arc(W.arc_record(captures[0], version, "t", 0)))
    wrong = W.arc_version_block("t.arc", version) + W.arc_record(captures[0], 3 - version, "t", 0)
    with pytest.raises(ValueError):
        list(W.parse_arc(wrong))


def test_damaged_records_are_noticed():
    c = W.Capture("u", W.CAPTURED, "text/html", W.http_head(3, "1"), b"abc", "1")
    good = W.convert(c, hashlib.sha256(b"abc").hexdigest(), None)
    assert [r[0] for r in W.parse_warc(iter([good[:-4]]))] == ["response"]
    with pytest.raises(ValueError):
        list(W.parse_warc(iter([good.replace(b"abc", b"abd")])))
    with pytest.raises(ValueError):
        list(W.parse_warc(iter([good[:-6]])))
