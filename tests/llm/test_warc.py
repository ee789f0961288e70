import base64
import hashlib
import random

from pulso.llm import warc as A

SCHEMA = "page_id long, url string, html string, record_id string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def rows_of(spark, pages):
    return spark.createDataFrame([(*p, "x") for p in pages], SCHEMA)


def test_round_trip_of_awkward_payloads(spark):
    nasty = ["", None, "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nb", "\r\n\r\n", "\n\n", "x\r\n\r", "\r",
             "filedesc://x 0.0.0.0 20240101000000 text/plain 3\n1 0", "http://u 0.0.0.0 20240101000000 text/html 4\nabcd",
             "é漢\u2028 \x00 \x85", "HTTP/1.1 200 OK\r\n\r\nx", "y" * 300_000, "dup", "dup", "dup"]
    pages = [(i + 10, f"http://h/{i} b" if i % 4 else None, t) for i, t in enumerate(nasty)]
    pages += [(None, "http://n", "dup"), (3, "http://t", "dup")]
    for parts in (1, 3):
        got = A.round_trip(rows_of(spark, pages).repartition(parts)).collect()
        assert len(got) == len(pages) and all(r.verified for r in got)
        least = {}
        for i, _, t in pages:
            if i is not None:
                least[digest(t)] = min(i, least.get(digest(t), i))
        want = sorted((-1 if i is None else i, len((t or "").encode()), digest(t),
                       "revisit" if i is not None and least[digest(t)] != i else "response",
                       least[digest(t)] if i is not None and least[digest(t)] != i else -1) for i, _, t in pages)
        assert sorted((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type,
                       -1 if r.refers_to is None else r.refers_to) for r in got) == want
        texts = {r.page_id: bytes(r.payload).decode() for r in got if r.record_type == "response" and r.page_id}
        assert all(texts[i] == (t or "") for i, _, t in pages if i in texts and i is not None)


def test_small_payloads_are_never_revisits(spark):
    got = A.round_trip(rows_of(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]), 3).collect()
    assert sorted((r.page_id, r.record_type) for r in got) == [
        (1, "response"), (2, "response"), (3, "response"), (4, "revisit")]


def test_empty_table(spark):
    assert A.round_trip(rows_of(spark, []).where("false")).collect() == []


def test_arc_versions_dates_and_broken_lines():
    one = b"filedesc://a.arc 0.0.0.0 199701010000 text/plain 20\n1 0 x\nURL IP-addr..\n"
    two = b"filedesc://b.arc 0.0.0.0 20000101000000 text/plain 10\n2 0 x\nURL\n"
    stream = (one + b"\nhttp://a 1.2.3.4 19970102030405 text/html 5\nhello\nnot a header line\n"
              + two + b"\nhttp://b 1.2.3.4 20000102030405 text/html 200 - - 0 b.arc 3\nabc\n"
              + b"http://c 1.2.3.4 20000102030405 text/html 200 - - 0 b.arc 99\ncut off")
    rnd = random.Random(1)
    for _ in range(50):                             # cut anywhere
        cuts = sorted(rnd.randrange(len(stream)) for _ in range(6))
        chunks = [stream[a:b] for a, b in zip([0, *cuts], [*cuts, len(stream)])]
        got = [(v, h["url"], b) for v, h, b in A.arc_records(iter(chunks)) if not h["url"].startswith("filedesc")]
        assert got == [(1, "http://a", b"hello"), (2, "http://b", b"abc")]
    assert A.iso_date("199701020304") == "1997-01-02T03:04:00Z"
    assert A.iso_date("19970102030405") == "1997-01-02T03:04:05Z"
    assert A.iso_date("19970102030405678") == "1997-01-02T03:04:05.678Z"
    assert A.iso_date("junk") == "1970-01-01T00:00:00Z"


def test_warc_stream_in_pieces():
    stream = A._record([("WARC-Type", "response")], b"one\r\n\r\nWARC/1.1") + b"\r\n\r\n" + A._record(
        [("WARC-Type", "revisit")], b"") + b"\r\n\r\n"
    for n in (1, 2, 7, len(stream)):
        got = [(h["warc-type"], b) for h, b in A.warc_records(stream[i:i + n] for i in range(0, len(stream), n))]
        assert got == [("response", b"one\r\n\r\nWARC/1.1"), ("revisit", b"")]


def test_written_files_are_warc(spark):
    from pulso.session import scratch_path
    path, out = scratch_path(spark, "arc-test"), scratch_path(spark, "warc-test")
    A.write_arc(rows_of(spark, [(1, "http://a b", "<p>x</p>"), (2, "http://c", "<p>x</p>")]).coalesce(1), path)
    A.write_warc(A.read_arc(spark, path), out)
    text = "".join(r.value for r in spark.read.text(out, lineSep="\n").collect())
    for said in ("WARC-Type: warcinfo", "WARC-Type: response", "WARC-Type: revisit", "WARC-Target-URI: http://a%20b",
                 "WARC-Profile: ", "WARC-Refers-To: <urn:uuid:", "WARC-Date: 2024-01-01T00:00:00Z"):
        assert said in text
