import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from tessera.sources import dicomweb

ASKED = []


def item(n):
    value = {"0020000E": f"1.{n % 2}", "00080018": f"2.{n}", "00080016": "slide", "00080060": "SM", "00280008": "3", "00280010": 4, "00280011": 4}
    return {k: {"Value": [v]} for k, v in value.items()}


class Server(BaseHTTPRequestHandler):
    def log_message(self, *a):
        pass

    def do_GET(self):  # noqa: N802
        url = urlparse(self.path)
        query, parts = parse_qs(url.query), url.path.strip("/").split("/")
        kind = "application/dicom+json"
        if "Modality" in query:  # this server doesn't know the filter
            ASKED.append("rejected")
            self.send_error(400)
            return
        if "SOPClassUID" in query or "includefield" in query and parts[0] == "strict":  # this one says what it doesn't know
            name = "SOPClassUID" if "SOPClassUID" in query else query["includefield"][0]
            ASKED.append(f"no {name}")
            body = f"unknown attribute: {name}".encode()
            self.send_response(400)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)
            return
        if parts[-1] == "instances":
            ASKED.append(url.query)
            body = json.dumps([i for i in map(item, range(4)) if query.get("SeriesInstanceUID", [i["0020000E"]["Value"][0]]) == i["0020000E"]["Value"]]).encode()
        elif parts[-1] == "metadata":
            body = json.dumps([item(int(parts[-2].split(".")[1]))]).encode()
        else:
            kind = 'multipart/related; boundary="xx"'
            body = b"".join(b"--xx\r\nContent-Type: application/octet-stream\r\n\r\n" + f"{parts[-3]}:{n}".encode() + b"\r\n" for n in parts[-1].split(",")) + b"--xx--"
        self.send_response(200)
        self.send_header("Content-Type", kind)
        self.end_headers()
        self.wfile.write(body)


@pytest.fixture(scope="module")
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_headers_and_pushed_filter(spark, url):
    dicomweb.register(spark)
    rows = spark.read.format("dicomweb").option("url", url).option("study", "9").load()
    assert {r.sop_instance_uid for r in rows.collect()} == {"2.0", "2.1", "2.2", "2.3"}
    ASKED.clear()
    got = rows.where("series_uid = '1.1' and tile_rows > 1").collect()
    assert {r.sop_instance_uid for r in got} == {"2.1", "2.3"} and got[0].n_frames == 3
    assert any("SeriesInstanceUID=1.1" in a for a in ASKED)


def test_rejected_filter_is_applied_locally(url):
    ASKED.clear()
    assert len(dicomweb.search(url, "9", {"series_uid": "1.0", "modality": "SM"})) == 2
    assert dicomweb.search(url, "9", {"modality": "CT"}) == []
    assert "rejected" in ASKED


def test_frames(spark, url):
    dicomweb.register(spark)
    rows = spark.read.format("dicomwebframes").option("url", url).option("study", "9").option("batch", 2).load().collect()
    assert {(r.sop_instance_uid, r.frame_index, bytes(r.data)) for r in rows} == {(f"2.{n}", i, f"2.{n}:{i + 1}".encode()) for n in range(4) for i in range(3)}


def test_negotiation():
    assert dicomweb.negotiate(["a", "b"], ["b", "c"], None) == "b"
    assert dicomweb.negotiate(["a"], ["b"], None) is None
    assert dicomweb.negotiate(["a", "b"], None, lambda s: s == "b") == "b"


def test_the_rejected_filter_or_field_goes(url):
    """Only what the server names is dropped; the other filters are sent again, and the dropped one is applied here."""
    ASKED.clear()
    found = dicomweb.search(f"{url}/strict", "9", {"series_uid": "1.1", "sop_class": "slide"})
    assert [i["00080018"]["Value"][0] for i in found] == ["2.1", "2.3"]
    assert ASKED[:2] == ["no SOPClassUID", "no AvailableTransferSyntaxUID"] and ASKED[-1] == "SeriesInstanceUID=1.1"
    assert dicomweb.search(f"{url}/strict", "9", {"series_uid": "1.1", "sop_class": "other"}) == []
    ASKED.clear()
    assert len(dicomweb.search(url, "9", {"modality": "SM", "series_uid": "1.0"})) == 2  # it doesn't say which one
    assert ASKED[0] == "rejected" and any("SeriesInstanceUID=1.0" in a for a in ASKED)


def test_connections_are_kept_and_partitions_shared(monkeypatch):
    """src07, src09, src11: a partition has many instances and asks for them over one connection."""
    opened = []

    class Keeping(Server):
        protocol_version = "HTTP/1.1"

        def setup(self):
            opened.append(1)
            super().setup()

        def do_GET(self):  # noqa: N802
            many = self.path.endswith("instances") or "instances?" in self.path
            body = json.dumps([item(n) for n in range(300)] if many else [item(int(self.path.split("/")[-2].split(".")[1]))]).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

    server = ThreadingHTTPServer(("127.0.0.1", 0), Keeping)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    reader = dicomweb._Headers({"url": f"http://127.0.0.1:{server.server_port}", "study": "9"})
    parts = reader.partitions()
    assert len(parts) == 64 and [r[2] for p in parts for r in reader.read(p)] == [f"2.{n}" for n in range(300)]
    assert len(opened) == 1 + len(parts)
    server.shutdown()
