"""Queries over a DICOMweb server: a small one in this process, which serves a table of the driver."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import functions as F

from tessera.plans.fixtures import fx
from tessera.plans.registry import query
from tessera.sources import dicomweb

_SERVERS: dict[str, ThreadingHTTPServer] = {}


def _item(k: int) -> dict:
    values = {"0020000E": f"1.{k % 7}", "00080018": f"2.{k}", "00080016": "slide" if k % 5 else "label", "00080060": "SM", "00280008": str(1 + k % 4), "00280010": 4, "00280011": 4, "00083002": ["1.2.840.10008.1.2.1"]}
    return {t: {"Value": v if isinstance(v, list) else [v]} for t, v in values.items()}


def _handler(keys: list[int]) -> type:
    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"  # connections are kept
        wbufsize = -1  # an answer's head and body go out together
        disable_nagle_algorithm = True

        def log_message(self, *args) -> None:
            pass

        def do_GET(self) -> None:  # noqa: N802
            url = urlparse(self.path)
            asked, parts = parse_qs(url.query), url.path.strip("/").split("/")
            kind, status = "application/dicom+json", 200
            unknown = [n for n in ("SOPClassUID", "AvailableTransferSyntaxUID") if n in asked or n in asked.get("includefield", [])]
            if unknown:  # like servers that know neither
                status, body = 400, f"unsupported attribute: {unknown[0]}".encode()
            elif parts[-1] == "instances":
                series = asked.get("SeriesInstanceUID", [None])[0]
                body = json.dumps([i for i in map(_item, keys) if series in (None, i["0020000E"]["Value"][0])]).encode()
            elif parts[-1] == "metadata":
                body = json.dumps([_item(int(parts[-2].split(".")[1]))]).encode()
            else:
                kind = 'multipart/related; boundary="cut"'
                body = b"".join(b"--cut\r\nContent-Type: application/octet-stream\r\n\r\n" + f"{parts[-3]}:{n}".encode() + b"\r\n" for n in parts[-1].split(",")) + b"--cut--"
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

    return Handler


def _rows(spark, sf, source: str):
    if sf not in _SERVERS:
        keys = sorted(r["s_suppkey"] for r in fx(spark, sf, "supplier").select("s_suppkey").collect())  # what the server has
        _SERVERS[sf] = ThreadingHTTPServer((spark.conf.get("spark.driver.host", "127.0.0.1"), 0), _handler(keys))
        threading.Thread(target=_SERVERS[sf].serve_forever, daemon=True).start()
    dicomweb.register(spark)
    host, port = _SERVERS[sf].server_address[:2]
    return spark.read.format(source).option("url", f"http://{host}:{port}").option("study", "9").option("batch", "2").load()


_SERVED = "SELECT s_suppkey AS k FROM supplier"


@query("src07_web_headers", f"SELECT '2.' || CAST(k AS VARCHAR) AS uid, '1.' || CAST(k % 7 AS VARCHAR) AS series_uid, 1 + k % 4 AS n_frames, CAST(4 AS INT) AS tile_rows FROM ({_SERVED})")
def web_headers(spark, sf):
    """Headers of a study's instances, a request each."""
    return _rows(spark, sf, "dicomweb").select(F.col("sop_instance_uid").alias("uid"), "series_uid", "n_frames", "tile_rows")


@query("src08_web_filters", f"SELECT '2.' || CAST(k AS VARCHAR) AS uid FROM ({_SERVED}) WHERE k % 7 = 3 AND k % 5 > 0 AND k % 4 > 0")
def web_filters(spark, sf):
    """A filter that the server takes, one that it rejects and that is applied to its answer, and one that stays with Spark."""
    rows = _rows(spark, sf, "dicomweb").where("series_uid = '1.3' and sop_class = 'slide' and n_frames > 1")
    return rows.select(F.col("sop_instance_uid").alias("uid"))


@query("src09_web_frames", f"SELECT '2.' || CAST(k AS VARCHAR) AS uid, i AS frame_index, '2.' || CAST(k AS VARCHAR) || ':' || CAST(i + 1 AS VARCHAR) AS data FROM (SELECT k, unnest(generate_series(0, k % 4)) AS i FROM ({_SERVED}))")
def web_frames(spark, sf):
    """Frames in batches of two, counted from 1 by the server and from 0 here."""
    return _rows(spark, sf, "dicomwebframes").select(F.col("sop_instance_uid").alias("uid"), "frame_index", F.decode("data", "UTF-8").alias("data"))


@query("src11_web_frame_bytes", f"SELECT CAST(sum(1 + k % 4) AS BIGINT) AS frames, CAST(sum((1 + k % 4) * (length('2.' || CAST(k AS VARCHAR)) + 2)) AS BIGINT) AS bytes FROM ({_SERVED})")
def web_frame_bytes(spark, sf):
    """Parts of the server's answers, whatever their length."""
    return _rows(spark, sf, "dicomwebframes").agg(F.count("*").alias("frames"), F.sum(F.length("data")).alias("bytes"))
