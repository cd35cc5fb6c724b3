"""Slides on a DICOMweb server, as Spark data sources.

`dicomweb` gives one header row an instance; equality filters on series_uid, sop_class and modality go
to the server as query parameters, and every other filter stays with Spark. A filter that the server
rejects is dropped and applied to its answer instead; an optional field that it doesn't know isn't asked
for again. Which one it is the server says, or is found by leaving out one after the other. `dicomwebframes` gives one row a frame, fetched in
batches. A partition has some instances, which it asks for one after the other over one connection.
"""

from __future__ import annotations

import contextlib
import http.client
import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType

from tessera.sources import dicom

#: Keywords of the query parameters and tags of the answers.
PARAMETERS = {"series_uid": "SeriesInstanceUID", "sop_class": "SOPClassUID", "modality": "Modality"}
COLUMNS = {"series_uid": "0020000E", "sop_class": "00080016", "modality": "00080060"}
#: Fixed value: fields that are asked for and that a server may not know.
OPTIONAL = ("AvailableTransferSyntaxUID",)
#: A partition has at most so many instances.
_MOST = 1024
HEADER = "study_uid string, series_uid string, sop_instance_uid string, sop_class string, modality string, n_frames long, tile_rows int, tile_columns int, syntaxes array<string>"
FRAME = "sop_instance_uid string, frame_index long, data binary"


def _get(url: str, accept: str) -> tuple[bytes, str]:
    with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": accept}), timeout=60) as answer:  # noqa: S310
        return answer.read(), answer.headers.get("Content-Type", "")


class _Connection:
    """GET requests to one server over a connection that is kept, and opened anew where the server closed it."""

    def __init__(self, url: str) -> None:
        self.url, self.base = url, urllib.parse.urlsplit(url)
        self.kept: http.client.HTTPConnection | None = None

    def get(self, path: str, accept: str) -> tuple[bytes, str]:
        if self.base.scheme in urllib.request.getproxies() and not urllib.request.proxy_bypass(self.base.hostname or ""):
            return _get(self.url + path, accept)
        for fresh in (self.kept is None, True):
            if self.kept is None:
                kind = http.client.HTTPSConnection if self.base.scheme == "https" else http.client.HTTPConnection
                self.kept = kind(self.base.netloc, timeout=60)
            try:
                self.kept.request("GET", self.base.path + path, headers={"Accept": accept})
                answer = self.kept.getresponse()
                body = answer.read()
            except (http.client.HTTPException, ConnectionError):
                self.close()
                if fresh:
                    raise
                continue
            if answer.status == 200:
                return body, answer.headers.get("Content-Type", "")
            self.close()
            return _get(self.url + path, accept)  # redirections and errors, as ever
        raise AssertionError

    def close(self) -> None:
        if self.kept is not None:
            self.kept.close()
            self.kept = None


def _value(item: dict, tag: str, default=None):
    got = item.get(tag, {}).get("Value")
    return got[0] if got else default


def _without(sent: dict[str, str], fields: list[str], error: str) -> Iterator[tuple[dict[str, str], list[str]]]:
    """What to ask instead: without the filter or field that the server names, else without any one of them."""
    named = [k for k in sent if PARAMETERS[k] in error], [f for f in fields if f in error]
    for k in named[0] or ([] if named[1] else list(sent)):
        yield {x: v for x, v in sent.items() if x != k}, fields
    for f in named[1] or ([] if named[0] else fields):
        yield sent, [x for x in fields if x != f]


def search(url: str, study: str, filters: dict[str, str]) -> list[dict]:
    """Instances of a study that the filters let through."""

    def ask(sent: dict[str, str], fields: list[str]) -> list[dict]:
        query = urllib.parse.urlencode([*((PARAMETERS[k], v) for k, v in sent.items()), *(("includefield", f) for f in fields)])
        try:
            raw, _ = _get(f"{url}/studies/{study}/instances" + (f"?{query}" if query else ""), "application/dicom+json")
        except urllib.error.HTTPError as e:
            if e.code != 400:
                raise
            for fewer in _without(sent, fields, e.read().decode("utf-8", "replace")):
                try:
                    return ask(*fewer)
                except urllib.error.HTTPError as other:
                    if other.code != 400:
                        raise
            raise
        return json.loads(raw or b"[]")

    return [i for i in ask(dict(filters), list(OPTIONAL)) if all(_value(i, COLUMNS[k]) == v for k, v in filters.items())]


def parts_of(body: bytes, content_type: str) -> list[bytes]:
    """Bodies of a multipart answer."""
    mark = content_type.split("boundary=", 1)[1].split(";")[0].strip('" ').encode()
    out = []
    for part in body.split(b"--" + mark)[1:]:
        if part.startswith(b"--"):
            break
        out.append(part.split(b"\r\n\r\n", 1)[1].removesuffix(b"\r\n"))
    return out


def negotiate(wanted: list[str], offered: list[str] | None, probe) -> str | None:
    """The first wanted syntax that is offered; where the server doesn't say, the first that it sends."""
    if offered:
        return next((s for s in wanted if s in offered), None)
    return next((s for s in wanted if probe(s)), None)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options, self.filters = options, {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in PARAMETERS:
                self.filters[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        found = search(self.options["url"], self.options["study"], self.filters)
        return [InputPartition(found[run.start : run.stop]) for run in dicom.dealt(len(found), -(-len(found) // _MOST))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with contextlib.closing(_Connection(self.options["url"])) as server:
            for found in partition.value:
                yield from self.rows(server, found)

    def rows(self, server: _Connection, found: dict) -> Iterator[tuple]:
        raise NotImplementedError


class _Headers(_Reader):
    def rows(self, server: _Connection, found: dict) -> Iterator[tuple]:
        o, series, uid = self.options, _value(found, "0020000E"), _value(found, "00080018")
        raw, _ = server.get(f"/studies/{o['study']}/series/{series}/instances/{uid}/metadata", "application/dicom+json")
        h = json.loads(raw)[0]
        yield o["study"], series, uid, _value(h, "00080016"), _value(h, "00080060"), int(_value(h, "00280008", 1)), _value(h, "00280010"), _value(h, "00280011"), h.get("00083002", {}).get("Value")


class _Frames(_Reader):
    def rows(self, server: _Connection, found: dict) -> Iterator[tuple]:
        o = self.options
        series, uid, n = _value(found, "0020000E"), _value(found, "00080018"), int(_value(found, "00280008", 1))
        batch = int(o.get("batch", 64))
        for lo in range(0, n, batch):
            wanted = range(lo, min(lo + batch, n))
            numbers = ",".join(str(i + 1) for i in wanted)  # frames count from 1 on the wire
            body, kind = server.get(f"/studies/{o['study']}/series/{series}/instances/{uid}/frames/{numbers}", f'multipart/related; type="application/octet-stream"; transfer-syntax={o.get("syntax", dicom.EXPLICIT)}')
            for i, data in zip(wanted, parts_of(body, kind), strict=True):
                yield uid, i, data


class DicomWeb(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dicomweb"

    def schema(self) -> str:
        return HEADER

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Headers(dict(self.options))


class DicomWebFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dicomwebframes"

    def schema(self) -> str:
        return FRAME

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Frames(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DicomWeb)
    spark.dataSource.register(DicomWebFrames)
