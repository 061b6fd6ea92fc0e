"""Links as a Spark data source: ``spark.read.format("seogo_links").option("urls", ...).load()``.

Options: ``urls`` (one per line), ``perPartition`` (links a task fetches, default 16), ``replay`` (a JSON-lines file of
recorded answers with url, status, body and headers, read instead of the network), and settings by their names
(``allowed_hosts``, ``confluence_pat``, ``http_timeout`` and so on).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import fields
from itertools import batched

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..settings import Settings
from .files import source_id_of
from .links import Fetcher, Response, Transport, fetch_link
from .model import PART_SCHEMA, ParseError


class _Links(InputPartition):
    def __init__(self, urls: list[str]) -> None:
        self.urls = urls


def _settings(options: dict[str, str]) -> Settings:
    known = {f.name.lower().replace("_", ""): f for f in fields(Settings)}
    out = Settings.in_session()
    for key, raw in options.items():
        f = known.get(key.lower().replace("_", ""))
        if f is None:
            continue
        old = getattr(out, f.name)
        kind = type(old)
        setattr(out, f.name, raw.strip().lower() in ("1", "true", "yes", "on") if kind is bool else [x.strip().lower() for x in raw.split(",") if x.strip()] if kind is list else raw if old is None else kind(raw))
    return out


def _recorded(path: str) -> Transport:
    with open(path, encoding="utf-8") as f:
        rows = {r["url"]: r for r in map(json.loads, f)}

    def send(url: str, headers: dict[str, str]) -> Response:
        r = rows.get(url)
        return Response(r.get("status", 200), r.get("body", "").encode(), r.get("headers", {}), url) if r else Response(404, url=url)

    return send


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        urls = list(dict.fromkeys(u.strip() for u in self.options.get("urls", "").splitlines() if u.strip()))
        return [_Links(list(b)) for b in batched(urls, int(self.options.get("perpartition", 16)))] or [_Links([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        settings, replay = _settings(self.options), self.options.get("replay")
        fetcher = Fetcher(settings, _recorded(replay) if replay else None, check_dns=not replay)
        for url in partition.urls:
            try:
                rows = fetch_link(url, settings, fetcher=fetcher).rows(source_id_of(url))
            except ParseError as e:
                yield source_id_of(url), 0, None, 0, url, None, {}, [], [], str(e)
                continue
            for r in rows:
                blocks = [(b["pos"], b["text"], b["kind"], b["level"], b["page"], b["meta"]) for b in r["blocks"]]
                yield r["source_id"], r["part_ordinal"], r["parent_ordinal"], r["depth"], r["source_name"], r["source_type"], r["metadata"], r["warnings"], blocks, None


class LinkSource(DataSource):
    """One row per part of every link (``model.PART_SCHEMA``); links that cannot be read carry ``error``."""

    @classmethod
    def name(cls) -> str:
        return "seogo_links"

    def schema(self) -> str:
        return PART_SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LinkSource)
