"""A paged search service as a Python data source: planned page ranges, pushed filters, and a stream with a resumable offset."""

from __future__ import annotations

import hashlib
import importlib
import json
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition

#: Results of a page, and pages that one task reads, unless the options say otherwise.
PAGE, PAGES_A_TASK = 100, 10


@dataclass
class Pages(InputPartition):
    """The results from `begin` to `end` of a query."""

    begin: int
    end: int


class PagedSearch(DataSource):
    """Options: service (`package.module:function`), query (text), schema (DDL), page, pages_a_task, most (results at most); others go
    to the service. The service is called as service(query, filters, offset, limit, options) and returns (total, rows): the
    number of all results and those asked for, as dicts. filters: a dict of the columns that have to equal a value."""

    @classmethod
    def name(cls) -> str:
        return "paged_search"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options, schema.fieldNames())

    def streamReader(self, schema) -> PagedStream:
        return PagedStream(self.options, schema.fieldNames())


def _service(options: dict) -> Callable:
    module, _, name = options["service"].partition(":")
    return getattr(importlib.import_module(module), name)


class _Pages:
    def __init__(self, options: dict, columns: list[str]) -> None:
        self.options, self.columns, self.filters = options, columns, {}
        self.page, self.most = int(options.get("page", PAGE)), int(options.get("most", 1 << 62))
        self.step = self.page * int(options.get("pages_a_task", PAGES_A_TASK))

    def ask(self, offset: int, limit: int) -> tuple[int, list[dict]]:
        return _service(self.options)(self.options.get("query", ""), self.filters, offset, limit, dict(self.options))

    def total(self) -> int:
        return min(self.most, self.ask(0, 0)[0])

    def planned(self, begin: int, end: int) -> list[Pages]:
        return [Pages(a, min(a + self.step, end)) for a in range(begin, end, self.step)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        for at in range(partition.begin, partition.end, self.page):
            for row in self.ask(at, min(self.page, partition.end - at))[1]:
                yield tuple(row.get(c) for c in self.columns)


class PagedReader(_Pages, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equalities of a column go to the service; all others stay with Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] not in self.filters:
                self.filters[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self) -> list[Pages]:
        return self.planned(0, self.total())


class PagedStream(_Pages, DataSourceStreamReader):
    """The offset is the number of results read; a restart goes on from the one that its checkpoint holds."""

    def initialOffset(self) -> dict:
        return {"read": 0}

    def latestOffset(self) -> dict:
        return {"read": self.total()}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return self.planned(start["read"], end["read"])

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSearch)
    return spark


#: Rows that are decoded at a time, and results that are read ahead of a page, for the pages that follow.
BATCH, AHEAD = 512, 1000
_held: dict[str, object] = {}


def _places(files: list[str], query: str, filters: dict) -> np.ndarray:
    """(file, row group, row) of each result in the order of the ids; only ids and places of results are held."""
    keys, places = [], []
    for n, path in enumerate(files):
        file = pq.ParquetFile(path)
        key, names = file.schema_arrow.names[0], set(file.schema_arrow.names)
        asked = sorted({key, "text", *filters} & names)
        for group in range(file.num_row_groups):
            at = 0
            for batch in file.iter_batches(BATCH, row_groups=[group], columns=asked):
                of = lambda c, batch=batch: batch.column(batch.schema.get_field_index(c)) if c in names else pa.nulls(batch.num_rows)  # noqa: B023, E731
                hit = pc.fill_null(pc.match_substring(of("text").cast(pa.string()), query), query == "")
                for c, value in filters.items():
                    hit = pc.and_(hit, pc.is_null(of(c)) if value is None else pc.fill_null(pc.equal(of(c), value), False) if c in names else pa.array([False] * batch.num_rows))
                rows = np.flatnonzero(hit.to_numpy(zero_copy_only=False))
                if len(rows):
                    keys.append(of(key).take(pa.array(rows)))
                    places.append(np.column_stack([np.full(len(rows), n), np.full(len(rows), group), rows + at]))
                at += batch.num_rows
    if not keys:
        return np.zeros((0, 3), np.int64)
    table = pa.table({"key": pa.chunked_array(keys), "at": np.arange(sum(map(len, keys)))})
    return np.concatenate(places)[pc.sort_indices(table, sort_keys=[("key", "ascending"), ("at", "ascending")]).to_numpy()]


def _rows(files: list[str], places: np.ndarray) -> list[dict]:
    """The rows at these places, in their order; each row group is decoded once, up to its last row asked for."""
    out: list = [None] * len(places)
    for n, group in np.unique(places[:, :2], axis=0):
        own = np.flatnonzero((places[:, 0] == n) & (places[:, 1] == group))
        own = own[np.argsort(places[own, 2])]
        want, at, done = places[own, 2], 0, 0
        for batch in pq.ParquetFile(files[n]).iter_batches(BATCH, row_groups=[int(group)]):
            to = int(np.searchsorted(want, at + batch.num_rows))
            for k, row in zip(own[done:to], batch.take(pa.array(want[done:to] - at)).to_pylist(), strict=True):
                out[k] = row
            at, done = at + batch.num_rows, to
            if done == len(want):
                break
    return out


def file_service(query: str, filters: dict, offset: int, limit: int, options: dict) -> tuple[int, list[dict]]:
    """A stand-in for a REST service: rows of a Parquet file at options["table"] whose text holds the query, in the order of their ids.
    Each call is noted in the folder options["log"], if there is one.

    The places of a search's results are found in one scan that holds a batch of rows, and kept in the folder options["index"], if there
    is one (else by the process), so that a page costs the row groups of its rows, not the table."""
    if log := options.get("log"):
        with open(os.path.join(log, uuid.uuid4().hex), "w") as f:
            json.dump({"filters": filters, "offset": offset, "limit": limit}, f)
    files = sorted(ds.dataset(options["table"].removeprefix("file://").removeprefix("file:"), format="parquet").files)
    stamps = [(path, (s := os.stat(path)).st_size, s.st_mtime_ns) for path in files]
    name = hashlib.sha256(repr((stamps, query, sorted(filters.items()))).encode()).hexdigest()
    if _held.get("name") != name:
        folder = (options.get("index") or "").removeprefix("file://").removeprefix("file:")
        kept = os.path.join(folder, f"{name}.npy")
        if folder and os.path.exists(kept):
            places = np.load(kept, mmap_mode="r")
        else:
            places = _places(files, query, filters)
            if folder:
                os.makedirs(folder, exist_ok=True)
                np.save(own := os.path.join(folder, f"{uuid.uuid4().hex}.npy"), places)
                os.replace(own, kept)
        _held.update(name=name, places=places, begin=0, rows=[])
    places = _held["places"]
    end = min(offset + limit, len(places))
    if offset < end and not _held["begin"] <= offset <= end <= _held["begin"] + len(_held["rows"]):
        _held.update(begin=offset, rows=_rows(files, np.asarray(places[offset : max(end, offset + AHEAD)])))
    at = offset - _held["begin"]
    return len(places), _held["rows"][at : at + end - offset] if offset < end else []
