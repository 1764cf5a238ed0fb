"""A paged candle source as a Spark data source; the network client is a seam.

Register `CandleSource` and read format("candles") with a `client` that imports to a function
fetch(symbol, timeframe_ms, since_ms, limit) -> rows [ms, open, high, low, close, volume]. Each symbol, or each window of
`window_ms` of each symbol, is a partition. Without a `limit`, the first page tells how many candles a page has.
`client_options` is a JSON object of further arguments to the client. Filters on symbol and ms say which windows are fetched at
all, and which pages of them, for readers that `candles` makes in a session with spark.sql.python.filterPushdown.enabled.
"""

from __future__ import annotations

import functools
import importlib
import json
import re
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
)


def with_retries(
    call: Callable, most: int = 5, base: float = 2.0, ceiling: float = 60.0,
    transient: tuple[type[Exception], ...] = (ConnectionError, TimeoutError), sleep: Callable[[float], None] = time.sleep
):
    """Calls again after transient errors, waiting base * 2**k seconds, `ceiling` at most."""
    for k in range(most + 1):
        try:
            return call()
        except transient:
            if k == most:
                raise
            sleep(min(base * 2**k, ceiling))


def page_limit(fetch: Callable, symbol: str, timeframe_ms: int, start_ms: int, ask: int = 5000, default: int = 500, **retry) -> int:
    """The size of the page that `ask` candles come as; the default if there are none. Too few only means more pages."""
    return len(with_retries(lambda: fetch(symbol, timeframe_ms, start_ms, ask), **retry)) or default


def fetch_range(
    fetch: Callable, symbol: str, timeframe_ms: int, start_ms: int, end_ms: int, limit: int | None = 500, first: int = 0, **retry
) -> Iterator[tuple]:
    """Candles that open at or after the cursor and close by the end. The cursor moves behind the last candle of a page;
    an empty page is a gap of its length. limit: None to find it out; first: the number of the first candle."""
    cursor, seq = start_ms, first
    limit = page_limit(fetch, symbol, timeframe_ms, start_ms, **retry) if limit is None else limit
    while cursor + timeframe_ms <= end_ms:
        page = with_retries(lambda at=cursor: fetch(symbol, timeframe_ms, at, limit), **retry)
        good = [c for c in page if c[0] >= cursor and c[0] + timeframe_ms <= end_ms]
        for c in good:
            yield (symbol, int(c[0]), *(None if v is None else float(v) for v in c[1:6]), seq)
            seq += 1
        cursor = max(c[0] for c in good) + timeframe_ms if good else cursor + limit * timeframe_ms


class WindowPartition(InputPartition):
    def __init__(self, symbol: str, number: int, start: int, end: int):
        self.symbol, self.number, self.start, self.end = symbol, number, start, end


class CandleReader(DataSourceReader):
    def __init__(self, options):
        self.options = options
        self.timeframe, self.start, self.end = (int(options[k]) for k in ("timeframe_ms", "start_ms", "end_ms"))
        self.symbols = [s.strip() for s in options["symbols"].split(",")]
        self.least, self.most = self.start, self.end - self.timeframe  # the times at which a candle may open

    def partitions(self):
        """Windows that can hold a wanted candle; their bounds do not depend on what is wanted."""
        width = int(self.options.get("window_ms", max(1, self.end - self.start)))
        width = max(1, width // self.timeframe) * self.timeframe  # a candle lies in one window
        out = []
        for i, a in enumerate(range(self.start, max(self.end, self.start + 1), width)):
            low, high = max(a, self.least), min(a + width, self.end, self.most + self.timeframe)
            out += [WindowPartition(s, i, low, high) for s in self.symbols if low < high]
        return out or [WindowPartition("", 0, 0, 0)]

    def read(self, p):
        module, _, name = self.options["client"].rpartition(".")
        limit = self.options.get("limit")
        fetch = functools.partial(getattr(importlib.import_module(module), name), **json.loads(self.options.get("client_options", "{}")))
        if p.start < p.end:
            yield from fetch_range(fetch, p.symbol, self.timeframe, p.start, p.end, None if limit is None else int(limit), p.number << 40)


class SelectiveReader(CandleReader):
    """Asks for what filters on symbol and ms leave; other filters go back to Spark."""

    def pushFilters(self, filters: list) -> Iterable:
        for f in filters:
            if not self._took(f):
                yield f

    def _took(self, f) -> bool:
        value = getattr(f, "value", None)
        if isinstance(f, IsNotNull):
            return f.attribute in (("symbol",), ("ms",))
        if f.attribute == ("symbol",) and isinstance(f, (EqualTo, In)):
            wanted = set(value) if isinstance(f, In) else {value}
            self.symbols = [s for s in self.symbols if s in wanted]
            return True
        if f.attribute != ("ms",) or value is None or not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
            return False
        if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
            self.least = max(self.least, value + isinstance(f, GreaterThan))
        if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
            self.most = min(self.most, value - isinstance(f, LessThan))
        return True


class CandleSource(DataSource):
    @classmethod
    def name(cls):
        return "candles"

    def schema(self):
        return "symbol string, ms long, open double, high double, low double, close double, volume double, seq long"

    def reader(self, schema):
        return (SelectiveReader if self.options.get("selective") == "true" else CandleReader)(self.options)


def candles(spark: SparkSession, **options) -> DataFrame:
    """The candles of a client, lazily: filters decide what is asked for where the session, now and when it runs the query,
    has spark.sql.python.filterPushdown.enabled."""
    name = CandleSource.name()
    try:
        spark.dataSource.register(CandleSource)
    except AnalysisException as e:  # a session beside the one that has it knows the name, but not the source
        if e.getCondition() != "DATA_SOURCE_ALREADY_EXISTS":
            raise
        name = f"{name}_{uuid.uuid4().hex}"
        spark.dataSource.register(type("Candles", (CandleSource,), {"name": classmethod(lambda cls, name=name: name)}))
    selective = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(name).options(selective=selective, **options).load()


def selective_session(spark: SparkSession) -> SparkSession:
    """A session beside the given one, whose own settings stay as they are, that pushes filters to Python sources."""
    s = spark.newSession()
    s.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    s.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    s.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return s


def record(candles: DataFrame, folder: str) -> None:
    """Stores candles (symbol, ms, open to volume) so that `recorded` can answer for the exchange."""
    candles.repartition("symbol").sortWithinPartitions("symbol", "ms").write.partitionBy("symbol").parquet(folder)


def recorded(symbol: str, timeframe_ms: int, since_ms: int, limit: int, folder: str) -> list[list]:
    """A client that serves pages from a folder of stored candles; a symbol that it lacks has none."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    where, root = fs.FileSystem.from_uri(folder)
    name = re.sub(r"""[\x00-\x1f"#%'*/:=?\\\x7f{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", symbol)  # as Spark names the folder
    if where.get_file_info(f"{root}/symbol={name}").type == fs.FileType.NotFound:
        return []
    rows = ds.dataset(f"{root}/symbol={name}", filesystem=where, format="parquet")
    page = rows.to_table(["ms", "open", "high", "low", "close", "volume"], filter=ds.field("ms") >= since_ms).sort_by("ms").slice(0, limit)
    return [list(r.values()) for r in page.to_pylist()]
