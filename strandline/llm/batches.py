"""Arrow plumbing: apply a function of whole texts to a column of documents."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text whose rows go out as one Arrow batch.
_BATCH = 8 << 20

#: Rows and bytes of one batch from Spark. Spark's 10,000 rows of long texts,
#: twice over in each of several workers, are more than an executor can spare.
MOST_ROWS, MOST_BYTES = 1000, 8 << 20


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs``; the session's batches for Python workers from now on hold at
    most MOST_ROWS rows and MOST_BYTES bytes, or fewer as it was set."""
    conf = docs.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", MOST_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", MOST_BYTES)):
        now = conf.get(name).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(name, str(most))
    return docs


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, which after its last batch gives the memory it freed back to
    the system: workers live on, and other tasks share their executor."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def encoded(text: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    for x in text.cast(pa.binary()):
        yield x.as_py() or b""


def _groups(texts: Iterator[bytes], size: int) -> Iterator[list[bytes]]:
    some, total = [], 0
    for data in texts:
        some.append(data)
        total += len(data)
        if total >= size:
            yield some
            some, total = [], 0
    if some:
        yield some


def map_texts(docs: DataFrame, keys: list[str], text: str, make: Callable[[], Callable[[bytes], tuple]], fields: list[tuple[str, pa.DataType, str]], group: int | None = None) -> DataFrame:
    """One output row per input row: its keys, then what ``make()`` computes.

    ``make`` is called once in each task and returns the function of one
    text, or with ``group`` of a list of texts of about so many bytes, which
    gives a list of rows. ``fields``: (name, Arrow type, Spark type).
    """
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [f"`{n}` {s}" for n, _, s in fields])
    taken = [*keys] if text in keys else [*keys, text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            at = 0
            for some in _groups(encoded(batch.column(taken.index(text))), group or _BATCH):
                rows = [f(data) for data in some] if group is None else f(some)
                made = [pa.array(col, type=t) for col, (_, t, _) in zip(zip(*rows), fields)]
                part = batch.slice(at, len(some))
                at += len(some)
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keys))] + made, names=[*keys, *(n for n, _, _ in fields)])

    return small_batches(docs).select(*taken).mapInArrow(tidy(run), schema)
