"""Level 5 MAT files as a Spark data source named ``mat``: numeric arrays in long form.

``spark.dataSource.register(MatSource)``, then ``spark.read.format("mat").option("path", …)``; each
file is one partition. A row is (file, name, row, column, value), both indexes from 1.
"""

from __future__ import annotations

import glob
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Element types of the format and their numpy names.
TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MATRIX, COMPRESSED = 14, 15
NUMERIC_CLASSES = range(6, 16)


def elements(raw: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    """(type, data) of the elements that follow each other in ``raw``."""
    at = 0
    while at + 8 <= len(raw):
        kind, size = struct.unpack(order + "II", raw[at : at + 8])
        if kind >> 16:  # short form: size and type share four bytes, the data are the next four
            yield kind & 0xFFFF, raw[at + 4 : at + 4 + (kind >> 16)]
            at += 8
            continue
        yield kind, raw[at + 8 : at + 8 + size]
        at += 8 + size + (-size % 8 if kind != COMPRESSED else 0)


def arrays(raw: bytes) -> Iterator[tuple[str, np.ndarray]]:
    """Named real numeric arrays of a file's bytes."""
    if len(raw) < 128 or raw[126:128] not in (b"IM", b"MI"):
        raise ValueError("not a level 5 MAT file")
    order = "<" if raw[126:128] == b"IM" else ">"
    for kind, data in elements(raw[128:], order):
        if kind == COMPRESSED:
            kind, data = next(elements(zlib.decompress(data), order))
        if kind != MATRIX:
            continue
        parts = list(elements(data, order))
        if parts[0][1][0 if order == "<" else 3] not in NUMERIC_CLASSES:
            continue
        shape = np.frombuffer(parts[1][1], order + "i4")
        values = np.frombuffer(parts[3][1], order + TYPES[parts[3][0]])
        yield parts[2][1].decode("ascii"), values.astype(float).reshape(shape, order="F")


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        with open(partition.value, "rb") as f:
            for name, array in arrays(f.read()):
                flat = array.reshape(array.shape[0], -1)
                for (row, column), value in np.ndenumerate(flat):
                    yield partition.value, name, row + 1, column + 1, float(value)


class MatSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mat"

    def schema(self) -> str:
        return "file string, name string, row int, column int, value double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(sorted(glob.glob(self.options["path"])))
