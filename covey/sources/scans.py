"""Brain scans in the NIfTI-1 format, and files fetched once to a folder."""

from __future__ import annotations

import gzip
import struct
import urllib.request
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# fixed values of the NIfTI-1 header: places of its fields, and numpy kinds by their datatype codes
HEADER, DIM_AT, KIND_AT, OFFSET_AT, SLOPE_AT, MAGIC_AT = 348, 40, 70, 108, 112, 344
KINDS = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}


def parse_nifti(content: bytes) -> np.ndarray:
    """The volume (x, y, z, t) of a single-file scan, plain or gzip, with its scaling applied."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    order = "<" if struct.unpack_from("<i", content)[0] == HEADER else ">"
    if struct.unpack_from(f"{order}i", content)[0] != HEADER or content[MAGIC_AT : MAGIC_AT + 3] != b"n+1":
        raise ValueError("not a single-file NIfTI-1 scan")
    dims = struct.unpack_from(f"{order}8h", content, DIM_AT)
    shape = [max(1, n) for n in (*dims[1 : 1 + dims[0]], 1, 1, 1, 1)[:4]]
    kind = struct.unpack_from(f"{order}h", content, KIND_AT)[0]
    if kind not in KINDS:
        raise ValueError(f"datatype {kind} isn't supported")
    at, slope, shift = (struct.unpack_from(f"{order}f", content, p)[0] for p in (OFFSET_AT, SLOPE_AT, SLOPE_AT + 4))
    values = np.frombuffer(content, f"{order}{KINDS[kind]}", int(np.prod(shape)), int(at)).astype(float).reshape(shape, order="F")
    return values * slope + shift if slope else values


def pack_nifti(volume: np.ndarray) -> bytes:
    """A scan of doubles."""
    shape = volume.shape + (1,) * (4 - volume.ndim)
    head = bytearray(352)
    struct.pack_into("<i", head, 0, HEADER)
    struct.pack_into("<8h", head, DIM_AT, 4, *shape, 1, 1, 1)
    struct.pack_into("<2h", head, KIND_AT, 64, 64)
    struct.pack_into("<3f", head, OFFSET_AT, 352.0, 1.0, 0.0)
    head[MAGIC_AT : MAGIC_AT + 4] = b"n+1\0"
    return bytes(head) + volume.astype("<f8").tobytes(order="F")


def nifti_voxels(spark: SparkSession, path: str) -> DataFrame:
    """(file, x, y, z, t, v) of every voxel; a task reads a scan and passes it on a time at once."""
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                volume = parse_nifti(content)
                x, y, z = (c.ravel() for c in np.indices(volume.shape[:3], np.int32))
                for t in range(volume.shape[3]):
                    yield pd.DataFrame({"file": name.rpartition("/")[2], "x": x, "y": y, "z": z, "t": t, "v": volume[..., t].ravel()})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "file string, x int, y int, z int, t int, v double")


def read_address(address: str) -> bytes:
    """What an address holds: over the web, or from any other file system."""
    if address.startswith(("http://", "https://", "ftp://")):
        with urllib.request.urlopen(address, timeout=60) as answer:
            return answer.read()
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(address)
    with system.open_input_stream(path, compression=None) as f:
        return f.read()


def fetched(addresses: DataFrame, folder: str, tries: int = 3) -> DataFrame:
    """(address, path, bytes, cached) of files fetched from (address) to ``folder``, as gzip; one that is there isn't fetched again.

    Tasks fetch; a file appears under its name when it is whole.
    """
    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        for frame in frames:
            rows = []
            for address in frame["address"]:
                name = address.rstrip("/").rpartition("/")[2] + ".gz"
                info = system.get_file_info(f"{root}/{name}")
                there = info.type != fs.FileType.NotFound
                if not there:
                    for left in range(tries - 1, -1, -1):
                        try:
                            data = gzip.compress(read_address(address), mtime=0)
                            break
                        except OSError:
                            if not left:
                                raise
                    with system.open_output_stream(f"{root}/_{name}", compression=None) as f:
                        f.write(data)
                    system.move(f"{root}/_{name}", f"{root}/{name}")
                    info = system.get_file_info(f"{root}/{name}")
                rows.append((address, f"{folder}/{name}", info.size, there))
            yield pd.DataFrame(rows, columns=["address", "path", "bytes", "cached"])

    return addresses.select("address").distinct().mapInPandas(fetch, "address string, path string, bytes long, cached boolean")
