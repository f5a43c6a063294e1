"""Image files: sizes from their headers, failures as rows, and small bitmaps written by tasks."""

from __future__ import annotations

import io
import struct
import tarfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.session import materialize


def _png(b: bytes) -> tuple[int, int]:
    return struct.unpack(">II", b[16:24])


def _bmp(b: bytes) -> tuple[int, int]:
    if struct.unpack("<I", b[14:18])[0] == 12:  # the oldest header holds 16-bit sizes
        return struct.unpack("<HH", b[18:22])
    width, height = struct.unpack("<ii", b[18:26])
    return width, abs(height)  # negative: lines from the top


def _jpeg(b: bytes) -> tuple[int, int]:
    at = 2
    while True:
        while b[at] == 0xFF:
            at += 1
        marker, at = b[at], at + 1
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:  # markers without a segment
            at += 1
            continue
        (size,) = struct.unpack(">H", b[at : at + 2])
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):  # start of frame
            height, width = struct.unpack(">HH", b[at + 3 : at + 7])
            return width, height
        at += size


def _tiff(b: bytes) -> tuple[int, int]:
    end = "<" if b[:2] == b"II" else ">"
    (at,) = struct.unpack(end + "I", b[4:8])
    (entries,) = struct.unpack(end + "H", b[at : at + 2])
    found = {}
    for k in range(entries):
        tag, kind, _, value = struct.unpack(end + "HHI4s", b[at + 2 + 12 * k : at + 14 + 12 * k])
        if tag in (256, 257):  # width and length
            found[tag] = struct.unpack(end + ("H" if kind == 3 else "I"), value[: 2 if kind == 3 else 4])[0]
    return found[256], found[257]


# fixed values: first bytes of the formats
_FORMATS = ((b"\x89PNG\r\n\x1a\n", _png), (b"\xff\xd8", _jpeg), (b"BM", _bmp), (b"II*\0", _tiff), (b"MM\0*", _tiff))


def size_of(content: bytes) -> tuple[int | None, int | None, str | None]:
    """Width, height and, where they cannot be told, why."""
    for start, read in _FORMATS:
        if content.startswith(start):
            try:
                width, height = read(content)
            except (struct.error, IndexError, KeyError):
                return None, None, "header ends early"
            return (width, height, None) if width > 0 and height > 0 else (None, None, "no extent")
    return None, None, "empty file" if not content else "unknown format"


@F.pandas_udf(StructType().add("width", "integer").add("height", "integer").add("problem", "string"))
def _sizes(contents: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame([size_of(bytes(c)) for c in contents], columns=["width", "height", "problem"])
    return out.astype({"width": "Int32", "height": "Int32"})


def described(files: DataFrame) -> DataFrame:
    """(split, stem, ext, path, width, height, problem) of rows with ``path`` and ``content``."""
    path = F.col("path")
    return (
        files.select("path", _sizes("content").alias("s"))
        .select(
            F.element_at(F.split(path, "/"), -2).alias("split"),
            F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1).alias("stem"),
            F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).alias("ext"),
            "path", "s.width", "s.height", "s.problem",
        )
    )


def image_files(spark: SparkSession, glob: str) -> DataFrame:
    """(split, stem, ext, path, width, height, problem) of every file; no pixel is decoded.

    ``split`` is the folder. A file that is no image of a known format keeps its row, with NULL sizes and
    the reason in ``problem``. Only files without a single byte are missing, as Spark's reader skips them.
    The driver lists the files; keep very many small ones in archives (``write_archives``, ``archived``).
    """
    return described(spark.read.format("binaryFile").load(glob))


def bitmap(rgb: np.ndarray) -> bytes:
    """An uncompressed 24-bit bitmap of (height, width, 3) values 0..255."""
    height, width, _ = rgb.shape
    padded = np.zeros((height, -(-width * 3 // 4) * 4), np.uint8)
    padded[:, : width * 3] = rgb[::-1, :, ::-1].reshape(height, -1)
    body = padded.tobytes()
    head = struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def write_files(df: DataFrame, folder: str) -> DataFrame:
    """Write ``content`` of every row to ``folder``/``name``; (name, bytes) of what was written.

    Tasks write through the file system of the folder's address. A file is written whole, so a task that runs
    again leaves the same files.
    """
    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + folder)
        for f in frames:
            for parent in sorted({name.rpartition("/")[0] for name in f["name"]}):
                system.create_dir(f"{base}/{parent}".rstrip("/"), recursive=True)
            for name, content in zip(f["name"], f["content"], strict=True):
                with system.open_output_stream(f"{base}/{name}") as out:
                    out.write(bytes(content))
            yield pd.DataFrame({"name": f["name"], "bytes": [len(c) for c in f["content"]]})

    return materialize(df.select("name", "content").mapInPandas(write, "name string, bytes long"))


#: Files that one archive holds at most.
MEMBERS = 4096


def write_archives(df: DataFrame, folder: str, members: int = MEMBERS) -> DataFrame:
    """Write ``content`` of every row as member ``name`` of tar archives in ``folder``; (name, bytes) of the archives.

    What is opened and listed is one file for many images. A task that runs again leaves the same archives.
    """
    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + folder)
        system.create_dir(base, recursive=True)
        task, number, left = TaskContext.get().partitionId(), 0, []

        def put() -> pd.DataFrame:
            raw = io.BytesIO()
            with tarfile.open(fileobj=raw, mode="w") as tar:
                for name, content in left:
                    info = tarfile.TarInfo(name)
                    info.size = len(content)
                    tar.addfile(info, io.BytesIO(content))
            file = f"part-{task:06d}-{number:06d}.tar"
            with system.open_output_stream(f"{base}/{file}") as out:
                out.write(raw.getvalue())
            left.clear()
            return pd.DataFrame({"name": [file], "bytes": [raw.tell()]})

        for f in frames:
            for name, content in zip(f["name"], f["content"], strict=True):
                left.append((name, bytes(content)))
                if len(left) >= members:
                    yield put()
                    number += 1
        if left:
            yield put()

    return materialize(df.select("name", "content").mapInPandas(write, "name string, bytes long"))


def archived(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of every member of the tar archives in ``folder``; the path goes on behind the archive's name."""
    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    found = [(f"{path}/{m.name}", tar.extractfile(m).read()) for m in tar if m.isfile()]
                yield pd.DataFrame(found, columns=["path", "content"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").load(folder).select("path", "content")
    return files.mapInPandas(members, "path string, content binary")


def _bitmap_pixels(content: bytes) -> tuple[int, int, bytes] | None:
    """Height, width and BGR lines from the top of an uncompressed 24-bit bitmap; None if it is cut off."""
    if len(content) < 54 and content[:2] == b"BM":
        return None
    depth, packing = struct.unpack("<HI", content[28:34]) if content[:2] == b"BM" else (0, 0)
    if (depth, packing) != (24, 0):
        raise ValueError("only uncompressed 24-bit bitmaps are decoded from archives")
    (start,), (width, height) = struct.unpack("<I", content[10:14]), struct.unpack("<ii", content[18:26])
    line, lines = -(-width * 3 // 4) * 4, abs(height)
    if len(content) < start + line * lines:
        return None
    rows = np.frombuffer(content, np.uint8, line * lines, start).reshape(lines, line)[:, : width * 3]
    return lines, width, (rows[::-1] if height > 0 else rows).tobytes()


def decoded(files: DataFrame) -> DataFrame:
    """Bitmaps of (path, content) in the columns of Spark's image source; those that are cut off are left out."""
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            read = [(p, _bitmap_pixels(bytes(c))) for p, c in zip(f["path"], f["content"], strict=True)]
            yield pd.DataFrame(
                [(p, r[0], r[1], 3, r[2]) for p, r in read if r], columns=["origin", "height", "width", "nChannels", "data"]
            )

    return files.mapInPandas(work, "origin string, height int, width int, nChannels int, data binary")
