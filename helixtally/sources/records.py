"""FASTA and FASTQ files as a data source, `fastx`, whose partitions are ranges of bytes.

A range owns the records that follow a line feed inside it (and the first of the file, if it begins there). Its reader finds the first of them by
itself and reads on, past the end of the range, to the end of the last. So no range needs to know what is in another:
there is nothing to count beforehand, and no second scan that could disagree with the first. Block gzip (a gzip member for
each 64 KB, with its size in its header) is dealt out in the same way, by members; other gzip files are one range.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, seq_no long, seq string"
#: Bytes that are parsed at a time, of a range by default, and that a file counts for besides its own.
CHUNK, RANGE, OPENING = 1 << 22, 1 << 27, 1 << 20
#: Bytes of text in a byte of gzip, about, for DNA with qualities.
PACKED = 4
WHITE = " \t\n\x0b\x0c\r"
#: The fixed bytes of a block-gzip member's header (RFC 1952 with the BC field), between which stand time and flags.
BLOCK_START, BLOCK_FIELD = b"\x1f\x8b\x08\x04", b"\x06\x00BC\x02\x00"
BLOCK_HEADER = 18


def local_path(path: str) -> str | None:
    """The path on a local file system, or None for another."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if path.startswith("/") else None


def opened(path: str):
    """A seekable binary file; other schemes than file: are those that Arrow knows."""
    if (here := local_path(path)) is not None:
        return open(here, "rb")
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return where.open_input_file(unquote(name))


def readable(path: str) -> bool:
    """Whether `opened` knows the path's scheme; others are read by Spark, a whole file at a time."""
    return local_path(path) is not None or path.split("://")[0] in ("s3", "s3a", "gs", "gcs", "hdfs", "abfs", "abfss")


@dataclass(frozen=True)
class Piece:
    """Bytes start to end of a file of `size` bytes."""

    path: str
    start: int
    end: int
    size: int


@dataclass
class Pieces(InputPartition):
    pieces: list[Piece]

    def __init__(self, pieces: list[Piece]):
        super().__init__(pieces)
        self.pieces = pieces


def weight(path: str, length: int) -> int:
    """What reading so many bytes of a file costs, in bytes of a plain one."""
    return (PACKED if path.lower().endswith(".gz") else 1) * length + OPENING


def pieces_of(files: list[tuple[str, int]], size: int, tasks: int = 1) -> list[Pieces]:
    """Partitions of some `size` bytes: large files in pieces, small ones together, but in as many partitions as tasks can run."""
    out, now, held = [], [], 0
    most = min(size, -(-sum(weight(*x) for x in files) // tasks))
    for path, length in files:
        n = max(1, -(-length // size))
        for i in range(n):
            start, end = length * i // n, length * (i + 1) // n
            if now and held + weight(path, end - start) > most:
                out.append(Pieces(now))
                now, held = [], 0
            now.append(Piece(path, start, end, length))
            held += weight(path, end - start)
    return [*out, Pieces(now)] if now else out


# --- chunks: (bytes, whether they are the range's own, the number of the first byte) ---

Chunks = Iterator[tuple[bytes, bool, int]]


def plain_chunks(f, p: Piece) -> Chunks:
    f.seek(p.start)
    at = p.start
    while data := f.read(CHUNK if at >= p.end else min(CHUNK, p.end - at)):
        yield data, at < p.end, at
        at += len(data)


def gzip_chunks(f) -> Chunks:
    """A whole gzip file of one or more members; a broken one is an error."""
    at, raw, unpack = 0, b"", zlib.decompressobj(31)
    while True:
        raw = raw or f.read(CHUNK)
        if not raw:
            if not unpack.eof and (at or unpack.unused_data or f.tell()):
                raise EOFError("unexpected end of a gzip file")
            return
        if unpack.eof:
            raw = raw.lstrip(b"\0")  # padding between members
            if not raw:
                continue
            unpack = zlib.decompressobj(31)
        data = unpack.decompress(raw, CHUNK)
        raw = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
        if data:
            yield data, True, at
            at += len(data)


def member_size(header: bytes) -> int | None:
    """The length of the block-gzip member that starts with these bytes."""
    if len(header) >= BLOCK_HEADER and header.startswith(BLOCK_START) and header[10:16] == BLOCK_FIELD:
        return int.from_bytes(header[16:18], "little") + 1
    return None


def first_member(f, p: Piece) -> int | None:
    """Where the first member starts in a piece: one that is followed by another, or by the end of the file."""
    at = p.start
    while at < p.end:
        f.seek(at)
        data = f.read(min(1 << 17, p.end - at) + BLOCK_HEADER)
        k = data.find(BLOCK_START)
        while 0 <= k < p.end - at:
            n = member_size(data[k : k + BLOCK_HEADER])
            if n is not None:
                f.seek(at + k + n)
                after = f.read(BLOCK_HEADER)
                if not after or member_size(after) is not None:
                    return at + k
            k = data.find(BLOCK_START, k + 1)
        at += max(1, len(data) - BLOCK_HEADER)
    return None


def member_chunks(f, p: Piece) -> Chunks:
    """The members from the first of a piece on; a byte's number is its member's place and its place in there."""
    at = first_member(f, p)
    if at is None:
        return
    f.seek(at)
    raw = b""
    while True:
        if len(raw) < BLOCK_HEADER:
            raw += f.read(max(CHUNK, 1 << 17))
        if not raw:
            return
        n = member_size(raw[:BLOCK_HEADER])
        if n is None:
            raise EOFError(f"unexpected end of a gzip member, or no member, at byte {at} of {p.path}")
        if len(raw) < n:
            raw += f.read(max(CHUNK, 1 << 17))
        if len(raw) < n:
            raise EOFError(f"unexpected end of the gzip member at byte {at} of {p.path}")
        data = zlib.decompress(raw[:n], 31)
        if data:
            yield data, at < p.end, at << 16
        at, raw = at + n, raw[n:]


class Window:
    """The bytes of a range that are not parsed yet: their numbers, and how many of them are the range's own."""

    def __init__(self, chunks: Chunks):
        self.chunks, self.data, self.own, self.whole = chunks, bytearray(), 0, False
        self.starts, self.numbers = [], []

    def more(self) -> bool:
        """Reads CHUNK bytes or more, or to the end, which it returns."""
        goal = len(self.data) + CHUNK
        while len(self.data) < goal:
            got = next(self.chunks, None)
            if got is None:
                self.whole = True
                return True
            data, own, at = got
            self.starts.append(len(self.data))
            self.numbers.append(at)
            self.data += data
            self.own += len(data) * own
            self.whole = not own
        return False

    def number(self, at: np.ndarray) -> np.ndarray:
        k = np.maximum(np.searchsorted(self.starts, at, "right") - 1, 0)
        return np.array(self.numbers, np.int64)[k] + at - np.array(self.starts, np.int64)[k]

    def drop(self, n: int) -> None:
        k = max(0, int(np.searchsorted(self.starts, n, "right")) - 1)
        self.numbers, self.starts = self.numbers[k:], self.starts[k:]
        if self.starts:
            self.numbers[0] += n - self.starts[0]
            self.starts = [0, *(s - n for s in self.starts[1:])]
        del self.data[:n]
        self.own = max(0, self.own - n)


def batch(path: str, number: np.ndarray, seq: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path]).take(pa.array(np.zeros(len(seq), np.int32))), pa.array(number), seq], ["file", "seq_no", "seq"])


def fastq(w: Window, path: str, first: bool, alone: bool) -> Iterator[pa.RecordBatch]:
    """The second line of every four, trimmed. alone: the range is the whole file, of which nothing is asked; in others,
    records must begin with @ and their third lines with +, by which a range finds its first record.
    """
    synced, end = first, False
    while not end:
        end = w.more()
        data = np.frombuffer(bytes(w.data), np.uint8)
        feeds = np.flatnonzero(data == 10)
        if end and len(data) and (not len(feeds) or feeds[-1] != len(data) - 1):
            feeds = np.append(feeds, len(data))
        start = np.append(0, feeds[:-1] + 1) if len(feeds) else feeds
        n, k = len(start), 0
        head = np.where(feeds > start, data[np.minimum(start, max(0, len(data) - 1))], 0) if n else start
        if not synced:
            found = np.flatnonzero((head[1:-2] == ord("@")) & (head[3:] == ord("+"))) + 1
            if not len(found) and w.whole and n and feeds[0] >= w.own:
                return  # inside of one record
            if not len(found) and not end:
                continue
            k = int(found[0]) if len(found) else n
            if not len(found) and n >= 3 and head[n - 2] == ord("@") and head[n - 1] != ord("@"):
                k = n - 2  # a last record that was cut short
            synced = True
        ready = n - k if end else (n - k) // 4 * 4
        at = start[k : k + ready : 4]
        mine = int(((at == 0) | (at - 1 < w.own)).sum())  # the one at 0 is known to be the range's own
        rows = k + 4 * np.arange(mine)
        seqs = rows[rows + 1 < k + ready] + 1
        if not alone:
            bad = np.flatnonzero((head[rows] != ord("@")) | (rows + 2 < n) & (head[np.minimum(rows + 2, n - 1)] != ord("+")))
            bad = bad[~(end & (head[rows[bad]] == 0))]  # blank lines may end a file
            if len(bad):
                raise ValueError(f"no FASTQ record at byte {w.number(start[rows[bad[:1]]])[0]} of {path}; a range as long as the file reads it by lines alone")
        if len(seqs):
            lines = pa.StringArray.from_buffers(n, pa.py_buffer(np.append(start, min(feeds[-1] + 1, len(data))).astype(np.int32)), pa.py_buffer(data))
            yield batch(path, w.number(start[seqs - 1]), pc.ascii_trim(lines.take(pa.array(seqs)), WHITE))
        after = int(start[k + ready]) if k + ready < n else int(feeds[-1]) + 1 if n else 0
        if mine < len(at) or w.whole and after and after - 1 >= w.own:
            return
        w.drop(after)


def sequences(text: bytes) -> Iterator[tuple[int, bytes]]:
    """(place, sequence) of a FASTA text: lines trimmed, wrapped ones joined, empty records left out."""
    at, begin, now = 0, 0, []
    for line in text.split(b"\n"):
        bare = line.strip(WHITE.encode())
        if bare.startswith(b">"):
            if seq := b"".join(now):
                yield begin, seq
            begin, now = at, []
        else:
            now.append(bare)
        at += len(line) + 1
    if seq := b"".join(now):
        yield begin, seq


def fasta(w: Window, path: str, first: bool) -> Iterator[pa.RecordBatch]:
    """The sequences of the records that begin with > after a line feed of the range's own, or with the file."""
    synced, end, seen = first, False, 0
    while not end:
        end = w.more()
        if not synced:
            k = w.data.find(b"\n>")
            if not 0 <= k < w.own:
                if k >= 0 or w.whole:
                    return
                w.drop(len(w.data) - 1)  # what lies before the first record belongs to another range
                continue
            w.drop(k + 1)
            synced = True
        cuts, k = [0], w.data.find(b"\n>", seen)
        while k >= 0:
            cuts.append(k + 1)
            k = w.data.find(b"\n>", k + 1)
        seen = max(0, len(w.data) - 1)
        if end and w.data:
            cuts.append(len(w.data))
        numbers, seqs = [], []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a and a - 1 >= w.own:
                break
            for place, seq in sequences(bytes(w.data[a:b])):
                numbers.append(a + place)
                seqs.append(seq)
        if seqs:
            yield batch(path, w.number(np.array(numbers, np.int64)), pa.array(seqs, pa.binary()).cast(pa.string()))
        if cuts[-1] and cuts[-1] - 1 >= w.own:
            return
        w.drop(cuts[-1])
        seen = max(0, seen - cuts[-1])


def lines(w: Window, path: str, first: bool) -> Iterator[pa.RecordBatch]:
    """Every line that follows a line feed of the range's own, or begins the file, without its line feed."""
    synced, end = first, False
    while not end:
        end = w.more()
        data = np.frombuffer(bytes(w.data), np.uint8)
        feeds = np.flatnonzero(data == 10)
        if end and len(data) and (not len(feeds) or feeds[-1] != len(data) - 1):
            feeds = np.append(feeds, len(data))
        if not len(feeds):
            continue
        start = np.append(0, feeds[:-1] + 1)
        after = min(int(feeds[-1]) + 1, len(data))
        mine = (start - 1 < w.own) & (synced | (start > 0))
        at = np.flatnonzero(mine)
        if len(at):
            text = pa.StringArray.from_buffers(len(start), pa.py_buffer(np.append(start, after).astype(np.int32)), pa.py_buffer(data))
            yield batch(path, w.number(start[at]), pc.ascii_rtrim(text.take(pa.array(at)), "\n"))
        synced = True
        if w.whole and after - 1 >= w.own:
            return
        w.drop(after)


def sound(p: Piece, opening) -> bool:
    """Whether a gzip file can be unpacked to its end."""
    try:
        with opening(p.path) as f:
            for _ in gzip_chunks(f):
                pass
    except (EOFError, zlib.error):
        return False
    return True


def read_piece(p: Piece, opening=opened, by_lines: bool = False) -> Iterator[pa.RecordBatch]:
    """(file, seq_no, seq) of the records of a piece; seq_no: the number of the byte at which a record begins."""
    from helixtally.sources.fastx import is_fastq, is_gzipped, source_name

    with opening(p.path) as f:
        first, alone = p.start == 0, p.start == 0 and p.end >= p.size
        if not is_gzipped(p.path):
            chunks = plain_chunks(f, p)
        elif member_size(f.read(BLOCK_HEADER)) is not None:
            chunks = member_chunks(f, p)
        elif first:
            f.seek(0)
            chunks, alone = gzip_chunks(f), True
        else:
            return  # the first range reads all of it
        w = Window(chunks)
        if by_lines:
            yield from lines(w, p.path, first)
        else:
            yield from fastq(w, p.path, first, alone) if is_fastq(source_name(p.path)) else fasta(w, p.path, first)


def listed(folder: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change in nanoseconds) of the files of a folder, or of the file itself; not below it."""
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1)) if local_path(folder) is None else (fs.LocalFileSystem(), local_path(folder))
    info = where.get_file_info(name)
    found = where.get_file_info(fs.FileSelector(name)) if info.type == fs.FileType.Directory else [info]
    head = folder[: folder.index("://") + 3] if local_path(folder) is None else "file:"
    return sorted((head + x.path, x.size, int(x.mtime_ns or 0)) for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))


class FastxReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.size, self.by_lines, self.lenient = max(1, int(options.get("splitbytes", RANGE))), options.get("lines") == "true", options.get("unreadable") == "empty"
        self.tasks = max(1, int(options.get("tasks", 1)))
        files = json.loads(options["files"]) if "files" in options else [x[:2] for x in listed(options["path"])]
        self.files = [(p, n) for p, n in files]

    def partitions(self) -> list[Pieces]:
        from helixtally.sources.fastx import is_gzipped

        if not self.lenient:
            return pieces_of(self.files, self.size, self.tasks)
        packed = [x for x in self.files if is_gzipped(x[0])]  # whole, as one range can't tell whether another is sound
        return pieces_of([x for x in self.files if x not in packed], self.size, self.tasks) + [Pieces([Piece(p, 0, n, n)]) for p, n in packed]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        from helixtally.sources.fastx import is_gzipped

        for p in partition.pieces:
            if not (self.lenient and is_gzipped(p.path)) or sound(p, opened):
                yield from read_piece(p, by_lines=self.by_lines)


class FastxStreamReader(DataSourceStreamReader):
    """Files as they arrive in a folder, in the order of their times of change; an offset is the last file's time and path."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.size = options["path"], max(1, int(options.get("splitbytes", RANGE)))

    def initialOffset(self) -> dict:
        return {"time": "0", "path": ""}

    def after(self, offset: dict) -> list[tuple[str, int, int]]:
        return [x for x in listed(self.folder) if (x[2], x[0]) > (int(offset["time"]), offset["path"])]

    def latestOffset(self) -> dict:
        last = max(((t, p) for p, _, t in listed(self.folder)), default=(0, ""))
        return {"time": str(last[0]), "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[Pieces]:
        return pieces_of([(p, n) for p, n, t in self.after(start) if (t, p) <= (int(end["time"]), end["path"])], self.size)

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        for p in partition.pieces:
            yield from read_piece(p)

    def commit(self, end: dict) -> None:
        pass


class Fastx(DataSource):
    """spark.read.format("fastx").load(folder): file, seq_no, seq.

    Options: splitBytes, the bytes of a range; tasks, how many can run at a time, among which small files are dealt; lines (true), for the lines of any files instead of sequences; unreadable
    (empty), for gzip files that are broken to count as empty ones instead of failing.
    """

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastxReader:
        return FastxReader(self.options)

    def streamReader(self, schema) -> FastxStreamReader:
        return FastxStreamReader(self.options)


def sizes(paths: list[str], threads: int = 16) -> list[tuple[str, int]]:
    """The paths with the lengths of their files."""

    def length(path: str) -> int:
        with opened(path) as f:
            return f.seek(0, 2)

    with ThreadPoolExecutor(threads) as pool:
        return list(zip(paths, pool.map(length, paths), strict=True))
