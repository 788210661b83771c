"""Images as a Spark data source: format("raster") reads and writes PNG, BMP and packed trees under a mounted shared folder.

Reads and writes, as tables and as streams. A stream's offset is a frame's number: its place in a ledger, in which the driver
enters each file when it first sees it, whatever its time. Ledgers are segments that are made once and never changed, so
queries may share one, a restarted query reads just what its checkpoint lacks, and a subscriber may start at any frame.

Written pictures are staged first and get their names when the whole job, or the stream's batch, has succeeded; a failed one
leaves none. A stream's batch is entered in a log, and one that is there is not done again.

options: path; errors=keep gives files that aren't images a row with the column `error`, they are skipped otherwise;
frames=true adds the column `frame` to a stream; ledger, a folder (path/_ledger); startingFrame: a number, or `latest`;
maxFilesPerBatch: most files of a batch after a query's first one; filesPerPartition (16).
"""

from __future__ import annotations

import contextlib
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

from tessera.session import ship
from tessera.sources.images import DECODERS, BadImage, decode, encode_bmp, encode_png


@dataclass
class Files(InputPartition):
    paths: list[str]
    first: int = 0


@dataclass
class Staged(WriterCommitMessage):
    names: list[tuple[str, str]]


def image_files(root: str) -> Iterator[str]:
    """Files whose names end like images', without those in folders, or of names, that begin with _ or a dot."""
    for folder, inner, names in os.walk(root):
        inner[:] = sorted(x for x in inner if x[0] not in "_.")
        yield from (os.path.join(folder, f) for f in sorted(names) if f[0] not in "_." and f.rsplit(".", 1)[-1].lower() in DECODERS)


def rows_of(paths: list[str], errors: bool, first: int | None = None) -> Iterator[tuple]:
    """(path, w, h, raw), and error and frame if asked for, of the files."""
    for k, path in enumerate(paths):
        error, px = None, None
        try:
            with open(path, "rb") as f:
                px = decode(path, f.read())
        except (BadImage, OSError) as e:
            if not errors:
                continue
            error = str(e)
        row = (path, None, None, None) if px is None else (path, px.shape[1], px.shape[0], np.ascontiguousarray(px[:, :, :3]).tobytes())
        yield row + (error,) * errors + ((first + k,) if first is not None else ())


class Reader(DataSourceReader):
    def __init__(self, root: str, errors: bool, each: int):
        self.root, self.errors, self.each = root, errors, each

    def partitions(self):
        found = list(image_files(self.root))
        return [Files(found[k : k + self.each]) for k in range(0, len(found), self.each)] or [Files([])]

    def read(self, partition):
        return rows_of(partition.paths, self.errors)


class Ledger:
    """The files in the order in which they were first seen. A segment is named by its first number and is made at once, by a link."""

    def __init__(self, folder: str):
        self.folder, self.paths, self.known = folder, [], set()
        os.makedirs(folder, exist_ok=True)

    def refresh(self) -> None:
        while True:
            name = os.path.join(self.folder, f"{len(self.paths):012d}.json")
            try:
                with open(name) as f:
                    more = json.load(f)
            except FileNotFoundError:
                return
            self.paths += more
            self.known.update(more)

    def enter(self, files: Iterator[str]) -> None:
        self.refresh()
        while new := [f for f in files if f not in self.known]:
            name, draft = os.path.join(self.folder, f"{len(self.paths):012d}.json"), os.path.join(self.folder, f".{uuid.uuid4().hex}")
            with open(draft, "w") as f:
                json.dump(new, f)
                f.flush()
                os.fsync(f.fileno())
            with contextlib.suppress(FileExistsError):  # another query was first: its segment counts
                os.link(draft, name)
            os.unlink(draft)
            self.refresh()
            files = iter(new)


class StreamReader(DataSourceStreamReader):
    def __init__(self, root: str, ledger: str, start: str, most: int | None, each: int, errors: bool, frames: bool):
        self.root, self.start, self.most, self.each, self.errors, self.frames = root, start, most, each, errors, frames
        self.folder, self.at = ledger, None

    def _ledger(self) -> Ledger:
        if not hasattr(self, "ledger"):
            self.ledger = Ledger(self.folder)
        return self.ledger

    def initialOffset(self):
        if self.start != "latest":
            return {"frame": int(self.start)}
        self._ledger().enter(image_files(self.root))
        return {"frame": len(self.ledger.paths)}

    def latestOffset(self):
        self._ledger().enter(image_files(self.root))
        end = len(self.ledger.paths)
        if self.at is not None and self.most:
            end = min(end, self.at + self.most)
        self.at = max(end, self.at or 0)
        return {"frame": self.at}

    def partitions(self, start, end):
        self._ledger().refresh()
        self.at = max(self.at or 0, end["frame"])
        return [Files(self.ledger.paths[k : min(k + self.each, end["frame"])], k) for k in range(start["frame"], end["frame"], self.each)]

    def read(self, partition):
        return rows_of(partition.paths, self.errors, partition.first if self.frames else None)

    def commit(self, end):
        pass


class Staging:
    """Pictures written under names of their own in a folder of the job's own, until they are all there.

    The driver makes the folder, tasks don't: one that still runs when the job has ended finds none, and leaves nothing.
    """

    def __init__(self, root: str, job: str | None = None):
        self.root, self.folder = root, os.path.join(root, "_staging", job or uuid.uuid4().hex)
        os.makedirs(self.folder, exist_ok=True)

    def write(self, rows):
        names: list[tuple[str, str]] = []
        try:
            for r in rows:
                px = np.frombuffer(bytes(r.raw), np.uint8).reshape(r.h, r.w, 3)
                name = os.path.basename(r.path)
                staged = os.path.join(self.folder, f"{uuid.uuid4().hex}-{name}")
                names.append((staged, os.path.join(self.root, name)))
                with open(staged, "wb") as f:
                    f.write(encode_bmp(px) if name.lower().endswith(".bmp") else encode_png(px))
        except BaseException:
            self.drop([Staged(names)])
            raise
        return Staged(names)

    def publish(self, messages) -> list[str]:
        done = []
        for staged, name in (n for m in messages if m is not None for n in m.names):
            os.replace(staged, name)
            done.append(name)
        return done

    def drop(self, messages) -> None:
        for staged, _ in (n for m in messages if m is not None for n in m.names):
            with contextlib.suppress(FileNotFoundError):
                os.unlink(staged)

    def end(self) -> None:
        """Nothing more is written: what tasks that failed, or are still ending, have left goes with the folder."""
        # by another name no task adds to it while it is emptied
        gone = f"{self.folder}-ended"
        with contextlib.suppress(FileNotFoundError):
            os.rename(self.folder, gone)
        shutil.rmtree(gone, ignore_errors=True)


class Writer(DataSourceWriter):
    def __init__(self, root: str):
        self.staging = Staging(root)

    def write(self, rows):
        return self.staging.write(rows)

    def commit(self, messages):
        self.staging.publish(messages)
        self.staging.end()

    def abort(self, messages):
        self.staging.end()


class StreamWriter(DataSourceStreamWriter):
    """A batch's pictures appear when it is committed; the log then has their names, and a batch that it has is not done again."""

    def __init__(self, root: str, job: str | None = None):
        self.root, self.staging = root, Staging(root, job)

    def write(self, rows):
        return self.staging.write(rows)

    def commit(self, messages, batchId):
        log = os.path.join(self.root, "_log", f"{batchId:012d}.json")
        if os.path.exists(log):
            self.staging.drop(messages)
            return
        done = self.staging.publish(messages)
        os.makedirs(os.path.dirname(log), exist_ok=True)
        with open(f"{log}.part", "w") as f:
            json.dump(done, f)
        os.replace(f"{log}.part", log)

    def abort(self, messages, batchId):
        self.staging.end()


class Raster(DataSource):
    @classmethod
    def name(cls):
        return "raster"

    def _flag(self, name: str, value: str) -> bool:
        return (self.options.get(name) or "").lower() == value

    def schema(self):
        return "path string, w int, h int, raw binary" + ", error string" * self._flag("errors", "keep") + ", frame long" * self._flag("frames", "true")

    def reader(self, schema):
        return Reader(self.options["path"], self._flag("errors", "keep"), int(self.options.get("filesPerPartition") or 16))

    def streamReader(self, schema):
        o = self.options
        most = o.get("maxFilesPerBatch")
        return StreamReader(o["path"], o.get("ledger") or os.path.join(o["path"], "_ledger"), o.get("startingFrame") or "0", int(most) if most else None, int(o.get("filesPerPartition") or 16), self._flag("errors", "keep"), self._flag("frames", "true"))

    def writer(self, schema, overwrite):
        return Writer(self.options["path"])

    def streamWriter(self, schema, overwrite):
        # Spark makes this object and the writer anew for tasks, commit and abort: by the query's checkpoint they have one folder
        place = self.options.get("checkpointLocation")
        return StreamWriter(self.options["path"], place and uuid.uuid5(uuid.NAMESPACE_URL, place).hex)


def register(spark: SparkSession) -> None:
    ship(spark).dataSource.register(Raster)
