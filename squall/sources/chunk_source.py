"""Real-time chunks as a streaming source: ``readStream.format("squall_chunks")``.

Chunks are files root/SITE/slot/yyyymmdd-hhmmss-nnn-T; slots 1 to 999 are written round and
round.  A site's place in the stream is the newest ``TRACKED`` volumes with the sequences that
were there: a chunk of theirs that comes late, or out of order, is given once it is there.  Older
volumes are closed.  The planner lists; executors read the bytes.

Where a site begins ("start"): "latest" joins its newest volume at the newest chunk, with the
start chunk besides, as that holds the pattern; "earliest" takes everything that is there.  A site
that appears later begins with its newest volume, whole.

Defined results: a folder without sites gives an empty stream that looks again; names that are no
chunk names are passed over; a slot that still holds an older round isn't new; several sites are
independent.  No chunk comes twice, and none of a tracked volume is left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from squall.shipping import ship
from squall.sources import stores

#: Volumes per site whose late chunks are still taken.
TRACKED = 2
#: Files of a partition.
FILES = 64
SCHEMA = "site string, volume int, name string, prefix string, sequence int, chunk_type string, upload_ms long, data binary"
_NAME = re.compile(r"(\d{8}-\d{6})-(\d{3})-([SIE])$")
_KINDS = {"S": "Start", "I": "Intermediate", "E": "End"}


def spans(numbers) -> str:
    """Sequences as text: 1-7,9"""
    out: list[list[int]] = []
    for n in sorted(numbers):
        if out and n == out[-1][1] + 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    return ",".join(f"{a}-{b}" if a < b else str(a) for a, b in out)


def numbers(text: str) -> set[int]:
    out: set[int] = set()
    for part in filter(None, text.split(",")):
        a, _, b = part.partition("-")
        out.update(range(int(a), int(b or a) + 1))
    return out


def last_in_rounds(values: list, value) -> int | None:
    """Where the greatest value of a sequence stands that rises but for one drop; value(x) may be None for a hole."""
    at = [k for k in range(len(values))]
    while at and value(values[at[0]]) is None:
        at.pop(0)
    if not at:
        return None
    first, low, high = value(values[at[0]]), 0, len(at) - 1  # at[low] belongs to the first, rising part
    while low < high:
        middle = (low + high + 1) // 2
        probe = middle
        while probe <= high and value(values[at[probe]]) is None:  # holes take what follows them
            probe += 1
        if probe <= high and value(values[at[probe]]) >= first:
            low = probe
        else:
            high = middle - 1
    return at[low]


@dataclass
class Chunks(InputPartition):
    """Some chunks of one volume."""

    site: str
    volume: int
    names: list[str]


class ChunkFolder:
    """A root of sites, listed."""

    def __init__(self, path: str):
        self.files, self.base = stores.store(path.rstrip("/"))

    def sites(self) -> list[str]:
        return stores.folder_names(self.files, self.base)

    def slots(self, site: str) -> list[int]:
        return sorted(int(x) for x in stores.folder_names(self.files, f"{self.base}/{site}") if x.isdigit())

    def chunks(self, site: str, volume: int) -> dict[str, dict[int, str]]:
        """Of one slot: sequences with their names, by the time of their volume."""
        out: dict[str, dict[int, str]] = {}
        for name in stores.file_names(self.files, f"{self.base}/{site}/{volume}"):
            m = _NAME.match(name)
            if m:
                out.setdefault(m[1], {})[int(m[2])] = name
        return out

    def newest(self, site: str) -> int | None:
        """The slot of the newest volume: looked for in few listings, as the slots are written in rounds."""
        slots, seen = self.slots(site), {}

        def time(slot):
            if slot not in seen:
                seen[slot] = max(self.chunks(site, slot), default=None)
            return seen[slot]

        k = last_in_rounds(slots, time)
        return None if k is None else slots[k]

    def volumes(self, site: str, count: int | None = None, after: str = "") -> list[tuple[str, int, dict[int, str]]]:
        """(time, slot, chunks) from the newest volume back, in order of time: so many, or all that are as new as that time."""
        slots, top = self.slots(site), self.newest(site)
        out: list = []
        if top is not None:
            k = slots.index(top)
            for slot in slots[k::-1] + slots[:k:-1]:
                held = self.chunks(site, slot)
                # a slot may hold two rounds while it is written anew
                found = [(prefix, slot, chunks) for prefix, chunks in held.items() if prefix >= after]
                out += sorted(found, reverse=True)
                if (held and not found) or (count is not None and len(out) >= count):
                    break
        return sorted(out[:count] if count is not None else out, key=lambda x: x[:2])


class ChunkStreamReader(DataSourceStreamReader):
    """Offsets: {"start": ..., "sites": {site: {"time slot": "1-7,9"}}} of the tracked volumes."""

    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("squall_chunks needs a path")
        self.path, self.start = options["path"], options.get("start", "latest")
        if self.start not in ("latest", "earliest"):
            raise ValueError(f"start is latest or earliest, not {self.start}")
        self.only = [x.strip() for x in options.get("sites", "").split(",") if x.strip()]

    def _sites(self, folder: ChunkFolder) -> list[str]:
        there = folder.sites()
        return [x for x in there if x in self.only] if self.only else there

    def initialOffset(self) -> dict:
        folder, sites = ChunkFolder(self.path), {}
        if self.start == "latest":
            for site in self._sites(folder):
                for prefix, slot, chunks in folder.volumes(site, 1):
                    passed = set(range(2, max(chunks)))  # the newest is still to come, and the start
                    sites[site] = {f"{prefix} {slot}": spans(passed)}
        return {"start": self.start, "sites": sites}

    def latestOffset(self) -> dict:
        folder = ChunkFolder(self.path)

        def place(site):
            return site, {f"{prefix} {slot}": spans(chunks) for prefix, slot, chunks in folder.volumes(site, TRACKED)}

        with ThreadPoolExecutor(16) as pool:
            return {"start": self.start, "sites": {site: held for site, held in pool.map(place, self._sites(folder)) if held}}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        folder, out = ChunkFolder(self.path), []
        for site, held in sorted(end["sites"].items()):
            before = start["sites"].get(site)
            if before == held:
                continue
            if before is None and start["start"] == "latest":
                after = max(held)  # a new site: its newest volume
            else:
                after = min(before) if before else ""
            for prefix, slot, chunks in folder.volumes(site, after=after.split(" ")[0]):
                key = f"{prefix} {slot}"
                if key > max(held) or key < after:
                    continue
                # Of tracked volumes what the offset says; of those that went by since, all that is there.
                wanted = numbers(held[key]) if key in held else set(chunks)
                wanted -= numbers((before or {}).get(key, ""))
                names = [chunks[n] for n in sorted(wanted) if n in chunks]
                out += [Chunks(site, slot, names[i : i + FILES]) for i in range(0, len(names), FILES)]
        return out

    def read(self, partition: Chunks) -> Iterator:
        import pyarrow as pa

        folder = ChunkFolder(self.path)
        for name in partition.names:
            path = f"{folder.base}/{partition.site}/{partition.volume}/{name}"
            info = folder.files.get_file_info(path)
            m = _NAME.match(name)
            columns = [[partition.site], [partition.volume], [name], [m[1]], [int(m[2])], [_KINDS[m[3]]], [stores.modified_ms(info)], [stores.read(folder.files, path)]]
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    def commit(self, end: dict) -> None:
        pass


class ChunkSource(DataSource):
    """Options: path (the root), start (latest or earliest), sites (comma-separated; all)."""

    @classmethod
    def name(cls) -> str:
        return "squall_chunks"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ChunkStreamReader:
        return ChunkStreamReader(self.options)


def chunk_stream(spark: SparkSession, path: str, start: str = "latest", sites: list[str] | None = None):
    """The stream of a root's chunks (SCHEMA)."""
    ship(spark).dataSource.register(ChunkSource)
    reader = spark.readStream.format("squall_chunks").option("path", path).option("start", start)
    return (reader.option("sites", ",".join(sites)) if sites else reader).load()
