"""Column functions for archive and real-time object names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chunk types and their one-letter names.
CHUNK_TYPES = {"S": "Start", "I": "Intermediate", "E": "End"}
LAST_VOLUME = 999


def archive_site(name: Column) -> Column:
    return F.when(F.length(name) >= 4, F.substring(name, 1, 4))


def archive_time(name: Column) -> Column:
    """Time in ``SITEyyyymmdd_hhmmss…``; null if it does not parse."""
    digits = F.concat(F.substring(name, 5, 8), F.substring(name, 14, 6))
    return F.when(digits.rlike("^[0-9]{14}$"), F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss")))


def archive_key(name: Column) -> Column:
    """Object key: year/month/day/site/name."""
    return F.concat_ws("/", F.substring(name, 5, 4), F.substring(name, 9, 2), F.substring(name, 11, 2), F.substring(name, 1, 4), name)


def chunk_name(prefix: Column, sequence: Column, letter: Column) -> Column:
    """``yyyymmdd-hhmmss-nnn-T`` of a time, a sequence and a type letter."""
    return F.concat_ws("-", F.date_format(prefix, "yyyyMMdd-HHmmss"), F.lpad(sequence.cast("string"), 3, "0"), letter)


def parse_chunk_name(name: Column) -> dict[str, Column]:
    """prefix time, sequence and type of a chunk name, each null where it does not parse; is_valid: all do."""
    long_enough = F.length(name) >= 20
    date = F.substring(name, 1, 15)
    prefix = F.when(long_enough & date.rlike("^[0-9]{8}-[0-9]{6}$"), F.try_to_timestamp(date, F.lit("yyyyMMdd-HHmmss")))
    number = F.substring(name, 17, 3)
    sequence = F.when(long_enough & number.rlike("^[0-9]+$"), number.cast("int"))
    kind = F.when(long_enough, F.element_at(F.create_map(*[F.lit(x) for pair in CHUNK_TYPES.items() for x in pair]), F.substring(name, -1, 1)))
    return {"prefix_time": prefix, "sequence": sequence, "chunk_type": kind, "is_valid": prefix.isNotNull() & sequence.isNotNull() & kind.isNotNull()}


def next_volume(volume: Column) -> Column:
    """Slots 1 to 999, round and round."""
    return volume % LAST_VOLUME + 1


def next_chunk(sequence: Column, final_sequence: Column) -> dict[str, Column]:
    """What follows a chunk: the next sequence with its type letter, or the next volume."""
    done = sequence == final_sequence
    after = F.when(~done, sequence + 1)
    return {"next_volume": done, "next_sequence": after, "next_type": F.when(after == final_sequence, "E").when(after.isNotNull(), "I")}
