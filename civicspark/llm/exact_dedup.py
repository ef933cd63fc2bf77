"""Exact dedup of new documents against the distinct digests of historical ones, through minimal perfect hashes.

Texts are equal when they are identical without the bytes space, ``\\t \\n \\v \\f \\r``; SHA-256 of the rest stands for them. The
distinct digests of the history are cut into segments of about ``SEGMENT_KEYS``; each has a minimal perfect hash, which gives every
digest of the segment a slot of its own and no slot is empty. A slot holds the full digest, where the winner of
its texts is found and how many they are. New documents are reduced to distinct digests before any shuffle of them, so a text that
fills a third of the table is one row; each is looked up in its segment's hash, and only where all 32 bytes
of the slot are its own it is a repeat and joins the slot's group. The others are no members and are groups of their own.

The winner of a group is the row with the most code points, then of least id (null last), then first in the table as stored.

Defined results: a null text counts as empty, and so does one of those bytes only: all such rows are one group. Rows that repeat id
and text are rows of their own, of which one stays. An empty history, empty new documents or both do no harm.
Texts are digested whole. Columns other than id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.llm.tables import written
from civicspark.llm.words import mixed

#: Distinct digests of a segment, on average; digests are spread evenly, so no segment is much larger.
SEGMENT_KEYS = 1 << 14
#: Bits of a level of the hash for each digest not placed yet.
ROOM = 1.5
_SPACES = " \t\n\x0b\x0c\r"
_ORDER = "struct<less_chars:bigint,no_id:boolean,id:bigint,row:bigint>"
_SEGMENT = "segment int, sizes array<long>, bits binary, digests binary, winners array<" + _ORDER + ">, counts array<long>"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), _SPACES, "")


def digests(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``digest`` of each row and ``place``: less is better. Written, so that rows keep their numbers."""
    place = F.struct(
        (-F.coalesce(F.char_length(F.col(text).cast("string")), F.lit(0)).cast("long")).alias("less_chars"),
        F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"),
    )
    return written(documents.select(F.unhex(F.sha2(normalised(F.col(text)), 256)).alias("digest"), place.alias("place")), "digests")


def groups(rows: DataFrame) -> DataFrame:
    """Distinct digests with their winner and number; reduced in each task before the shuffle."""
    return rows.groupBy("digest").agg(F.min("place").alias("winner"), F.count(F.lit(1)).alias("n"))


# --- the hash of a segment ---

def words(held: bytes | list[bytes]) -> np.ndarray:
    """Digests as rows of four 64-bit numbers."""
    return np.frombuffer(held if isinstance(held, bytes) else b"".join(held), dtype="<u8").reshape(-1, 4)


def _spread(keys: np.ndarray, level: int) -> np.ndarray:
    out = np.full(len(keys), level + 1, dtype=np.uint64)
    for k in range(4):
        out = mixed(keys[:, k] ^ mixed(out))
    return out


def build(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Sizes of the levels, the bits of all levels on end, and each key's slot.

    On a level every key left has one bit; those alone on theirs are placed, the others go on to the next level.
    """
    left, sizes, bits, at = np.arange(len(keys)), [], [], np.zeros(len(keys), dtype=np.int64)
    begin = 0
    while len(left):
        size = max(2, int(len(left) * ROOM))
        place = (_spread(keys[left], len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(place, minlength=size) == 1
        fits = alone[place]
        at[left[fits]] = begin + place[fits]
        left, begin = left[~fits], begin + size
        sizes.append(size)
        bits.append(alone)
    bits = np.concatenate(bits) if bits else np.zeros(0, dtype=bool)
    return sizes, bits, (np.cumsum(bits) - 1)[at] if len(keys) else at


def look_up(keys: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot of each key; a key that was not built in has some slot or -1."""
    rank = np.cumsum(bits) - 1
    slot, left, begin = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        place = begin + (_spread(keys[left], level) % np.uint64(size)).astype(np.int64)
        hit = bits[place]
        slot[left[hit]] = rank[place[hit]]
        left, begin = left[~hit], begin + size
    return slot


def _segment(rows: pd.DataFrame) -> pd.DataFrame:
    keys = words(list(rows["digest"]))
    sizes, bits, slots = build(keys)
    order = np.argsort(slots)
    return pd.DataFrame([{
        "segment": int(rows["segment"].iloc[0]), "sizes": sizes, "bits": np.packbits(bits).tobytes(), "digests": keys[order].tobytes(),
        "winners": [rows["winner"].iloc[k] for k in order], "counts": rows["n"].to_numpy()[order].tolist(),
    }])


def _looked_up(segments: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
    """All groups of a segment: digest, winner and number among the historical and among the new documents."""
    old = segments.iloc[0] if len(segments) else None
    found = np.full(len(new), -1, dtype=np.int64)
    parts = []
    if old is not None:
        held = words(old["digests"])
        if len(new):
            keys = words(list(new["digest"]))
            bits = np.unpackbits(np.frombuffer(old["bits"], dtype=np.uint8), count=int(sum(old["sizes"]))).astype(bool)
            slot = look_up(keys, list(old["sizes"]), bits)
            found = np.where((slot >= 0) & (held[slot] == keys).all(axis=1), slot, -1)
        again = np.full(len(held), -1, dtype=np.int64)
        again[found[found >= 0]] = np.flatnonzero(found >= 0)
        parts += [
            (held[k].tobytes(), old["winners"][k], old["counts"][k], new["winner"].iloc[j] if j >= 0 else None, new["n"].iloc[j] if j >= 0 else 0)
            for k, j in enumerate(again.tolist())
        ]
    parts += [(new["digest"].iloc[k], None, 0, new["winner"].iloc[k], new["n"].iloc[k]) for k in np.flatnonzero(found < 0).tolist()]
    return pd.DataFrame(parts, columns=["digest", "old", "old_n", "new", "new_n"])


@dataclass(frozen=True)
class History:
    """``rows``: digest and place of each historical document. ``segments``: one row for each segment of the hash."""

    rows: DataFrame
    segments: DataFrame
    parts: int


def _in_segment(parts: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(parts)).cast("int").alias("segment")


def build_history(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> History:
    rows = digests(documents, doc_id, text)
    distinct = written(groups(rows), "historical-digests")
    parts = max(1, -(-distinct.count() // SEGMENT_KEYS))
    segments = distinct.withColumn("segment", _in_segment(parts)).groupBy("segment").applyInPandas(_segment, _SEGMENT)
    return History(rows, written(segments, "segments"), parts)


def dedup(history: History, documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each historical and each new document: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``,
    ``historical``, and ``repeat`` (new, and its text was in the history)."""
    new = digests(documents, doc_id, text)
    arrived = groups(new).withColumn("segment", _in_segment(history.parts))
    looked_up = history.segments.groupBy("segment").cogroup(arrived.groupBy("segment")).applyInPandas(
        _looked_up, f"digest binary, old {_ORDER}, old_n long, new {_ORDER}, new_n long"
    )
    # A place is unique among the historical or the new rows only, so a tie of both goes to the history.
    better = F.coalesce(F.col("new") < F.col("old"), F.col("old").isNull()) & (
        F.col("old").isNull() | (F.struct("new.less_chars", "new.no_id", "new.id") != F.struct("old.less_chars", "old.no_id", "old.id"))
    )
    found = written(looked_up.select(
        "digest", (F.col("old_n") + F.col("new_n")).alias("group_size"), (F.col("old_n") > 0).alias("known"), (~better).alias("from_history"),
        F.when(better, F.col("new")).otherwise(F.col("old")).alias("winner"),
    ), "groups")
    rows = history.rows.withColumn("historical", F.lit(True)).unionByName(new.withColumn("historical", F.lit(False)))
    return rows.join(found, "digest").select(
        F.col("place.id").alias("doc_id"), F.col("winner.id").alias("keep_id"), "group_size",
        ((F.col("historical") == F.col("from_history")) & (F.col("place.row") == F.col("winner.row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), "historical", (~F.col("historical") & F.col("known")).alias("repeat"),
    )
