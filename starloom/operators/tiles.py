"""The tile pyramid: stars by brightness rank, cut into squares level by level, and their packed form."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import brightness
from ..staging import ranked

LEVEL0_STARS, MAX_LEVEL = 2000, 6
PART_STARS = 1 << 16
#: Format of a tile file (fixed values): magic, version; a record is id, x, y, brightness, little-endian.
MAGIC, VERSION, HEADER_BYTES, RECORD_BYTES = b"LYST", 1, 16, 16


def stars(positions: DataFrame, prominence: DataFrame) -> DataFrame:
    """(artist_id, x, y, brightness): brightness is the square root of the share in the greatest weight."""
    rows = positions.join(prominence.select("artist_id", F.col("weight").cast("float").alias("weight")), "artist_id", "left")
    most = prominence.agg(F.greatest(F.coalesce(F.max(F.col("weight").cast("float")), F.lit(0.0).cast("float")), F.lit(1.1754944e-38).cast("float")).alias("most"))
    light = brightness(F.coalesce("weight", F.lit(0.0).cast("float")), F.col("most"))
    return rows.join(F.broadcast(most)).select("artist_id", F.col("x").cast("float").alias("x"), F.col("y").cast("float").alias("y"), light.alias("brightness"))


def bounds(stars: DataFrame) -> DataFrame:
    """One row (min_x, min_y, span): the square around all stars, two per cent wider; without stars from -1 to 1."""
    half = F.greatest(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")) / F.lit(2.0).cast("float"), F.lit(0.001).cast("float"))
    half = (half.cast("float") * F.lit(1.02).cast("float")).cast("float")
    middle = lambda c: ((F.min(c) + F.max(c)) / F.lit(2.0).cast("float")).cast("float")
    b = stars.agg(middle("x").alias("cx"), middle("y").alias("cy"), half.alias("half"))
    one = F.lit(1.0).cast("float")
    return b.select(F.coalesce(F.col("cx") - F.col("half"), -one).alias("min_x"), F.coalesce(F.col("cy") - F.col("half"), -one).alias("min_y"), F.coalesce(F.col("half") * F.lit(2.0).cast("float"), one + one).alias("span"))


def tile_of(value: Column, least: Column, span: Column, level: Column) -> Column:
    """Column or row of a coordinate at a level, clamped to the level's tiles; single-precision steps."""
    side = F.call_function("shiftleft", F.lit(1), level)
    at = F.floor((((value - least) / span).cast("float") * side.cast("float")).cast("float")).cast("int")
    return F.least(F.greatest(at, F.lit(0)), side - 1)


def stars_at(level: Column, level0: int = LEVEL0_STARS) -> Column:
    return F.lit(level0).cast("bigint") * F.call_function("shiftleft", F.lit(1).cast("bigint"), 2 * level)


def last_level(n: int, level0: int = LEVEL0_STARS, most: int = MAX_LEVEL) -> int:
    """The first level that admits all n stars, or `most`."""
    return next((k for k in range(most) if level0 << 2 * k >= n), most)


def pyramid(stars: DataFrame, level0: int = LEVEL0_STARS, most: int = MAX_LEVEL) -> DataFrame:
    """(level, col, row, rank, artist_id, x, y, brightness): each star at every level from the first that admits it.
    The sky's square travels as one broadcast row."""
    rows = ranked(stars, F.desc("brightness"), F.asc("artist_id"))
    last = last_level(rows.count(), level0, most)
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("level")).where(F.col("rank") <= stars_at(F.col("level"), level0))
    rows = rows.join(F.broadcast(bounds(stars)))
    return rows.select("level", tile_of(F.col("x"), F.col("min_x"), F.col("span"), F.col("level")).alias("col"), tile_of(F.col("y"), F.col("min_y"), F.col("span"), F.col("level")).alias("row"), "rank", "artist_id", "x", "y", "brightness")


def records(tiles: DataFrame) -> DataFrame:
    """(level, col, row, rank, record): each star's packed record in hex."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kind = np.dtype([("id", "<i4"), ("x", "<f4"), ("y", "<f4"), ("b", "<f4")])
        for f in frames:
            out = np.zeros(len(f), kind)
            out["id"], out["x"], out["y"], out["b"] = f["artist_id"], f["x"], f["y"], f["brightness"]
            yield f[["level", "col", "row", "rank"]].assign(record=[r.tobytes().hex() for r in out])

    return tiles.mapInPandas(pack, "level int, col int, row int, rank bigint, record string")


def files(tiles: DataFrame, part_stars: int = PART_STARS) -> DataFrame:
    """(path, part, stars, content): a tile's file in parts of at most `part_stars` stars, brightest first; the contents
    of a path in the order of parts make the file, and most tiles are of one part. A part is a range of ranks, so that
    no task gathers a tile that holds very many stars. stars counts the part's own; the head counts the tile's."""
    place = ["level", "col", "row"]
    rows = records(tiles).withColumn("part", F.floor((F.col("rank") - 1) / part_stars).cast("int"))
    parts = rows.groupBy(*place, "part").agg(F.sort_array(F.collect_list(F.struct("rank", "record"))).alias("r"))
    parts = parts.select(*place, "part", F.size("r").alias("stars"), F.array_join(F.transform("r", lambda x: x["record"]), "").alias("body"))
    sums = tiles.groupBy(*place).agg(F.count(F.lit(1)).cast("int").alias("all"), F.min(F.floor((F.col("rank") - 1) / part_stars).cast("int")).alias("first"))
    rows = parts.join(sums, place)
    le = lambda n, size: F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(n), 2 * size, "0"), F.lit("(..)"), F.lit(1))), "")
    head = F.concat(F.lit(MAGIC.hex()), le(F.lit(VERSION), 2), le(F.col("level"), 1), F.lit("00"), le(F.col("all"), 4), F.lit("00000000"))
    content = F.unhex(F.concat(F.when(F.col("part") == F.col("first"), head).otherwise(""), "body"))
    return rows.select(F.format_string("%d/%d/%d.bin", *place).alias("path"), "part", "stars", content.alias("content"))


def level_for(share: float, most: int = MAX_LEVEL) -> int:
    """The level whose tiles are about as wide as the share of the sky that is in view."""
    return max(0, min(most, math.floor(math.log2(1 / max(share, 1e-6)) + 0.5)))


def decode(content: bytes) -> np.ndarray:
    """Records of a tile file; raises if it isn't one."""
    n = int.from_bytes(content[8:12], "little")
    if content[:4] != MAGIC or len(content) != HEADER_BYTES + n * RECORD_BYTES:
        raise ValueError("no tile file of this version")
    return np.frombuffer(content, np.dtype([("id", "<i4"), ("x", "<f4"), ("y", "<f4"), ("brightness", "<f4")]), offset=HEADER_BYTES)
