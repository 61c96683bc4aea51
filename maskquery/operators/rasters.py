"""Operators on tile tables.

A tile row is ``(section_id, band, y0, x0, h, w, channels, data)`` with ``data`` the channel-first uint8 bytes. Work is
keyed by tile or patch, both of fixed size; NumPy runs on one tile or patch at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskquery.functions.scalars import hann, hash_unit

TILE_SCHEMA = "section_id int, band string, y0 int, x0 int, h int, w int, channels int, data binary"


def pack_u8(values: Column) -> Column:
    """Array of 0..255 integers as bytes."""
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), ""))


def to_long(tiles: DataFrame) -> DataFrame:
    """One row ``(section_id, band, channel, y, x, v)`` per tile pixel."""
    schema = "section_id int, band string, channel int, y int, x int, v int"

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                a = np.frombuffer(r["data"], np.uint8)
                c, y, x = np.unravel_index(np.arange(a.size), (r["channels"], r["h"], r["w"]))
                n = a.size
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.repeat(pa.scalar(r["section_id"], pa.int32()), n),
                        pa.repeat(pa.scalar(r["band"], pa.string()), n),
                        pa.array(c.astype(np.int32)),
                        pa.array((y + r["y0"]).astype(np.int32)),
                        pa.array((x + r["x0"]).astype(np.int32)),
                        pa.array(a.astype(np.int32)),
                    ],
                    names=["section_id", "band", "channel", "y", "x", "v"],
                )

    return tiles.select("section_id", "band", "y0", "x0", "h", "w", "channels", "data").mapInArrow(expand, schema)


def read_window(tiles: DataFrame, left: int, top: int, right: int, bottom: int, shift: bool = True) -> DataFrame:
    """Part of every section inside a pixel window, origin moved to the window's corner.

    Tiles outside are pruned by the scan; tiles on the border are trimmed. A window that meets no tile of any section
    is an error.
    """
    left, top = max(left, 0), max(top, 0)
    if left >= right or top >= bottom:
        raise ValueError("an empty window, or one left of or above the image")
    hit = tiles.where(
        (F.col("x0") < right) & (F.col("y0") < bottom) & (F.col("x0") + F.col("w") > left) & (F.col("y0") + F.col("h") > top)
    )
    if hit.isEmpty():
        raise ValueError("the window meets no tile")
    dx, dy = (left, top) if shift else (0, 0)

    def trim(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for r in pdf.itertuples(index=False):
                a = np.frombuffer(r.data, np.uint8).reshape(r.channels, r.h, r.w)
                ya, yb, xa, xb = max(top, r.y0), min(bottom, r.y0 + r.h), max(left, r.x0), min(right, r.x0 + r.w)
                part = a[:, ya - r.y0 : yb - r.y0, xa - r.x0 : xb - r.x0]
                rows.append((r.section_id, r.band, ya - dy, xa - dx, yb - ya, xb - xa, r.channels, part.tobytes()))
            yield pd.DataFrame(rows, columns=list(pdf.columns))

    cols = [c.split(" ")[0] for c in TILE_SCHEMA.split(", ")]
    return hit.select(*cols).mapInPandas(trim, TILE_SCHEMA)


def misaligned(tiles: DataFrame, bands: int) -> DataFrame:
    """Tile positions where a band is absent or bands differ in shape."""
    shape = F.struct("h", "w", "channels")
    g = tiles.groupBy("section_id", "y0", "x0").agg(F.count(F.lit(1)).alias("bands"), (F.min(shape) != F.max(shape)).alias("mixed"))
    return g.where((F.col("bands") != bands) | F.col("mixed"))


def align_bands(tiles: DataFrame, bands: int) -> DataFrame:
    """All tiles, once it is sure that every position has each of the ``bands`` bands in one shape; the first that has not is an error."""
    bad = misaligned(tiles, bands).first()
    if bad is not None:
        raise ValueError(f"section {bad['section_id']}, tile at y {bad['y0']}, x {bad['x0']}: {bad['bands']} of {bands} bands" + (" of differing shapes" if bad["mixed"] else ""))
    return tiles


def screen_blend(tiles: DataFrame, band: str = "blend") -> DataFrame:
    """Screen blend of all bands of a tile in band order, in single precision; whole numbers are truncated."""

    def blend(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("band")
        keep = np.float32(1)
        for d in pdf["data"]:
            keep = keep * (np.float32(1) - np.frombuffer(d, np.uint8).astype(np.float32) / np.float32(255))
        out = np.clip((np.float32(1) - keep) * np.float32(255), 0, 255).astype(np.uint8)
        first = pdf.iloc[:1].copy()
        first["band"], first["data"] = band, [out.tobytes()]
        return first

    cols = [c.split(" ")[0] for c in TILE_SCHEMA.split(", ")]
    return tiles.select(*cols).groupBy("section_id", "y0", "x0").applyInPandas(blend, TILE_SCHEMA)


def stack_channels(tiles: DataFrame, band: str = "stack") -> DataFrame:
    """All bands of a tile as one channel-first payload, in band order."""
    g = tiles.groupBy("section_id", "y0", "x0", "h", "w").agg(
        F.array_sort(F.collect_list(F.struct("band", "channels", "data"))).alias("b")
    )
    data = F.aggregate("b", F.lit(b""), lambda a, e: F.concat(a, e["data"]))
    count = F.aggregate("b", F.lit(0), lambda a, e: a + e["channels"])
    return g.select("section_id", F.lit(band).alias("band"), "y0", "x0", "h", "w", count.alias("channels"), data.alias("data"))


def split_channels(tiles: DataFrame, group: int = 3) -> DataFrame:
    """A stacked payload as tiles of ``group`` channels named ``<band>_000`` and so on; must divide evenly."""
    ok = (F.col("channels") > 0) & (F.col("channels") % group == 0)
    n = F.when(ok, F.col("channels") / group).otherwise(F.raise_error(F.lit(f"channels must be a multiple of {group}")).cast("double"))
    t = tiles.select("*", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("i"))
    size = F.col("h") * F.col("w") * group
    return t.select(
        "section_id", F.format_string("%s_%03d", F.col("band"), F.col("i")).alias("band"), "y0", "x0", "h", "w", F.lit(group).alias("channels"),
        F.substring(F.col("data"), F.col("i") * size + 1, size).alias("data"),
    )


def extract_patches(tiles: DataFrame, patches: DataFrame, patch: int, tile: int) -> DataFrame:
    """Zero-padded ``patch`` x ``patch`` crops, one row per patch and band of its section, also where no tile lies.

    ``patches`` has ``(section_id, stem, y0, y1, x0, x1)``; tiles lie on a ``tile`` grid. A patch looks up the grid
    cells it touches, so the join key is a tile position and never a section. A patch of a section without tiles is an
    error, as nothing tells its bands.
    """
    cells = lambda a, b: F.sequence(F.floor(F.col(a) / tile), F.floor((F.col(b) - 1) / tile))
    want = patches.select(
        "section_id", "stem", F.col("y0").alias("py0"), F.col("y1").alias("py1"), F.col("x0").alias("px0"), F.col("x1").alias("px1"), F.explode(cells("y0", "y1")).alias("ty")
    ).select("*", F.explode(cells("px0", "px1")).alias("tx"))
    have = tiles.select(
        "section_id", "band", "y0", "x0", "h", "w", "channels", "data", F.floor(F.col("y0") / tile).alias("ty"), F.floor(F.col("x0") / tile).alias("tx")
    )

    def assemble(pdf: pd.DataFrame) -> pd.DataFrame:
        r0 = pdf.iloc[0]
        out = np.zeros((int(r0.channels), patch, patch), np.uint8)
        for r in pdf.itertuples(index=False):
            a = np.frombuffer(r.data, np.uint8).reshape(r.channels, r.h, r.w)
            ya, yb, xa, xb = max(r.py0, r.y0), min(r.py1, r.y0 + r.h), max(r.px0, r.x0), min(r.px1, r.x0 + r.w)
            if ya < yb and xa < xb:
                out[:, ya - r.py0 : yb - r.py0, xa - r.px0 : xb - r.px0] = a[:, ya - r.y0 : yb - r.y0, xa - r.x0 : xb - r.x0]
        return pd.DataFrame(
            [(r0.section_id, r0.band, r0.stem, r0.py0, r0.px0, patch, patch, int(r0.channels), out.tobytes())],
            columns=["section_id", "band", "stem", "y0", "x0", "h", "w", "channels", "data"],
        )

    schema = "section_id int, band string, stem string, y0 int, x0 int, h int, w int, channels int, data binary"
    bands = tiles.groupBy("section_id", "band").agg(F.max("channels").alias("channels"))
    known = patches.join(bands, "section_id", "left")
    known = known.withColumn("band", F.coalesce("band", F.raise_error(F.concat(F.lit("no tile in section "), F.col("section_id").cast("string")))))
    blank = known.select(  # a tile of no extent for each patch and band
        "section_id", "stem", F.col("y0").alias("py0"), F.col("y1").alias("py1"), F.col("x0").alias("px0"), F.col("x1").alias("px1"),
        "band", F.lit(0).alias("y0"), F.lit(0).alias("x0"), F.lit(0).alias("h"), F.lit(0).alias("w"), "channels", F.lit(b"").alias("data"),
    )
    met = want.join(have, ["section_id", "ty", "tx"]).select(*blank.columns)
    return met.unionByName(blank).groupBy("section_id", "stem", "band").applyInPandas(assemble, schema)



def augment(patches: DataFrame, key: str, seed: int) -> DataFrame:
    """Joint random flips and quarter turns of images and labels, and brightness and contrast per image.

    ``patches`` has ``(key, size, image, label)`` with float and int arrays in row-major order. All draws come from
    the seeded digest of the key, so a rerun of a lost task repeats them.
    """
    draw = lambda name: hash_unit(F.col(key), f"{seed}_{name}").alias(name)
    drawn = patches.select(key, "size", "image", "label", *[draw(n) for n in ("lr", "ud", "rot", "bright", "contrast")])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            imgs, labs = [], []
            for r in pdf.itertuples(index=False):
                pair = [np.asarray(v).reshape(r.size, r.size) for v in (r.image, r.label)]
                if r.lr < 0.5:
                    pair = [np.fliplr(v) for v in pair]
                if r.ud < 0.5:
                    pair = [np.flipud(v) for v in pair]
                pair = [np.rot90(v, k=int(r.rot * 4)) for v in pair]
                img = pair[0] + (r.bright * 0.4 - 0.2)
                mean = img.mean()
                img = (img - mean) * (0.8 + r.contrast * 0.4) + mean
                imgs.append(np.clip(img, 0.0, 1.0).ravel())
                labs.append(pair[1].ravel())
            yield pd.DataFrame({key: pdf[key], "size": pdf["size"], "image": imgs, "label": labs})

    key_type = patches.schema[key].dataType.simpleString()
    return drawn.mapInPandas(run, f"{key} {key_type}, size int, image array<double>, label array<int>")


def stitch_predictions(probs: DataFrame, window: int, floor: float = 1e-4) -> DataFrame:
    """Hann-weighted mean of overlapping window predictions per pixel and class.

    ``probs`` has ``(sample_id, y0, x0, y, x, cls, p)``. Sums are partial per task, keyed by pixel.
    """
    w = F.greatest(hann(F.col("y") - F.col("y0"), window) * hann(F.col("x") - F.col("x0"), window), F.lit(floor))
    return probs.groupBy("sample_id", "y", "x", "cls").agg((F.sum(F.col("p") * w) / F.sum(w)).alias("p"))


def argmax_class(probs: DataFrame) -> DataFrame:
    """Most probable class per pixel, the lowest on ties."""
    top = F.max_by("cls", F.struct("p", (-F.col("cls")).alias("c")))
    return probs.groupBy("sample_id", "y", "x").agg(top.alias("cls"))


def score_windows(windows: DataFrame, make_predict_fn: Callable, batch_size: int, size: int, classes: int, channels: int = 1) -> DataFrame:
    """Apply a user's model to window payloads ``image`` (float array); the model is built once per worker.

    ``make_predict_fn`` returns a function from a batch ``(n, channels * size * size)`` to ``(n, classes * size * size)``.
    """
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, DoubleType

    fn = predict_batch_udf(
        make_predict_fn, return_type=ArrayType(DoubleType()), batch_size=batch_size, input_tensor_shapes=[[channels * size * size]]
    )
    scored = windows.withColumn("scores", fn(F.col("image")))
    keep = [c for c in windows.columns if c != "image"]
    long = scored.select(*keep, F.posexplode("scores").alias("i", "p"))
    return long.select(
        *keep,
        (F.floor(F.col("i") / (size * size))).cast("int").alias("cls"),
        (F.col("y0") + F.floor(F.col("i") % (size * size) / size)).cast("int").alias("y"),
        (F.col("x0") + F.col("i") % size).cast("int").alias("x"),
        "p",
    )


def overlay_pixels(image: DataFrame, labels: DataFrame) -> DataFrame:
    """RGB overlay of labels on grey pixels: 45 % image and 55 % label colour, image alone where there is no label.

    Labels with a ``band`` belong to that band of the image.
    """
    key = [c for c in ("section_id", "band", "y", "x") if c in labels.columns]
    at = [c for c in ("section_id", "band", "y", "x") if c in image.columns]
    j = image.join(labels, key, "left")
    mix = [
        F.when(F.col("label") > 0, F.col("v") * 0.45 + F.lit(0.55) * ((F.lit(k) * F.col("label")) % 255)).otherwise(F.col("v").cast("double"))
        for k in (37, 97, 173)
    ]
    u8 = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(255.0)).cast("int")
    return j.select(*at, *[u8(m).alias(n) for m, n in zip(mix, ("r", "g", "b"))])


def write_tiles(tiles: DataFrame, path: str, kind: str) -> None:
    """Tile sink: compressed Parquet by section and kind, sorted so that window reads prune row groups.

    A rewrite replaces the sections and kinds it contains and leaves others alone.
    """
    out = tiles.withColumn("kind", F.lit(kind))
    spread = out.repartition("section_id", F.floor(F.col("y0") / 4096)).sortWithinPartitions("section_id", "y0", "x0")
    w = spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
    w.partitionBy("section_id", "kind").parquet(path)


def write_patch_dataset(patches: DataFrame, path: str) -> None:
    """Patch sink by split; a rewrite replaces the splits it contains and leaves others alone."""
    w = patches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    w.partitionBy("split").parquet(path)
