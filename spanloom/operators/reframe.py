"""The reframing of a video as one filter text: scaled, cropped along a track, zoomed by a schedule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Reframe
from ..sources.media import frame_plan
from . import signals as sg
from .intervals import KEY


def filters(media: DataFrame, keys: DataFrame, zooms: DataFrame, config: Reframe = Reframe()) -> DataFrame:
    """media (width, height, fps) with `zoom`, `x`, `y`, `static_zoom` and `filter`.

    keys: keyframes (media_id, t, x, y) in shares of the frame, as of signals.simplified; media
    without any stand centred. zooms: (media_id, start, zoom), as of edl.punch_ins; media whose
    zooms are all 1 need no zoom filter.
    """
    text = lambda df, t, v, step, name: sg.piecewise_expression(df.select(KEY, F.col(t).alias("t"), F.col(v).alias("v")), step, "@" if step else "t").withColumnRenamed("expression", name)
    still = zooms.groupBy(KEY).agg(F.min(F.col("zoom") == 1.0).alias("static_zoom"))
    plan = frame_plan(media, config.width, config.height)
    for df in (text(keys, "t", "x", False, "_x"), text(keys, "t", "y", False, "_y"), text(zooms, "start", "zoom", True, "zoom"), still):
        plan = plan.join(df, KEY, "left")
    w, h, bias = config.width, config.height, f"{config.bias:.4f}"
    fps = F.format_string("%.6f", F.col("fps").cast("double"))
    pw, ph = F.col("prescale_width"), F.col("prescale_height")
    held = lambda room, centre, side, less: F.format_string(f"max(0\\,min(%d\\,(%s)*%d-{less}))", room, centre, side)
    plan = (
        plan.withColumn("static_zoom", F.coalesce("static_zoom", F.lit(True)))
        .withColumn("zoom", F.replace(F.coalesce("zoom", F.lit("0")), F.lit("@"), F.concat(F.lit("(on/"), fps, F.lit(")"))))
        .withColumn("x", held(pw - w, F.coalesce("_x", F.lit("0.5")), pw, f"{w}/2"))
        .withColumn("y", held(ph - h, F.coalesce("_y", F.lit(bias)), ph, f"{h}*{bias}"))
        .drop("_x", "_y")
    )
    crop = F.format_string(f"scale=%d:%d:flags=bicubic,crop=w={w}:h={h}:x='%s':y='%s'", pw, ph, F.col("x"), F.col("y"))
    zoom = F.concat(F.lit(",zoompan=z='"), "zoom", F.lit(f"':x='iw/2-(iw/zoom/2)':y='ih/2-(ih/zoom/2)':d=1:s={w}x{h}:fps="), fps)
    return plan.withColumn("filter", F.concat(crop, F.when(F.col("static_zoom"), F.lit("")).otherwise(zoom)))
