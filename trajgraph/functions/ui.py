"""UI elements: boxes, keys, descriptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box_math(b: Column) -> Column:
    width, height = b["x_max"] - b["x_min"], b["y_max"] - b["y_min"]
    return F.struct(
        ((b["x_min"] + b["x_max"]) / 2).alias("center_x"),
        ((b["y_min"] + b["y_max"]) / 2).alias("center_y"),
        width.alias("width"),
        height.alias("height"),
        (width * height).alias("area"),
    )


def normalise_box(b: Column, width: Column, height: Column) -> Column:
    return F.struct(
        (b["x_min"] / width).alias("x_min"),
        (b["x_max"] / width).alias("x_max"),
        (b["y_min"] / height).alias("y_min"),
        (b["y_max"] / height).alias("y_max"),
    )


def to_physical(x: Column, y: Column, logical: tuple[Column, Column], frame: tuple[int, int, int, int], orientation: Column) -> Column:
    """Portrait pixel of a logical point for one of four screen orientations.

    A quarter turn swaps the axes; which axis is mirrored follows the turn.
    """
    x0, y0, x1, y1 = frame
    w, h = x1 - x0, y1 - y0
    across_x, across_y = (x * w / logical[0]).cast("int"), (y * w / logical[1]).cast("int")
    down_x, down_y = (x * h / logical[0]).cast("int"), (y * h / logical[1]).cast("int")
    turned = orientation.isin(1, 3)
    px = F.when(turned, across_y).otherwise(across_x)
    py = F.when(turned, down_x).otherwise(down_y)
    px = F.when(orientation.isin(1, 2), F.lit(w) - px).otherwise(px)
    py = F.when(orientation.isin(2, 3), F.lit(h) - py).otherwise(py)
    bad = ~orientation.isin(0, 1, 2, 3)
    return F.when(bad, F.raise_error(F.lit("unsupported orientation"))).otherwise(
        F.struct((px + x0).alias("x"), (py + y0).alias("y"))
    )


def corners(b: Column, orientation: Column) -> Column:
    """Upper-left and lower-right corner as seen in an orientation."""
    flip_x, flip_y = orientation.isin(2, 3), orientation.isin(1, 2)
    pick = lambda flip, a, z: F.when(flip, b[z]).otherwise(b[a]).cast("int")
    return F.struct(
        pick(flip_x, "x_min", "x_max").alias("x0"),
        pick(flip_y, "y_min", "y_max").alias("y0"),
        pick(flip_x, "x_max", "x_min").alias("x1"),
        pick(flip_y, "y_max", "y_min").alias("y1"),
    )


def element_key(resource_id: Column, class_name: Column, description: Column, width: Column, height: Column) -> Column:
    """Id of an element: its resource, or class and size, and a short description."""
    resource = F.nullif(resource_id, F.lit(""))
    base = F.coalesce(
        F.translate(resource, ":/", "._"),
        F.concat_ws("_", F.coalesce(class_name, F.lit("None")), width.cast("string"), height.cast("string")),
    )
    short = (F.coalesce(description, F.lit("")) != "") & (F.length(description) < 20)
    suffix = F.regexp_replace(F.regexp_replace(description, "[/:]", "_"), " ", "")
    return F.concat(base, F.when(short, F.concat(F.lit("_"), suffix)).otherwise(F.lit("")))


def element_uid(key: Column, image_hash: Column) -> Column:
    """Key and image hash, or whichever exists."""
    return F.nullif(F.concat_ws("_", key, image_hash), F.lit(""))


def element_description() -> Column:
    """Short wording of an element from its class and texts."""
    col = lambda c: F.nullif(F.col(c), F.lit(""))
    text, desc, hint, res = col("text"), col("content_description"), col("hint_text"), col("resource_name")
    checked = F.coalesce(F.col("is_checked"), F.lit(False))
    # Fixed values below: the wording agents see.
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))

    def plain(kind):
        named = F.concat(quote(F.coalesce(text, desc, hint, res)), F.lit(f" {kind}"))
        return F.coalesce(named, F.lit(kind))

    def stateful(kind, state):
        named = F.coalesce(
            F.concat(F.lit(f"a {kind} with the text "), quote(text)),
            F.concat(F.lit("a "), quote(F.coalesce(hint, desc)), F.lit(f" {kind}")),
            F.lit(f"a {kind}"),
        )
        return F.concat(named, F.when(checked, f" that is {state}").otherwise(f" that is not {state}"))

    box = F.concat(
        F.coalesce(F.concat(F.lit("a "), quote(F.coalesce(hint, desc)), F.lit(" text box")), F.lit("a text box")),
        F.coalesce(F.concat(F.lit(" with the text "), quote(text)), F.lit(" that is empty")),
    )
    kind = F.lower(F.element_at(F.split(F.col("class_name"), r"\."), -1))
    return (
        F.when(F.coalesce(F.col("class_name"), F.lit("")) == "", "Unknown")
        .when(kind.contains("radiobutton"), stateful("radio button", "selected"))
        .when(kind.contains("button"), plain("button"))
        .when(kind.contains("image"), plain("image"))
        .when(kind.contains("text") & F.coalesce(F.col("is_editable"), F.lit(False)), box)
        .when(kind.contains("text"), plain("icon"))
        .when(kind.contains("switch"), stateful("switch", "checked"))
        .when(kind.contains("checkbox"), stateful("checkbox", "checked"))
        .otherwise(plain("icon"))
    )
