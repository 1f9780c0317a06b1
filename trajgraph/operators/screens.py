"""Screens to element rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Attribute names of UI hierarchy dumps.
TEXT_ATTRIBUTES = {
    "text": "text",
    "content_description": "content-desc",
    "class_name": "class",
    "package_name": "package",
    "resource_id": "resource-id",
    "bounds": "bounds",
}
FLAG_ATTRIBUTES = {
    "is_checked": "checked",
    "is_checkable": "checkable",
    "is_clickable": "clickable",
    "is_enabled": "enabled",
    "is_focused": "focused",
    "is_focusable": "focusable",
    "is_long_clickable": "long-clickable",
    "is_scrollable": "scrollable",
    "is_selected": "selected",
}


def tag_nodes(screens: DataFrame, markup: str, key: str) -> DataFrame:
    """One row per opening tag of a screen's markup, in document order.

    Tags are found with a pattern, so a screen stays one row until it is
    exploded and markup that is not well-formed does no harm.
    """
    # A quoted value may hold any sign, the closing one of a tag included.
    tags = F.regexp_extract_all(F.col(markup), F.lit(r"""(?s)<[A-Za-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""), 0)
    return screens.select(key, F.posexplode(tags).alias("idx", "tag")).withColumn(
        "name", F.lower(F.regexp_extract("tag", r"^<([A-Za-z0-9]+)", 1))
    )


# The named entities of XML; the ampersand comes last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unescape(value: Column) -> Column:
    """Named and numeric character references replaced by their characters."""

    def character(part: Column, digits: Column) -> Column:
        number = F.when(digits.startswith("x"), F.conv(F.substr(digits, F.lit(2)), 16, 10)).otherwise(digits).try_cast("long")
        sign = lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")
        rest = F.substr(part, F.length(digits) + 2)
        return _let(number, lambda c: F.when(c <= 0x10FFFF, F.concat(sign(c), rest)).otherwise(F.concat(F.lit("&#"), part)))

    def piece(part: Column, i: Column) -> Column:
        """A piece that followed ``&#``: its number becomes a character if one stands there."""
        digits = F.regexp_extract(part, r"^(x[0-9A-Fa-f]{1,6}|[0-9]{1,7});", 1)
        return F.when(i == 0, part).otherwise(_let(digits, lambda d: character(part, d)))

    named = value
    for name, sign in ENTITIES.items():
        named = F.replace(named, F.lit(name), F.lit(sign))
    numbers = lambda t: F.when(F.contains(t, F.lit("&#")), F.array_join(F.transform(F.split(t, "&#"), piece), "")).otherwise(t)
    # Text without the sign, which is most of it, is not touched.
    return F.when(F.contains(value, F.lit("&")), F.replace(_let(named, numbers), F.lit("&amp;"), F.lit("&"))).otherwise(value)


def attribute(name: str):
    found = F.regexp_extract("tag", rf'\s{name}\s*=\s*"([^"]*)"', 1)
    return F.nullif(found, F.lit(""))


def xml_elements(screens: DataFrame, markup: str, key: str) -> DataFrame:
    """UI elements of hierarchy dumps: every node but the root, with typed columns."""
    nodes = tag_nodes(screens, markup, key).filter(F.col("idx") > 0)
    # All attributes of a tag are matched once; names and values are cut out of the matches.
    found = r"""[\w-]+\s*=\s*(?:"[^"]*"|'[^']*')"""
    nodes = nodes.withColumn("_all", F.regexp_extract_all("tag", F.lit(found), 0))
    nodes = nodes.withColumn("_k", F.transform("_all", lambda x: F.rtrim(F.translate(F.substring_index(x, "=", 1), "\t\n\r\f", "    "))))
    hit = lambda a: F.get("_all", (F.array_position("_k", a) - 1).cast("int"))
    names = {a: f"_{c}" for c, a in [*TEXT_ATTRIBUTES.items(), *FLAG_ATTRIBUTES.items()]}
    nodes = nodes.withColumns({c: hit(a) for a, c in names.items()})
    # The value is what stands between the first quote and the last sign; no name holds a quote.
    start = lambda c: F.least(F.nullif(F.instr(c, '"'), F.lit(0)), F.nullif(F.instr(c, "'"), F.lit(0)))
    nodes = nodes.withColumns({c: F.substr(c, start(c) + 1, F.length(c) - start(c) - 1) for c in names.values()})
    value = lambda a: F.col(names[a])
    out = nodes.select(
        key,
        (F.col("idx") - 1).alias("idx"),
        *[F.nullif(unescape(value(a)), F.lit("")).alias(c) for c, a in TEXT_ATTRIBUTES.items()],
        *[value(a).eqNullSafe("true").alias(c) for c, a in FLAG_ATTRIBUTES.items()],
        F.col("tag").endswith("/>").alias("is_leaf"),
        F.lit(True).alias("is_visible"),
    )
    n = lambda i: F.regexp_extract("bounds", r"\[(-?\d+),(-?\d+)\]\[(-?\d+),(-?\d+)\]", i).cast("int")
    box = F.struct(n(1).alias("x_min"), n(3).alias("x_max"), n(2).alias("y_min"), n(4).alias("y_max"))
    return out.withColumn("bbox_pixels", F.when(F.col("bounds").isNotNull(), box)).drop("bounds")


def flatten_nodes(nodes: DataFrame, visible_only: bool = False, clickable: bool = False) -> DataFrame:
    """Nodes that count as elements: leaves, described or scrollable ones, and with
    ``clickable`` the clickable ones too."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    keep = flag("is_leaf") | (F.coalesce("content_description", F.lit("")) != "") | flag("is_scrollable")
    if clickable:
        keep = keep | flag("is_clickable")
    out = nodes.filter(keep)
    return out.filter(flag("is_visible")) if visible_only else out


def first_seen(elements: DataFrame, element: str = "element_key", order: str = "seen_at") -> DataFrame:
    """First screen and number of sightings of every element key."""
    return elements.groupBy(element).agg(
        F.min_by("screen_id", F.struct(order, "screen_id")).alias("first_screen"), F.count(F.lit(1)).alias("sightings")
    )


class UiElements:
    """UDTF body: elements of one XML dump, for use in SQL."""

    def eval(self, xml: str):
        import xml.etree.ElementTree as ET

        try:
            root = ET.fromstring(xml)
        except (ET.ParseError, TypeError):
            return
        for i, node in enumerate(n for n in root.iter() if n is not root):
            get = node.attrib.get
            yield i, get("text"), get("content-desc"), get("class"), get("resource-id"), get("clickable") == "true"


UI_ELEMENTS = T.StructType(
    [
        T.StructField("idx", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("content_description", T.StringType()),
        T.StructField("class_name", T.StringType()),
        T.StructField("resource_id", T.StringType()),
        T.StructField("is_clickable", T.BooleanType()),
    ]
)


def register_udtf(spark, name: str = "ui_elements"):
    """Register the XML table function for SQL."""
    spark.udtf.register(name, F.udtf(UiElements, returnType=UI_ELEMENTS))
