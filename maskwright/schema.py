"""Element schema and the class dimension (class, fate, handle prefix)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ELEMENTS = (
    "scope long, ord int, id string, role string, tag string, type string, name string, value string, text string, x int, y int, w int, h int, "
    "visible boolean, offscreen boolean, enabled boolean, parent string, autocomplete string, placeholder string, label string"
)

# Fate and handle prefix of each class.
CLASSES = (
    ("password", "drop", "SECRET"),
    ("otp", "drop", "OTP"),
    ("apikey", "drop", "SECRET"),
    ("email", "substitute", "EMAIL"),
    ("phone", "substitute", "PHONE"),
    ("person", "substitute", "PERSON"),
    ("address", "substitute", "ADDR"),
    ("card", "substitute", "CARD"),
    ("aadhaar", "substitute", "AADHAAR"),
    ("pan", "substitute", "PAN"),
    ("ifsc", "substitute", "IFSC"),
    ("upi", "substitute", "UPI"),
    ("dob", "substitute", "DOB"),
    ("face", "mask", "FACE"),
    ("id_document", "mask", "IDDOC"),
    ("document", "mask", "DOC"),
    ("screenshot", "mask", "SCREEN"),
    ("signature", "mask", "SIGN"),
)
VISUAL = ("face", "id_document", "document", "screenshot", "signature")
FIELD_TAGS = ("input", "textarea", "select")
OPAQUE_TAGS = ("img", "canvas", "video", "svg", "picture", "iframe", "embed", "object")


def class_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CLASSES), "cls string, fate string, prefix string")


def _lookup(cls: Column, place: int, default: str) -> Column:
    table = F.create_map(*[F.lit(v) for row in CLASSES for v in (row[0], row[place])])
    return F.coalesce(F.try_element_at(table, cls), F.lit(default))


def fate(cls: Column) -> Column:
    return _lookup(cls, 1, "substitute")


def prefix(cls: Column) -> Column:
    return _lookup(cls, 2, "PII")


def role(tag: Column, kind: Column, explicit: Column, editable: Column) -> Column:
    """Explicit role first, then tag and type, then editable content."""
    return (
        F.when(F.coalesce(explicit, F.lit("")) != "", explicit)
        .when(tag == "a", "link").when(tag == "button", "button").when(tag == "select", "select").when(tag == "textarea", "textbox").when(tag == "img", "image")
        .when((tag == "input") & (kind == "password"), "password").when((tag == "input") & kind.isin("checkbox", "radio"), kind)
        .when((tag == "input") & kind.isin("submit", "button", "reset", "image"), "button").when(tag == "input", "textbox")
        .when(tag.rlike("^h[1-6]$"), "heading").when(editable, "textbox").otherwise("text")
    )


def accessible_name(aria: Column, labelled: Column, label: Column, alt: Column, button: Column, text: Column, title: Column, placeholder: Column) -> Column:
    """First non-empty of these, white space collapsed, 120 characters."""
    full = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
    return F.left(F.coalesce(*[full(c) for c in (aria, labelled, label, alt, button, text, title, placeholder)], F.lit("")), F.lit(120))


def visibility(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """True where a box lies outside the viewport; one that touches its edge does not."""
    return (x + w < 0) | (y + h < 0) | (x > width) | (y > height)


def described(boxes: DataFrame) -> DataFrame:
    """Rows with (display, visibility, opacity, w, h) that are worth a record: shown, and neither tiny nor huge."""
    shown = (F.coalesce("display", F.lit("")) != "none") & (F.coalesce("visibility", F.lit("")) != "hidden") & (F.coalesce("opacity", F.lit(1.0)) >= 0.05)
    return boxes.filter(shown & F.col("w").between(2, 4000) & F.col("h").between(2, 4000))


def opaque(tag: Column, role_: Column) -> Column:
    return tag.isin(*OPAQUE_TAGS) | (role_ == "image")
