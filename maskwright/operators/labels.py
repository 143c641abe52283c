"""Label detector over element attributes, and the sinks a value may be written to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bounded
from ..schema import FIELD_TAGS

# Autocomplete tokens, label words by priority, words around images, words of allowed sinks.
AUTOCOMPLETE = (
    ("current-password", "password"),
    ("new-password", "password"),
    ("one-time-code", "otp"),
    ("email", "email"),
    ("tel", "phone"),
    ("tel-national", "phone"),
    ("tel-local", "phone"),
    ("name", "person"),
    ("given-name", "person"),
    ("family-name", "person"),
    ("additional-name", "person"),
    ("cc-number", "card"),
    ("cc-csc", "card"),
    ("cc-exp", "card"),
    ("cc-name", "person"),
    ("street-address", "address"),
    ("address-line1", "address"),
    ("address-line2", "address"),
    ("postal-code", "address"),
    ("bday", "dob"),
)
KEYWORDS = (
    (r"(pass(word|wd|phrase)|pwd)", "password", 0.97),
    (r"(otp|one[\s-]?time|verification\s*code|auth\s*code)", "otp", 0.93),
    (r"(api[\s-]?key|secret|token|access[\s-]?key|private[\s-]?key)", "apikey", 0.93),
    (r"(e[\s-]?mail|email\s*address)", "email", 0.9),
    (r"(phone|mobile|contact\s*(no|number)|whatsapp)", "phone", 0.88),
    (r"(full\s*name|first\s*name|last\s*name|your\s*name|applicant\s*name|surname)", "person", 0.85),
    (r"(address|street|city|pin\s*code|postal|zip)", "address", 0.8),
    (r"(card\s*(no|number)|credit\s*card|debit\s*card|cvv|cvc)", "card", 0.93),
    (r"(aadhaar|aadhar|uid(ai)?)", "aadhaar", 0.94),
    (r"(pan(\s*card|\s*number)?)", "pan", 0.9),
    (r"(ifsc)", "ifsc", 0.9),
    (r"(upi(\s*id)?|vpa)", "upi", 0.9),
    (r"(date\s*of\s*birth|dob|birth\s*date)", "dob", 0.88),
)
IMAGE_WORDS = (
    (r"(aadhaar|aadhar|pan\s*card|passport|licen[cs]e|voter\s*id|identity|id\s*(card|proof)|kyc)", "id_document", 0.86),
    (r"(photo|photograph|portrait|selfie|profile\s*(pic|picture|photo)|avatar|headshot)", "face", 0.8),
    (r"(signature|signed)", "id_document", 0.82),
)
SINKS = (
    ("email", r"e[\s-]?mail"),
    ("phone", "phone|mobile|contact|tel|whatsapp"),
    ("person", "name"),
    ("address", "address|street|city|pin|postal|zip"),
    ("card", "card|cc-|cvv|cvc"),
    ("aadhaar", "aadhaar|aadhar|uid"),
    ("pan", "pan"),
    ("ifsc", "ifsc"),
    ("upi", "upi|vpa"),
    ("dob", "birth|dob"),
    ("otp", "otp|code"),
    ("password", "pass|pwd"),
)


def first_match(text: Column, table: tuple) -> Column:
    """Place (from 1) of the first row whose words the text has; 0 if none."""
    return F.array_position(F.array(*[F.coalesce(text.rlike("(?i)" + bounded(words)), F.lit(False)) for words, _, _ in table]), F.lit(True))


def matched(place: Column, table: tuple, column: int) -> Column:
    """That row's class (1) or probability (2); null without a match."""
    return F.get(F.array(*[F.lit(row[column]) for row in table]), place.cast("int") - 1)


def _autocomplete(token: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for row in AUTOCOMPLETE for v in row]), token)


def _joined(*columns: Column) -> Column:
    return F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in columns])


def detect(elements: DataFrame) -> DataFrame:
    """scope, id, ord, field, cls, p, source: at most one label detection for each element, by the first rule that applies."""
    parents = elements.select("scope", F.col("id").alias("parent"), F.col("name").alias("parent_name"))
    rows = elements.join(parents, ["scope", "parent"], "left")
    field = F.col("tag").isin(*FIELD_TAGS)
    image = (F.col("role") == "image") | (F.col("tag") == "img")
    token = F.element_at(F.split(F.lower(F.coalesce("autocomplete", F.lit(""))), r"\s+"), -1)
    made = lambda where, cls, p: F.struct(F.lit(where).alias("field"), cls.alias("cls"), p.cast("double").alias("p"))
    rows = rows.select(
        "*",
        first_match(_joined(F.col("name"), F.col("label"), F.col("placeholder"), F.col("parent_name")), IMAGE_WORDS).alias("near_"),
        first_match(_joined(F.col("name"), F.col("label"), F.col("placeholder"), F.col("type")), KEYWORDS).alias("word_"),
        _autocomplete(token).alias("auto_"),
    )
    near, word = F.col("near_"), F.col("word_")
    secret = (F.coalesce("role", F.lit("")) == "password") | (F.coalesce("type", F.lit("")) == "password")
    found = (
        F.when(image, F.when(near > 0, made("element", matched(near, IMAGE_WORDS, 1), matched(near, IMAGE_WORDS, 2))))
        .when(secret, made("value", F.lit("password"), F.lit(1.0)))
        .when(F.col("auto_").isNotNull(), made("value", F.col("auto_"), F.lit(0.95)))
        .when(F.col("type") == "email", made("value", F.lit("email"), F.lit(0.93)))
        .when(F.col("type") == "tel", made("value", F.lit("phone"), F.lit(0.93)))
        .when((word > 0) & field, made("value", matched(word, KEYWORDS, 1), matched(word, KEYWORDS, 2)))
        .when(word > 0, made("text", matched(word, KEYWORDS, 1), matched(word, KEYWORDS, 2) - 0.25))
    )
    # explode_outer of one value keeps the filter above it, so that the rules are evaluated once.
    return rows.select("scope", "id", "ord", F.explode_outer(F.array(found)).alias("d")).filter("d is not null").select("scope", "id", "ord", "d.*", F.lit("dom").alias("source"))


def allowed_sink(cls: Column, role: Column, tag: Column, kind: Column, name: Column, label: Column, placeholder: Column, autocomplete: Column, height: Column) -> Column:
    """May a value of this class be written into that element?"""
    hay = F.lower(_joined(name, label, placeholder, autocomplete, kind))
    words = F.lit(False)
    for c, pattern in SINKS:
        words = F.when(cls == c, hay.rlike(pattern)).otherwise(words)
    return (
        F.when(~F.coalesce(tag.isin(*FIELD_TAGS), F.lit(False)), False)
        .when(role == "password", cls.isin("password", "otp"))
        .when(F.coalesce(_autocomplete(F.lower(F.coalesce(autocomplete, F.lit("")))) == cls, F.lit(False)), True)
        .when((tag == "textarea") & (height > 120), False).otherwise(words)
    )
