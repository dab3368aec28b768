"""String, coercion and lookup expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File suffix by media type.
AUDIO_SUFFIX = {
    "audio/aac": ".aac",
    "audio/amr": ".amr",
    "audio/ogg": ".ogg",
    "audio/opus": ".ogg",
    "audio/mpeg": ".mpeg",
    "audio/mpga": ".mpga",
    "audio/mp4": ".mp4",
    "audio/wav": ".wav",
    "audio/webm": ".webm",
}
IMAGE_SUFFIX = {
    "image/jpeg": ".jpg",
    "image/jpg": ".jpg",
    "image/png": ".png",
    "image/webp": ".webp",
}


def is_primary_code(value: Column) -> Column:
    """Only digits, twelve or more of them."""
    return value.rlike("^[0-9]{12,}$")


def normalize_format(name: Column) -> Column:
    squeezed = F.replace(name, F.lit(" "), F.lit(""))
    return F.when(F.lower(squeezed) == "code128", "Code128").otherwise(squeezed)


def more_plausible(value: Column, other: Column) -> Column:
    """A digits-only reading beats one with other characters, then the longer wins."""
    def digits(v: Column) -> Column:
        return F.regexp_replace(v, "[ -]", "").rlike("^[0-9]+$")

    return F.when(digits(value) != digits(other), digits(value)).otherwise(
        F.length(value) > F.length(other))


def normalize_phone(phone: Column) -> Column:
    return F.trim(F.regexp_replace(phone, r"@c\.us|[+ -]", ""))


def _suffix(mime: Column, table: dict[str, str]) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, mime), F.lit(".bin"))


def audio_suffix(mime: Column) -> Column:
    return _suffix(F.lower(F.trim(F.split_part(mime, F.lit(";"), F.lit(1)))), AUDIO_SUFFIX)


def image_suffix(mime: Column) -> Column:
    return _suffix(F.lower(mime), IMAGE_SUFFIX)


def _whole(text: Column) -> Column:
    plain = F.trim(text)
    return F.when(plain.rlike("^[+-]?[0-9]+$"), plain.try_cast("long"))


def meta_int(value: Column) -> Column:
    """Integer of a metadata string; anything unreadable, also the words of booleans, is 0."""
    return F.coalesce(_whole(value), F.lit(0).cast("long"))


def meta_bool(value: Column) -> Column:
    return F.coalesce(F.lower(value).isin("true", "1", "yes"), F.lit(False))


def _typed(metadata: Column, key: str, kind: str) -> Column:
    return F.try_variant_get(metadata, f"$.{key}", kind)


def variant_int(metadata: Column, key: str) -> Column:
    """Integer under ``key`` of a variant, by the type it has there.

    Numbers lose their fraction, true is 1, texts are read as whole numbers; all else is 0.
    """
    kind = F.schema_of_variant(_typed(metadata, key, "variant"))
    number = _typed(metadata, key, "double")
    whole = F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number))
    return F.coalesce(
        F.when(kind == "BOOLEAN", _typed(metadata, key, "boolean").cast("long"))
        .when(kind == "BIGINT", _typed(metadata, key, "long"))
        .when(kind == "STRING", _whole(_typed(metadata, key, "string")))
        .when(kind.rlike("^(DOUBLE|FLOAT|DECIMAL)"), whole), F.lit(0).cast("long"))


def variant_bool(metadata: Column, key: str) -> Column:
    """Truth of the value under ``key`` of a variant, by the type it has there.

    Texts count if they are one of the words, numbers if they are not 0, lists and objects if they hold anything.
    """
    kind = F.schema_of_variant(_typed(metadata, key, "variant"))
    held = _typed(metadata, key, "string")
    return F.coalesce(
        F.when(kind == "BOOLEAN", _typed(metadata, key, "boolean"))
        .when(kind == "STRING", meta_bool(held))
        .when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), _typed(metadata, key, "double") != 0)
        .when(kind.rlike("^(ARRAY|OBJECT)"), ~F.to_json(_typed(metadata, key, "variant")).isin("[]", "{}")), F.lit(False))


def variant_str(metadata: Column, key: str) -> Column:
    """Text under ``key`` of a variant; absent and null stay null."""
    return _typed(metadata, key, "string")


def meta_str(metadata: Column, key: str) -> Column:
    """String under ``key`` of a map column; absent and null stay null."""
    return F.try_element_at(metadata, F.lit(key))
