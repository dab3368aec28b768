"""Texts sent to people, routing of their messages, and redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted image types.
IMAGE_MIMES = ("image/jpeg", "image/png", "image/webp")
MAX_UPLOAD_BYTES = 15 * 1024 * 1024
COMMENT_LIMIT = 2000


def _int_list(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: v.cast("string")), ", "), F.lit("]"))


def _text_list(values: Column) -> Column:
    quoted = F.transform(values, lambda v: F.concat(F.lit("'"), v, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def session_message(status: Column, found: Column, expected: Column, missing_labels: Column,
                    new_codes: Column, missing_before: Column) -> Column:
    """Prompt for the next step of a session; null when it is complete."""
    pick = F.concat(
        F.format_string("Found %d new barcodes but only %d missing. Which one(s) to add? ",
                        F.size(new_codes), missing_before), _text_list(new_codes))
    so_far = F.format_string("Found %d/%d. ", found, expected)
    more = F.when(F.size(missing_labels) > 0, F.concat(
        so_far, F.lit("Send a photo of box(es): "), _int_list(missing_labels))).otherwise(
        F.concat(so_far, F.lit("Send another photo.")))
    return F.when(status == "needs_user_selection", pick).when(status == "active", more)


def _with_ids(body: Column, upload_id: Column, trace_id: Column, gap: str) -> Column:
    def line(prefix: str, v: Column) -> Column:
        return F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(prefix), v))

    return F.concat_ws("\n", body, line(f"{gap}ID: ", upload_id), line("Trace: ", trace_id))


def reply_line(label_index: Column, value: Column, format_: Column) -> Column:
    """A code that was read; one without a label has a dash for its number."""
    return F.concat(F.coalesce(label_index.cast("string"), F.lit("-")), F.lit(". "), value, F.lit(" ("), format_, F.lit(")"))


def reply_text(lines: Column, upload_id: Column, trace_id: Column) -> Column:
    """The lines of a reply, its heading first."""
    return _with_ids(F.array_join(lines, "\n"), upload_id, trace_id, "\n")


def photo_caption(found: Column, visible: Column, upload_id: Column, trace_id: Column) -> Column:
    body = F.format_string(
        "I read %d of %d labels. Please take a closer photo of the marked barcode.", found, visible)
    return _with_ids(body, upload_id, trace_id, "")


def route_message(type_: Column, mime: Column) -> Column:
    """What a message asks for."""
    image = F.coalesce(F.lower(mime), F.lit("")).isin(*IMAGE_MIMES)
    return (F.when(type_ == "image", "photo")
            .when((type_ == "document") & image, "photo")
            .when(type_ == "document", "instruction")
            .when(type_ == "audio", "audio")
            .when(type_.isin("text", "interactive"), "selection")
            .otherwise("unsupported"))


def processing_status(*, duplicate: Column, route: Column, media_id: Column, mime: Column,
                      failed: Column, outcome: Column, session_status: Column, pending: Column,
                      reply_known: Column, transcriber: Column | None = None, transcript: Column | None = None) -> Column:
    """How the handling of a message ended; null where nothing is recorded.

    ``transcriber`` is whether voice messages can be read at all, and ``transcript`` what was read of one (null
    if that failed); a read voice message is answered with the wish for a photo.

    ``pending`` is whether the sender has a session waiting for a choice (null
    if it waits without candidates) and ``reply_known`` whether the reply names
    one of the candidates.
    """
    photo = (F.when(F.coalesce(media_id, F.lit("")) == "", "missing_media_id")
             .when(~F.coalesce(F.lower(mime), F.lit("")).isin(*IMAGE_MIMES), "unsupported_image_mime")
             .when((outcome == "session_rejected") & (session_status == "complete"), "completed")
             .when((outcome == "session_rejected") & (session_status == "active"), "needs_better_photo")
             .when(outcome == "session_rejected", "session_closed")
             .when(session_status == "needs_user_selection", "needs_user_selection")
             .when(outcome == "complete", "completed")
             .when(outcome == "needs_better_photo", "needs_better_photo")
             .otherwise("retryable_error"))
    selection = (F.when(pending.isNull(), F.lit(None).cast("string"))
                 .when(~pending, "completed")
                 .when(reply_known, "selection_resolved")
                 .otherwise("selection_invalid_reply"))
    said = F.lit(None).cast("string") if transcript is None else transcript
    audio = (F.when(F.lit(True) if transcriber is None else ~transcriber, "transcriber_unavailable")
             .when(F.coalesce(media_id, F.lit("")) == "", "missing_media_id")
             .when(said.isNull(), "transcription_failed")
             .when(F.trim(said) == "", "empty_transcript")
             .otherwise("completed"))
    return (F.when(duplicate, "duplicate")
            .when(failed, "failed")
            .when(route == "photo", photo)
            .when(route == "audio", audio)
            .when(route == "instruction", "unsupported_document_type")
            .when(route == "selection", selection)
            .when(route == "unsupported", "unsupported_message_type"))


def sniff_image_type(content: Column) -> Column:
    """Media type by the first bytes of a file; null when none of the known ones."""
    def starts(at: int, hexed: str) -> Column:
        return F.substring(content, at, len(hexed) // 2) == F.unhex(F.lit(hexed))

    # File signatures.
    heic = F.substring(content, 5, 8).cast("string").isin(
        "ftypheic", "ftypheix", "ftyphevc", "ftyphevx", "ftypmif1")
    return (F.when(starts(1, "FFD8FF"), "image/jpeg")
            .when(starts(1, "89504E470D0A1A0A"), "image/png")
            .when(starts(1, "52494646") & starts(9, "57454250"), "image/webp")
            .when(heic, "image/heic"))


def admission(content_type: Column, content: Column, max_bytes: int = MAX_UPLOAD_BYTES) -> Column:
    """``accepted``, or the reason an upload is refused."""
    return (F.when(~F.coalesce(F.lower(content_type), F.lit("")).isin(*IMAGE_MIMES), "unsupported_image_type")
            .when(F.length(content) > max_bytes, "image_too_large")
            .otherwise("accepted"))


def _has(v: Column) -> Column:
    return F.coalesce(v, F.lit("")) != ""


def redact_message(id_: Column, type_: Column, text: Column, media_id: Column, mime: Column,
                   caption: Column) -> dict[str, Column]:
    """What may be logged of a chat message: no sender, text or media id."""
    return {"id": id_, "type": type_, "has_text": _has(text), "has_media_id": _has(media_id),
            "mime_type": mime, "has_caption": _has(caption)}


def redact_audio(filename: Column, content_type: Column, audio: Column) -> dict[str, Column]:
    return {"filename": filename, "content_type": content_type,
            "audio_size_bytes": F.coalesce(F.octet_length(audio), F.lit(0))}


def redact_download(file_name: Column, mime: Column, url: Column) -> dict[str, Column]:
    """A download without its signed address; only the suffix of its target."""
    suffix = F.regexp_extract(file_name, r"(\.[^./]+)$", 1)
    return {"file_name": file_name, "mime_type": mime, "has_url": _has(url), "target_suffix": suffix}


def redact_voice(mime: Column, media_id: Column, transcriber: Column) -> dict[str, Column]:
    """A voice message without the id of its media; the kind of what reads it."""
    return {"mime_type": mime, "has_media_id": _has(media_id), "transcriber_type": transcriber}


def redact_direct_download(file_name: Column, mime: Column, url: Column, transcriber: Column) -> dict[str, Column]:
    """A download for transcription without its signed address."""
    return {"file_name": file_name, "mime_type": mime, "has_download_url": _has(url), "transcriber_type": transcriber}


def redact_conversion(path: Column) -> dict[str, Column]:
    """A conversion of a file: only the lower-case suffix of its path."""
    return {"source_suffix": F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))}


def redact_scan(filename: Column, content_type: Column) -> dict[str, Column]:
    """An uploaded photo without its bytes."""
    return {"filename": filename, "content_type": content_type}
