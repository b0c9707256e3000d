"""Column expressions on manifest rows: what a file is, what becomes of it, how sizes and times are written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of camera files.
RAW_EXTENSIONS = (
    "3fr ari arw bay cap cr2 cr3 crw dcr dcs dng drf eip erf fff gpr iiq k25 kdc mdc "
    "mef mos mrw nef nrw obm orf pef ptx pxn r3d raf raw rwl rw2 rwz sr2 srf srw x3f"
).split()
#: Fixed value: MIME types of camera files.
RAW_MIME = "(?i)camera-raw|x-(?:adobe-dng|canon-cr2|canon-cr3|fuji-raf|nikon-nef|olympus-orf|panasonic-rw2|pentax-pef|sony-arw)"
#: MIME types that are kept when the format is `original`.
KEPT = ("image/png", "image/jpeg", "image/webp", "image/avif")


def half_up(x: Column) -> Column:
    """Rounding half towards positive infinity."""
    return F.floor(x + 0.5)


def is_raw(name: Column, mime: Column) -> Column:
    """Camera file by extension or MIME; a name without a dot is its own extension."""
    extension = F.lower(F.element_at(F.split(F.coalesce(name, F.lit("")), r"\."), -1))
    return extension.isin(RAW_EXTENSIONS) | F.coalesce(mime, F.lit("")).rlike(RAW_MIME)


def is_image(name: Column, mime: Column) -> Column:
    return F.coalesce(mime, F.lit("")).startswith("image/") | is_raw(name, mime)


def normal_mime(mime: Column) -> Column:
    return F.when(mime == "image/jpg", "image/jpeg").otherwise(mime)


def output_mime(format: Column, mime: Column, raw: Column) -> Column:
    kept = normal_mime(mime)
    return (
        F.when(format != "original", F.concat(F.lit("image/"), format))
        .when(raw, "image/jpeg")
        .when(kept.isin(*KEPT), kept)
        .otherwise("image/png")
    )


def extension_for(mime: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(mime, "/"), 2), "^(.*?)jpeg", "$1jpg")


def output_name(name: Column, mime: Column, route: Column) -> Column:
    stem = F.regexp_replace(name, r"\.[^/.]+$", "")
    return (
        F.when(route == "pass-through", name)
        .when(route == "remove-background", F.concat(stem, F.lit("-no-bg.png")))
        .otherwise(F.concat(stem, F.lit("."), extension_for(mime)))
    )


def encode_quality(operation: Column, quality: Column, mime: Column) -> Column:
    """Null for PNG; percent of the option for compress; else 1."""
    return F.when(mime == "image/png", F.lit(None)).when(operation == "compress", quality / 100).otherwise(1.0)


def plan_size(operation: Column, percentage: Column, width: Column, height: Column, keep_aspect: Column, w: Column, h: Column) -> tuple[Column, Column]:
    """Width and height after resizing; an option of 0 counts as not given."""
    given = lambda x: F.coalesce(x, F.lit(0)) != 0
    fit = F.least(F.when(given(width), width / w).otherwise(1.0), F.when(given(height), height / h).otherwise(1.0))
    scale = F.when(operation != "resize", 1.0).when(given(percentage), percentage / 100).otherwise(fit)
    side = lambda own, option: F.greatest(F.lit(1), half_up(F.when(keep_aspect | ~given(option), own * scale).otherwise(option.cast("double"))).cast("long"))
    return side(w, width), side(h, height)


def route(operation: Column, format: Column, mime: Column, raw: Column, target: Column) -> Column:
    return (
        F.when(operation == "remove-background", "remove-background")
        .when(raw & (format == "png") & (operation != "resize"), "raw-16")
        .when(raw, "raw-8")
        .when((operation == "convert") & (normal_mime(mime) == target), "pass-through")
        .otherwise("re-encode")
    )


def format_bytes(n: Column) -> Column:
    tenths = lambda unit: F.floor((n * 10 + unit // 2) / unit).cast("long")
    text = lambda t, suffix: F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"), F.lit(suffix))
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1 << 20, text(tenths(1024), " KB"))
        .otherwise(text(tenths(1 << 20), " MB"))
    )


def format_eta(seconds: Column) -> Column:
    """Null where nothing is shown: unknown or none left."""
    return (
        F.when(F.coalesce(seconds, F.lit(0)) == 0, F.lit(None))
        .when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s")))
        .otherwise(F.concat(F.ceil(seconds / 60).cast("string"), F.lit(" min")))
    )


def compose_progress(stage: Column, p: Column) -> Column:
    """Progress of a part within its whole, p in 0..1."""
    spans = {"decode": (0.0, 0.42), "removal": (0.42, 0.58), "sharpen": (0.36, 0.25), "png": (0.62, 0.36), "refine": (0.68, 0.16)}
    out = p
    for name, (start, width) in spans.items():
        out = F.when(stage == name, F.lit(start) + F.lit(width) * p).otherwise(out)
    return out
