"""File kinds, picture shapes and edit documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions that are shown as they are, with their types.
MIME = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "avif": "image/avif", "bmp": "image/bmp", "ico": "image/x-icon", "mp4": "video/mp4", "webm": "video/webm", "mp3": "audio/mpeg", "flac": "audio/flac", "ogg": "audio/ogg", "wav": "audio/wav"}
#: Extensions that are converted, by what they become.
CONVERTED = {
    "jpg": ["heic", "heif", "tiff", "tif", "hdr", "exr", "psd", "tga", "pcx", "ppm", "pgm", "pbm", "pnm", "xbm", "xpm", "jp2", "j2k", "jpx", "jxl", "jfif", "jpe", "cur"],
    "mp4": ["mkv", "avi", "wmv", "mov", "m4v", "flv", "f4v", "3gp", "3g2", "mpg", "mpeg", "ts", "mts", "m2ts", "vob", "asf", "rm", "rmvb", "divx", "ogv", "mxf", "dv", "hevc", "h264", "h265"],
    "mp3": ["wma", "aiff", "aif", "m4a", "aac", "wv", "ape", "opus", "ra", "ram", "amr", "ac3", "dts", "tta", "mka", "au", "snd", "caf", "spx", "dsf", "dff"],
}
TIERS = ["image", "audio", "video"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extension(name) -> Column:
    return F.lower(F.substring_index(_col(name), ".", -1))


def is_media(name) -> Column:
    return extension(name).isin(list(MIME))


def conversion_target(name) -> Column:
    """The extension that a convertible file gets; null for others."""
    return F.coalesce(*[F.when(extension(name).isin(exts), F.lit(to)) for to, exts in CONVERTED.items()])


def mime_type(name) -> Column:
    """By extension, or by what it is converted to."""
    table = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension(name)), F.try_element_at(table, conversion_target(name)), F.lit("application/octet-stream"))


def media_type(mime) -> Column:
    m = _col(mime)
    return F.when(m == "image/gif", "gif").when(m.startswith("image/"), "photo").when(m.startswith("video/"), "video").when(m.startswith("audio/"), "audio").otherwise("other")


def conversion_rank(category) -> Column:
    """Images before audio before video."""
    return F.coalesce(*[F.when(_col(category) == t, F.lit(i)) for i, t in enumerate(TIERS)], F.lit(len(TIERS)))


def aspect_subtype(width, height, subtype=None) -> Column:
    """An existing subtype, else what a picture's proportions make it: equirectangular, panorama or nothing."""
    w, h = _col(width).cast("double"), _col(height).cast("double")
    ratio = F.when((w > 0) & (h > 0), w / h)
    wide, tall = ratio >= 2.0, 1 / ratio >= 2.5
    shape = F.when((F.greatest(w, h) >= 2048) & wide & ratio.between(1.97, 2.03) & (w >= 4000), "equirectangular").when((F.greatest(w, h) >= 2048) & (wide | tall), "panorama")
    return F.coalesce(_col(subtype), shape) if subtype is not None else shape


#: How much of a file is searched for its XMP document.
XMP_BYTES = 128 << 10


def xmp_text(data) -> Column:
    """The beginning of binary data as text; bytes that are no UTF-8 are replaced."""
    return F.make_valid_utf8(F.substring(_col(data), 1, XMP_BYTES).cast("string"))


def xmp_attribute(xmp, name: str) -> Column:
    """The trimmed value of the first attribute whose name ends so, in double quotes, else in single ones; null if empty."""
    value = lambda quote: F.nullif(F.trim(F.regexp_extract(_col(xmp), f"{name}={quote}([^{quote}]*){quote}", 1)), F.lit(""))
    return F.coalesce(value('"'), value("'"))


def byte_range(spec, size) -> Column:
    """(first, last) of an HTTP byte range of an object of the given size, or null."""
    s, n = _col(spec), _col(size).cast("long")
    a = F.nullif(F.regexp_extract(s, r"^bytes=\s*(\d*)\s*-\s*(\d*)\s*$", 1), F.lit("")).try_cast("long")
    b = F.nullif(F.regexp_extract(s, r"^bytes=\s*(\d*)\s*-\s*(\d*)\s*$", 2), F.lit("")).try_cast("long")
    last = F.least(F.coalesce(b, n - 1), n - 1)
    suffix = F.when((b > 0) & (b <= n), F.struct((n - b).alias("first"), (n - 1).alias("last")))
    return F.when(a.isNull(), suffix).when((a < n) & (a <= last), F.struct(a.alias("first"), last.alias("last")))


EDIT = "cropX double, cropY double, cropWidth double, cropHeight double, rotation double, brightness double, trimStart double, trimEnd double"


def edit_flags(json) -> Column:
    """What an edit document changes: crop, rotation, brightness, trim."""
    e = F.from_json(_col(json), EDIT)
    some = lambda c: F.coalesce(c, F.lit(False))
    crop = some((e["cropWidth"] < 1) | (e["cropHeight"] < 1) | (e["cropX"] > 0) | (e["cropY"] > 0))
    return F.struct(crop.alias("has_crop"), some(F.pmod(e["rotation"], F.lit(360)) != 0).alias("has_rotation"), some(e["brightness"] != 0).alias("has_brightness"), some((e["trimStart"] > 0) | (e["trimEnd"] > 0)).alias("has_trim"))


def camera(make, model) -> Column:
    """Make and model; a make that the model begins with, letter by letter, is not repeated."""
    a, b = F.nullif(F.trim(_col(make)), F.lit("")), F.nullif(F.trim(_col(model)), F.lit(""))
    return F.when(b.isNull(), a).when(a.isNull() | F.startswith(b, a), b).otherwise(F.concat_ws(" ", a, b))


def upright(width, height, orientation) -> Column:
    """(width, height) as shown: orientations 5 to 8 lie on their side."""
    w, h = _col(width), _col(height)
    turned = F.coalesce(_col(orientation).between(5, 8), F.lit(False))
    return F.struct(F.when(turned, h).otherwise(w).alias("width"), F.when(turned, w).otherwise(h).alias("height"))


def xmp_subtype(xmp) -> Column:
    """motion before equirectangular and panorama, before burst, before hdr; null if the document names none.

    A motion flag counts unless it is 0 or false; a projection only if it is one of the three known.
    """
    x = _col(xmp)
    motion = ~F.lower(F.coalesce(xmp_attribute(x, "MicroVideo"), xmp_attribute(x, "MotionPhoto"))).isin("0", "false")
    projection = F.lower(xmp_attribute(x, "ProjectionType"))
    return (
        F.when(motion, "motion")
        .when(projection == "equirectangular", "equirectangular")
        .when(projection.isin("cylindrical", "fisheye"), "panorama")
        .when(xmp_attribute(x, "BurstID").isNotNull(), "burst")
        .when(x.contains("HDRGainMap") | x.contains("hdrgm:Version"), "hdr")
    )


def motion_offset(xmp) -> Column:
    """How many bytes from the end a picture's film begins: the older attributes, else length and padding of the container's film."""
    x = _col(xmp)
    film = lambda quote: F.nullif(F.regexp_extract(x, f"(?:<|^)[^<]*Item:Mime={quote}video/mp4{quote}[^>]*", 0), F.lit(""))
    number = lambda part, name: F.when(xmp_attribute(part, name).try_cast("long") >= 0, xmp_attribute(part, name).try_cast("long"))
    element = F.coalesce(film('"'), film("'"))
    item = number(element, "Item:Length") + F.coalesce(number(element, "Item:Padding"), F.lit(0))
    return F.coalesce(number(x, "MicroVideoOffset"), number(x, "MotionVideoOffset"), item)


#: Fixed value: what stands before the film in files of one maker, whose documents name no offset.
FILM_MARKER = "MotionPhoto_Data"
#: The marker is looked for in so many bytes at the end.
FILM_BYTES = 16 << 20


def marked_offset(data) -> Column:
    """How many bytes follow the last FILM_MARKER at the end of binary data; null without one, or if nothing follows."""
    text = F.decode(F.right(_col(data), F.lit(FILM_BYTES)), "ISO-8859-1")
    return F.when(F.contains(text, F.lit(FILM_MARKER)), F.nullif(F.length(F.substring_index(text, FILM_MARKER, -1)), F.lit(0))).cast("long")
