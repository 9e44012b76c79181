"""Formats, the paths of what is written for an image, and which images are done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known extensions by format, the preferred one first. Fixed values.
EXTENSIONS = {
    "png": ["png"], "jpeg": ["jpg", "jpeg"], "gif": ["gif"], "webp": ["webp"], "pnm": ["pbm", "pam", "ppm", "pgm", "pnm"], "tiff": ["tiff", "tif"], "tga": ["tga"], "dds": ["dds"],
    "bmp": ["bmp"], "ico": ["ico"], "hdr": ["hdr"], "openexr": ["exr"], "farbfeld": ["ff"], "avif": ["avif"], "qoi": ["qoi"],
}
LOSSY, ALPHA = ("jpeg", "avif"), ("png", "ico", "tiff", "tga", "pnm", "farbfeld", "avif", "webp", "openexr", "qoi")
READ_ONLY = ("dds",)


def _map(pairs: list[tuple[str, str]]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs for x in pair))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """What follows the last dot of the file's name, as it is written; null without a dot or if the name starts with its only one."""
    return F.when(file_name(path).rlike(r"^.+\.[^.]*$"), F.regexp_extract(path, r"\.([^./]*)$", 1))


def stem(path: Column) -> Column:
    """The file's name without its extension."""
    name = file_name(path)
    return F.when(extension(path).isNull(), name).otherwise(F.regexp_extract(name, r"^(.+)\.[^.]*$", 1))


def format_of(path: Column) -> Column:
    """Format by extension; null for others."""
    return F.try_element_at(_map([(e, form) for form, own in EXTENSIONS.items() for e in own]), F.coalesce(F.lower(extension(path)), F.lit("")))


def preferred_extension(form: Column) -> Column:
    return F.coalesce(F.try_element_at(_map([(form, own[0]) for form, own in EXTENSIONS.items()]), form), F.lit("png"))


def output_format(given: Column, alpha: Column, allow_lossy: Column) -> Column:
    """PNG if alpha is wanted and the format has none, or if it is lossy and that isn't allowed; else as given."""
    return F.when((alpha & ~given.isin(*ALPHA)) | (~allow_lossy & given.isin(*LOSSY)), "png").otherwise(given)


def with_extension(path: Column, ext: Column) -> Column:
    """The path with its extension replaced, or with one more if it has none."""
    return F.concat(F.when(extension(path).isNull(), path).otherwise(F.regexp_replace(path, r"\.[^./]*$", "")), F.lit("."), ext)


def plan(path: Column, given: Column, alpha: Column, allow_lossy: Column, output: Column | None = None, output_dir: Column | None = None, into_dir: bool = False) -> dict[str, Column]:
    """base, format and error of what is written for an image (path) of a given format.

    into_dir: the base is the file's name in output_dir, which must be given, and output mustn't. Otherwise the base is output or else the path,
    and output's extension, if known, says the format; output_dir mustn't be given. Then PNG may take the format's place, and the extension goes with
    that; a base without an extension gets the format's first.
    """
    output, output_dir = (F.lit(None).cast("string") if c is None else c for c in (output, output_dir))
    if into_dir:
        wrong = F.when(output_dir.isNull(), "output_dir is required").when(output.isNotNull(), "output cannot be used with output_dir").when(file_name(path) == "", "no file name")
        base, wanted = F.concat(F.regexp_replace(output_dir, "/+$", ""), F.lit("/"), file_name(path)), given
    else:
        wrong = F.when(output_dir.isNotNull(), "output_dir needs a folder as input")
        base, wanted = F.coalesce(output, path), F.coalesce(format_of(output), given)
    form = output_format(wanted, alpha, allow_lossy)
    became = form.eqNullSafe(F.lit("png")) & ((alpha & ~wanted.isin(*ALPHA)) | (~allow_lossy & wanted.isin(*LOSSY)))
    base = F.when(became, with_extension(base, F.lit("png"))).when(extension(base).isNull(), with_extension(base, preferred_extension(form))).otherwise(base)
    wrong = F.coalesce(wrong, F.when(form.isin(*READ_ONLY), F.concat(F.lit("output format "), form, F.lit(" is not enabled for writing"))), F.when(form.isNull(), F.lit("unknown format")))
    return {"base": F.when(wrong.isNull(), base), "format": form, "error": wrong}


def object_path(base: Column, index: Column) -> Column:
    """The path of an object's crop: its index after the stem, before the extension."""
    folder = F.regexp_extract(base, r"^(.*/)?[^/]*$", 1)
    name = F.when(stem(base) == "", F.lit("output")).otherwise(stem(base))
    return F.concat(folder, name, F.lit("_"), index.cast("string"), F.when(extension(base).isNull(), F.lit("")).otherwise(F.concat(F.lit("."), extension(base))))


def not_done(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files (path) without an output in done (name) that starts with their stem and an underscore: an anti-join on stems of outputs."""
    own = stem(F.col("path"))
    # every prefix of an output's name up to an underscore is a stem it may belong to
    cuts = F.filter(F.sequence(F.lit(1), F.length("name")), lambda i: F.substring("name", i, F.lit(1)) == "_")
    stems = done.select(F.explode(F.transform(cuts, lambda i: F.substring("name", F.lit(1), i - 1))).alias("stem")).distinct()
    return files.withColumn("stem", own).join(stems, "stem", "left_anti").drop("stem")
