"""Files as they arrive: limits, kinds by their first bytes, pages, and text from pages through pluggable engines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.config import MAX_FILE_BYTES, MAX_PAGES, MAX_PIXELS, RENDER_SCALE
from papyra.functions.text import constant_map

#: Media types by the ends of names.
MEDIA_TYPES = {"pdf": "application/pdf", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "gif": "image/gif"}

TOO_LARGE, UNSUPPORTED, NOT_A_PDF, EMPTY = "File exceeds the maximum size.", "Unsupported file type.", "File is not a PDF.", "No file."


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, modificationTime, length, content, mime, error of every file under path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return check_files(reader.load(path).withColumn("mime", media_type(F.col("path"))))


def media_type(path: Column) -> Column:
    return F.coalesce(F.try_element_at(constant_map(MEDIA_TYPES), F.lower(F.element_at(F.split(path, r"\."), -1))), F.lit("application/octet-stream"))


def header(content: Column, n: int) -> Column:
    return F.substring(content, 1, n)


def ascii_text(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def is_pdf(mime: Column, name: Column) -> Column:
    return F.coalesce(mime == "application/pdf", F.lit(False)) | F.coalesce(F.lower(name).endswith(".pdf"), F.lit(False))


def is_image(mime: Column) -> Column:
    return F.coalesce(mime.startswith("image/"), F.lit(False))


def has_pdf_magic(content: Column) -> Column:
    return F.coalesce(F.hex(header(content, 5)) == "255044462D", F.lit(False))


def is_jpeg(content: Column) -> Column:
    return F.coalesce(F.hex(header(content, 3)) == "FFD8FF", F.lit(False))


def is_png(content: Column) -> Column:
    return F.coalesce(F.hex(header(content, 4)) == "89504E47", F.lit(False))


def is_webp(content: Column) -> Column:
    h = ascii_text(header(content, 12))
    return F.coalesce(h.startswith("RIFF") & h.contains("WEBP"), F.lit(False))


def is_gif(content: Column) -> Column:
    h = ascii_text(header(content, 6))
    return F.coalesce(h.startswith("GIF87a") | h.startswith("GIF89a"), F.lit(False))


def image_kind(content: Column) -> Column:
    """What the first bytes say; null if nothing known. An image's media type is trusted all the same."""
    return F.when(is_jpeg(content), "jpeg").when(is_png(content), "png").when(is_webp(content), "webp").when(is_gif(content), "gif")


def file_error(length: Column, mime: Column, name: Column, content: Column) -> Column:
    """Why a file can't be read, or null. Nothing is thrown: one bad file doesn't end a job."""
    pdf = is_pdf(mime, name)
    return (
        F.when(length.isNull() | content.isNull(), EMPTY)
        .when(length > MAX_FILE_BYTES, TOO_LARGE)
        .when(~pdf & ~is_image(mime), UNSUPPORTED)
        .when(pdf & ~has_pdf_magic(content), NOT_A_PDF)
    )


def check_files(files: DataFrame) -> DataFrame:
    return files.withColumn("error", file_error(F.col("length"), F.col("mime"), F.col("path"), F.col("content")))


def data_url(mime: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))


def pages_to_render(total: Column, wanted: Column | None = None, most: int = MAX_PAGES) -> Column:
    """The page numbers to read: those wanted that exist, as often and in the order they are named, else the first; most at all."""
    first = F.when(total > 0, F.sequence(F.lit(1), F.least(total, F.lit(most)))).otherwise(F.array().cast("array<int>"))
    if wanted is None:
        return first
    real = F.slice(F.filter(F.transform(wanted, lambda p: p.cast("int")), lambda p: (p >= 1) & (p <= total)), 1, most)
    return F.when(wanted.isNull() | (F.size(wanted) == 0), first).otherwise(real)


def sorted_pages(total: Column, wanted: Column, most: int = MAX_PAGES) -> Column:
    """Like pages_to_render, but distinct, in order, and none beyond most."""
    real = F.array_sort(F.array_distinct(F.filter(F.transform(wanted, lambda p: p.cast("int")), lambda p: (p >= 1) & (p <= F.least(total, F.lit(most))))))
    return F.when(F.size(wanted) > 0, real).otherwise(pages_to_render(total, None, most))


def preview_page(page: Column, total: Column) -> Column:
    return F.least(F.greatest(page, F.lit(1)), total)


def selected_pages(choice: str | int | None) -> list[int]:
    """A job's page parameter: "all" or nothing is every page."""
    return [] if choice in (None, "", "all") else [int(choice)]


def size_is_allowed(width: Column, height: Column) -> Column:
    return F.coalesce((width > 0) & (height > 0) & (width * height <= MAX_PIXELS), F.lit(False))


def fitted_scale(width: Column, height: Column, scale: float = RENDER_SCALE) -> Column:
    """scale, or less where a page would have more than MAX_PIXELS pixels at it."""
    pixels = width * scale * height * scale
    return F.when(pixels > MAX_PIXELS, scale * F.sqrt(F.lit(float(MAX_PIXELS)) / pixels)).otherwise(F.lit(scale))


#: Engines: bytes and page numbers to page images; page image to text.
PageRenderer = Callable[[bytes, list[int], float], list[tuple[int, bytes]]]
OcrEngine = Callable[[bytes], str]


def render_pages(files: DataFrame, renderer: PageRenderer, page_count: Column, wanted: Column | None = None, scale: float = RENDER_SCALE) -> DataFrame:
    """path, page_number, image, error: one row for each page of each file, or one with an error.

    Files with an error are passed on without being rendered, and only the pages to be read are. Rendering costs far more than
    moving a file, so files are spread over all tasks first. An image is its own only page.
    """
    cols = files.withColumn("pages", F.when(is_pdf(F.col("mime"), F.col("path")), pages_to_render(page_count, wanted)).otherwise(F.array(F.lit(1))))
    cols = cols.select("path", "mime", "content", "pages", "error")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                if r.error is not None:
                    rows.append((r.path, None, None, r.error))
                elif r.mime.startswith("image/"):
                    rows.append((r.path, 1, r.content, None))
                else:
                    try:
                        rows += [(r.path, n, image, None) for n, image in renderer(r.content, [int(p) for p in r.pages], scale)] or [(r.path, None, None, "No pages could be rendered.")]
                    except Exception as e:  # a file that can't be rendered is a row, not the end of the job
                        rows.append((r.path, None, None, f"Rendering failed: {e}"))
            yield pd.DataFrame(rows, columns=["path", "page_number", "image", "error"]).astype({"page_number": "Int32"})

    return cols.repartition(files.sparkSession.sparkContext.defaultParallelism * 4).mapInPandas(run, "path string, page_number int, image binary, error string")


def read_text(pages: DataFrame, engine: OcrEngine | None, image_col: str = "image", out: str = "full_text") -> DataFrame:
    """pages with the text that engine reads from each image; without an engine, or where it fails, ''."""
    if engine is None:
        return pages.withColumn(out, F.lit(""))

    def one(image: bytes | None) -> str:
        try:
            return engine(image) or "" if image is not None else ""
        except Exception:  # as a missing engine: no text
            return ""

    @F.pandas_udf("string")
    def text(images: pd.Series) -> pd.Series:
        return images.map(one)

    return pages.withColumn(out, text(F.col(image_col)))


def read_ocr_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Pages whose text is there already: case_id, role, page_number, full_text, mrz_text."""
    schema = "case_id string, role string, page_number int, full_text string, mrz_text string"
    return spark.read.schema(schema).format(fmt).load(path)
