"""Page generator (UDTF-1, SRC-3, SRC-4, LIM-1): bytes in, ordered page rows out.

Decoders are pluggable and imported on the executor only, so the package loads without imaging libraries.
A decoder yields page bytes lazily; the PDF cap is applied while it runs, other formats aren't capped.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.schemas import PAGES, PDF_PACKAGE_ERROR
from folioflow.settings import Settings

Decoder = Callable[[bytes, Settings], Iterator[bytes]]


def decode_pdf(content: bytes, settings: Settings) -> Iterator[bytes]:
    """PDF pages as PNG without alpha, scaled to the wished dots per inch."""
    try:
        import fitz
    except ImportError as e:
        raise RuntimeError(PDF_PACKAGE_ERROR) from e
    scale = settings.pdf_dpi / 72
    with fitz.open(stream=content, filetype="pdf") as pdf:
        for n in range(min(settings.max_pdf_pages, pdf.page_count)):
            yield pdf.load_page(n).get_pixmap(matrix=fitz.Matrix(scale, scale), alpha=False).tobytes("png")


def decode_image(content: bytes, settings: Settings) -> Iterator[bytes]:
    """Every frame of an image as RGB PNG."""
    from PIL import Image, ImageSequence

    for frame in ImageSequence.Iterator(Image.open(io.BytesIO(content))):
        out = io.BytesIO()
        frame.convert("RGB").save(out, format="PNG")
        yield out.getvalue()


def decode_lines(content: bytes, settings: Settings) -> Iterator[bytes]:
    """Stand-in for text content: each line is a page."""
    yield from content.split(b"\n")


def decode_lines_capped(content: bytes, settings: Settings) -> Iterator[bytes]:
    yield from content.split(b"\n", settings.max_pdf_pages)[: settings.max_pdf_pages]


def explode_pages(uploads: DataFrame, settings: Settings, pdf: Decoder = decode_pdf, image: Decoder = decode_image, pages_per_batch: int = 8) -> DataFrame:
    """uploads(task_id, content) to (task_id, page_index, image, error).

    A document without pages gives no row; one that can't be decoded gives one row with page_index -1 and its
    error, so a bad file never fails the task. NULL content counts as no bytes. Output batches are small, as
    pages are large.
    """

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        take = lambda: pd.DataFrame(rows, columns=["task_id", "page_index", "image", "error"]).astype({"page_index": "int32"})
        for batch in batches:
            for task_id, content in zip(batch["task_id"], batch["content"], strict=True):
                content = bytes(content or b"")
                try:
                    for i, page in enumerate((pdf if content.startswith(b"%PDF") else image)(content, settings)):
                        rows.append((task_id, i, page, None))
                        if len(rows) >= pages_per_batch:
                            yield take()
                            rows.clear()
                except Exception as e:
                    rows.append((task_id, -1, None, str(e) or type(e).__name__))
        if rows:
            yield take()

    return uploads.select(F.col("task_id").cast("string").alias("task_id"), F.col("content").cast("binary").alias("content")).mapInPandas(pages, PAGES)
