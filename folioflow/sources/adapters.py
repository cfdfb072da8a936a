"""Hooks to decoders, recognisers and models that are not part of this repository.

Each adapter imports its library where it is used and says what is missing. The tests run
them on stand-ins for the libraries, since none of these or a model is at hand here.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

GLYPHS = "path string, page_index int, pos long, text string, x0 double, y0 double, x1 double, y1 double, size double, font string, color int, flags int, error_code string"


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the PDF files below ``folder``, from any store that Spark reads."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(folder).select("path", "content")


def _glyphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    try:
        import pymupdf
    except ImportError as problem:
        raise RuntimeError("reading PDF glyphs needs the pymupdf package on every executor") from problem

    names = [field.split(" ")[0] for field in GLYPHS.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), *[pa.float64()] * 5, pa.string(), pa.int32(), pa.int32(), pa.string()]
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            rows: list[tuple] = []
            try:
                pdf = pymupdf.open(stream=content, filetype="pdf")
                error = "ENCRYPTED" if pdf.needs_pass else None
            except Exception:  # any unreadable file is a data-quality outcome, not a failed task
                pdf, error = None, "CANNOT_OPEN"
            if error:
                rows.append((path, None, None, None, *[None] * 8, error))
            else:
                for page in pdf:
                    # Boxes in the coordinates that drawing uses.
                    page.set_rotation(0)
                    pos = 0
                    for block in page.get_text("rawdict")["blocks"]:
                        for line in block.get("lines", ()):
                            dx, dy = (*line.get("dir", (1, 0)), 1, 0)[:2]
                            if abs(dx - 1) >= 0.05 or abs(dy) >= 0.05:
                                continue
                            for span in line["spans"]:
                                for char in span["chars"]:
                                    rows.append((path, page.number, pos, char["c"], *map(float, char["bbox"]), float(span.get("size", 0)), span.get("font", ""), span.get("color", 0), span.get("flags", 0), None))
                                    pos += 1
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=names)


def pdf_glyphs(files: DataFrame) -> DataFrame:
    """Glyph rows of PDF files; unreadable ones give one row with an error code."""
    return files.mapInArrow(_glyphs, GLYPHS)


def _recognised(batches: Iterator[pa.RecordBatch], command: str, language: str, timeout: int) -> Iterator[pa.RecordBatch]:
    import subprocess

    def read(png: bytes) -> str | None:
        try:
            return subprocess.run([command, "stdin", "stdout", "-l", language, "--psm", "3", "tsv"], input=png, capture_output=True, timeout=timeout, check=True).stdout.decode("utf-8", "replace")
        except (OSError, subprocess.SubprocessError):
            return None

    for batch in batches:
        out = [read(png) for png in batch.column("png").to_pylist()]
        errors = ["OCR_UNAVAILABLE" if text is None else None for text in out]
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "page_index": batch.column("page_index"), "tsv": pa.array(out, pa.string()), "error_code": pa.array(errors, pa.string())})


def recognised(pages: DataFrame, command: str = "tesseract", language: str = "eng", timeout: int = 120) -> DataFrame:
    """(doc_id, page_index, tsv, error_code) of page images ``pages(doc_id, page_index, png)``, one process a page."""
    return pages.mapInArrow(lambda b: _recognised(b, command, language, timeout), "doc_id long, page_index int, tsv string, error_code string")


def _translated(batches: Iterator[pa.RecordBatch], folder: str, beam: int) -> Iterator[pa.RecordBatch]:
    try:
        import ctranslate2
        import sentencepiece
    except ImportError as problem:
        raise RuntimeError("translation needs ctranslate2 and sentencepiece on every executor") from problem

    from folioflow.operators.translate import BATCH

    try:
        source, target = (sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{side}.spm") for side in ("source", "target"))
        model = ctranslate2.Translator(folder, compute_type="int8")
    except Exception:  # a model that does not load fails its sentences, not the job
        for batch in batches:
            yield batch.append_column("translation", pa.nulls(batch.num_rows, pa.string()))
        return
    for batch in batches:
        texts = batch.column("sentence").to_pylist()
        tokens = source.encode(texts, out_type=str)
        order = sorted((i for i, t in enumerate(tokens) if t), key=lambda i: len(tokens[i]))
        out = list(texts)
        while order:
            low = len(tokens[order[0]])
            group = [i for i in order[:BATCH] if len(tokens[i]) <= 2 * low]
            order = order[len(group) :]
            cap = max(16, 3 * len(tokens[group[-1]]) + 8)
            try:
                done = model.translate_batch([tokens[i] for i in group], beam_size=beam, max_decoding_length=cap, repetition_penalty=1.1, no_repeat_ngram_size=4, replace_unknowns=True)
                made = [target.decode(d.hypotheses[0]) for d in done]
            except Exception:  # these sentences have failed, the others go on
                made = [None] * len(group)
            for i, text in zip(group, made):
                out[i] = text
        yield batch.append_column("translation", pa.array(out, pa.string()))


def model(folder: str, beam: int = 2):
    """A sentence model for ``folioflow.operators.translate`` from a converted model folder that every executor can read.

    Sentences of similar length share a partition, so that batches need little padding. What
    fails has a null translation.
    """

    def translate(sentences: DataFrame) -> DataFrame:
        from pyspark.sql import functions as F

        key = [c for c in ("pair", "sentence") if c in sentences.columns]
        near = sentences.select(*key).repartitionByRange(F.length("sentence"), "sentence").sortWithinPartitions(F.length("sentence").desc())
        return near.mapInArrow(lambda b: _translated(b, folder, beam), ", ".join(f"{c} string" for c in (*key, "translation")))

    return translate
