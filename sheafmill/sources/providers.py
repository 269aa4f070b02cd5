"""The provider boundary: what needs an external model is a named function on a batch of rows, with deterministic stand-ins.

A ladder tries providers in order, each only on the rows that those before it left; a lost row keeps its input as output and ``ok`` false.
"""

from __future__ import annotations

import io
import re
import wave
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

Provider = Callable[[pd.Series], pd.Series]
_REGISTRY: dict[str, Provider] = {}


def register(name: str, provider: Provider) -> None:
    """A provider maps inputs to outputs, with None where it fails."""
    _REGISTRY[name] = provider


def echo(texts: pd.Series) -> pd.Series:
    return texts


def upper(texts: pd.Series) -> pd.Series:
    return texts.str.upper().where(texts.str.len() % 2 == 0, None)


def fails(texts: pd.Series) -> pd.Series:
    return pd.Series([None] * len(texts), index=texts.index, dtype=object)


for _name, _provider in (("echo", echo), ("upper", upper), ("fails", fails)):
    register(_name, _provider)


def ladder(rows: DataFrame, text: str, names: list[str]) -> DataFrame:
    """``rows`` with output, provider and ok: the first provider's answer that is neither null nor blank."""
    steps = [(n, _REGISTRY[n]) for n in names]
    schema = StructType([*rows.schema, *StructType.fromDDL("output string, provider string, ok boolean")])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = pd.Series([None] * len(f), index=f.index, dtype=object)
            used = pd.Series([None] * len(f), index=f.index, dtype=object)
            for name, call in steps:
                left = out.isna() & f[text].notna()
                if not left.any():
                    break
                got = call(f.loc[left, text])
                good = got.notna() & (got.fillna("").astype(str).str.strip() != "")
                out.loc[got.index[good]] = got[good]
                used.loc[got.index[good]] = name
            yield f.assign(output=out.where(out.notna(), f[text]), provider=used, ok=out.notna())

    return rows.mapInPandas(run, schema)


def plain_pdf_text(content: bytes) -> list[str]:
    """A stand-in for a PDF library: the shown strings of each content stream, plain or deflated."""
    pages = []
    for body in re.findall(rb"stream\r?\n(.*?)endstream", content, re.S):
        try:
            body = zlib.decompress(body)
        except zlib.error:
            pass
        shown = re.findall(rb"\(((?:[^()\\]|\\.)*)\)\s*Tj", body)
        if shown:
            pages.append("\n".join(re.sub(rb"\\(.)", rb"\1", s).decode("latin-1") for s in shown))
    if not content.startswith(b"%PDF"):
        raise ValueError("no PDF")
    return pages


def pdf_pages(files: DataFrame, provider: Callable[[bytes], list[str]] = plain_pdf_text) -> DataFrame:
    """path, page_no and the stripped text of each page of (path, content); a file that the provider fails on has no pages."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                try:
                    texts = provider(content)
                except Exception:  # whatever a library raises: the page images are read instead
                    texts = []
                yield pd.DataFrame({"path": [path] * len(texts), "page_no": range(len(texts)), "text": [t.strip() for t in texts]}).astype({"page_no": "int32", "path": object, "text": object})

    return files.select("path", "content").mapInPandas(run, "path string, page_no int, text string")


def page_images(files: DataFrame, provider: Callable[[bytes, int], list[bytes]], dpi: int = 150) -> DataFrame:
    """path, page_no, dpi, image and error of each page of (path, content), as the provider draws it; a file that it fails on is one row with the reason."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                try:
                    drawn = [(path, i, dpi, image, None) for i, image in enumerate(provider(content, dpi))]
                except Exception as e:  # whatever a library raises is this file's alone
                    drawn = [(path, None, dpi, None, str(e))]
                yield pd.DataFrame(drawn, columns=["path", "page_no", "dpi", "image", "error"]).astype({"page_no": "Int32", "dpi": "int32", "path": object, "image": object, "error": object})

    return files.select("path", "content").mapInPandas(run, "path string, page_no int, dpi int, image binary, error string")


def mono_16k(content: bytes) -> bytes:
    """A stand-in for an audio library: 16-bit PCM WAV of any rate and channels as 16 kHz mono."""
    with wave.open(io.BytesIO(content)) as w:
        channels, rate, raw = w.getnchannels(), w.getframerate(), np.frombuffer(w.readframes(w.getnframes()), dtype="<i2")
    x = raw.reshape(-1, channels).mean(axis=1)
    n = int(len(x) * 16_000 / rate)
    y = np.interp(np.arange(n) * rate / 16_000, np.arange(len(x)), x) if len(x) else np.zeros(0)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, 2, 16_000, n, "NONE", ""))
        w.writeframes(np.round(y).astype("<i2").tobytes())
    return out.getvalue()


def normalized_audio(files: DataFrame, provider: Callable[[bytes], bytes] = mono_16k) -> DataFrame:
    """path, audio, ok and error of (path, content); a recording that cannot be converted says why."""

    def one(content: bytes) -> tuple[bytes | None, str | None]:
        try:
            return provider(content), None
        except Exception as e:  # whatever a library raises
            return None, f"Audio normalization failed: {e}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [one(c) for c in f["content"]]
            yield pd.DataFrame({"path": f["path"], "audio": [a for a, _ in made], "ok": [a is not None for a, _ in made], "error": [e for _, e in made]})

    return files.select("path", "content").mapInPandas(run, "path string, audio binary, ok boolean, error string")


def encoded_images(images: DataFrame, provider: Callable[[bytes, int], bytes], quality: int = 92) -> DataFrame:
    """path and image of (path, image), as the provider encodes it for an upload; one that it fails on is null."""

    def one(image: bytes) -> bytes | None:
        try:
            return provider(image, quality)
        except Exception:  # whatever a library raises
            return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": f["path"], "image": f["image"].map(one)})

    return images.select("path", "image").mapInPandas(run, "path string, image binary")
