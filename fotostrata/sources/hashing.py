"""Content hashes of files, streamed in chunks by the tasks; names that Spark's own sources hide are read like any others."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def hash_files(files: DataFrame, algorithm: str = "sha256", chunk: int = 1 << 20) -> DataFrame:
    """``files`` (path) with hash, streamed in chunks; null for a file that cannot be read."""
    if chunk <= 0:
        raise ValueError("the chunk size must be positive")

    def one(path: str) -> str | None:
        try:
            digest = hashlib.new(algorithm)
            with open(path, "rb") as file:
                while block := file.read(chunk):
                    digest.update(block)
            return digest.hexdigest()
        except OSError:
            return None

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "hash": [one(p) for p in batch["path"]]})

    return files.select("path").mapInPandas(hashed, "path string, hash string")
