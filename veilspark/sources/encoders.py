"""Text encoders for detectors and features, loaded in each worker when first used."""

from __future__ import annotations

import threading
from collections.abc import Callable
from pathlib import Path

import numpy as np

_lock = threading.Lock()
_loaded: dict[tuple[str, Callable], object] = {}


def model_folder(path: str) -> Path:
    """The folder that holds config.json: ``path`` or its only subfolder with one."""
    base = Path(path)
    if (base / "config.json").is_file():
        return base
    found = sorted(d for d in base.iterdir() if d.is_dir() and (d / "config.json").is_file()) if base.is_dir() else []
    if len(found) != 1:
        raise ValueError(f"{len(found)} folders with a config.json in {path}; one is needed")
    return found[0]


def sentence_model(folder: Path):
    """A sentence-transformers model, where that library is installed."""
    from sentence_transformers import SentenceTransformer

    model = SentenceTransformer(str(folder))
    return lambda texts: model.encode(list(texts), show_progress_bar=False, convert_to_numpy=True, normalize_embeddings=True)


class Encoder:
    """texts -> rows of unit length; an empty text is a row of zeros.

    Only ``path`` and ``load`` are sent to the workers; each loads its model at
    the first use, once, whatever the number of threads.
    """

    def __init__(self, path: str, load: Callable[[Path], Callable[[list[str]], np.ndarray]] = sentence_model):
        self.path, self.load = path, load

    def model(self) -> Callable[[list[str]], np.ndarray]:
        key = (self.path, self.load)
        with _lock:
            if key not in _loaded:
                _loaded[key] = self.load(model_folder(self.path))
            return _loaded[key]

    def __call__(self, texts: list[str]) -> np.ndarray:
        some = [t for t in texts if t]
        rows = np.asarray(self.model()(some or ["x"]), np.float64)
        rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
        out = np.zeros((len(texts), rows.shape[1]))
        if some:
            out[[bool(t) for t in texts]] = rows
        return out
