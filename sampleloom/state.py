"""The seed of random operations that aren't given one, and versions."""

from __future__ import annotations

import importlib.metadata

from sampleloom import __version__

_seed = 0


def set_state(seed: int = 1234) -> None:
    """The seed for what is planned from now on; plans that exist keep theirs."""
    global _seed
    _seed = int(seed)


def pick(seed: int | None) -> int:
    """The given seed, or the one of the state."""
    return _seed if seed is None else int(seed)


def version() -> str:
    return __version__


def libs_version() -> dict[str, str]:
    """Versions of the libraries that are there."""
    found = {}
    for name in ("pyspark", "pyarrow", "numpy", "pandas", "sentencepiece", "zstandard"):
        try:
            found[name] = importlib.metadata.version(name)
        except importlib.metadata.PackageNotFoundError:
            pass
    return found
