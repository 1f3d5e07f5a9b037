"""Experiment specifications: JSON with loads, defaults and overrides."""

from __future__ import annotations

import json
from pathlib import Path


def merged(base: object, over: object) -> object:
    """over on base: objects by key, anything else as a whole."""
    if isinstance(base, dict) and isinstance(over, dict):
        return {k: merged(base[k], over[k]) if k in base and k in over else over.get(k, base.get(k)) for k in [*base, *(k for k in over if k not in base)]}
    return over


def find(name: str, folder: Path) -> Path:
    path = Path(name) if name.startswith("/") else folder / name
    return path if path.suffix == ".json" else path.with_name(path.name + ".json")


def read(path: str | Path, folder: str | Path, _open: tuple = ()) -> dict:
    """A specification. Lines `load x` above its object name files of the folder that it extends, in order; a text value `load x`
    stands for what that file holds. A file that loads itself raises."""
    path, folder = Path(path), Path(folder)
    if path in _open:
        raise ValueError(f"{path} loads itself")
    lines, out = path.read_text(encoding="utf-8").splitlines(), {}
    at = next((i for i, x in enumerate(lines) if x.lstrip().startswith("{")), len(lines))
    for line in lines[:at]:
        if line.strip():
            word, _, name = line.strip().partition(" ")
            if word != "load" or not name:
                raise ValueError(f"{path}: not a load: {line!r}")
            out = merged(out, read(find(name.strip(), folder), folder, (*_open, path)))

    def filled(x: object) -> object:
        if isinstance(x, dict):
            return {k: filled(v) for k, v in x.items()}
        if isinstance(x, list):
            return [filled(v) for v in x]
        if isinstance(x, str) and x.startswith("load "):
            return read(find(x[5:].strip(), folder), folder, (*_open, path))
        return x

    body = "\n".join(lines[at:]).strip()
    return merged(out, filled(json.loads(body))) if body else out


def found(folder: str | Path, filters: list[str] = (), finished: str | Path | None = None) -> list[Path]:
    """Specifications under a folder in order whose name holds a filter, if there are any, but for those with results."""
    folder = Path(folder)
    out = []
    for path in sorted(folder.rglob("*.json")):
        name = str(path.relative_to(folder).with_suffix(""))
        if filters and not any(f in name for f in filters):
            continue
        if finished is not None and (Path(finished) / name).exists():
            continue
        out.append(path)
    return out


def known_keys(spec: dict, keys: list[str], where: str) -> None:
    """Raises for a key that nothing reads, so that a slip of the pen is no default."""
    extra = sorted(set(spec) - set(keys))
    if extra:
        raise ValueError(f"unknown keys in {where}: {', '.join(extra)}; known: {', '.join(keys)}")
