"""The writing side of a spool: bundles that appear whole or not at all, and what a crash leaves behind.

A spool is a folder on the machine that captures; bundles in it are folders, published by renaming. Identical components are linked where the file system can.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from pathlib import Path

from ..functions.strict_json import problem
from ..functions.text import RELATIVE_PATH_FAULTS
from ..sources.schemas import BUNDLE_KEYS, MAX_ALL, MAX_COMPONENTS, MAX_MANIFEST, MAX_ONE
from .ingest import spool_allows


def _synced(path: Path, data: bytes) -> None:
    with path.open("xb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())


def _sync_folder(path: Path) -> None:
    here = os.open(path, os.O_RDONLY)
    try:
        os.fsync(here)
    finally:
        os.close(here)


def _publish(folder: Path, name: Path) -> None:
    """Renames a folder to a name that nothing has yet."""
    if name.exists():
        raise FileExistsError(name)
    folder.rename(name)
    _sync_folder(name.parent)


def ready_name(session: str, sequence: int) -> str:
    return f"ready-{session}-{sequence:020d}"


def folder_bytes(folder: str | Path) -> int:
    return sum(p.stat().st_size for p in Path(folder).rglob("*") if p.is_file())


class SpoolWriter:
    def __init__(self, spool: str | Path, **limits: int) -> None:
        self.spool, self.limits = Path(spool), limits
        self.spool.mkdir(parents=True, exist_ok=True)
        self.held: dict[str, Path] = {}  # by digest, a published file

    def write(self, manifest: dict, components: dict[str, bytes]) -> Path:
        """Publishes a bundle of a manifest without components and these; refused if the spool is full, which is never emptied to make room."""
        if not spool_allows(shutil.disk_usage(self.spool).free, folder_bytes(self.spool), **self.limits):
            raise OSError("the spool is full")
        parts = {name: {"path": f"components/{hashlib.sha256(name.encode()).hexdigest()[:16]}", "algorithm": "sha256", "digest": hashlib.sha256(data).hexdigest(), "size": len(data)} for name, data in sorted(components.items())}
        text = json.dumps({**manifest, "components": parts}, indent=1).encode()
        if len(text) > MAX_MANIFEST:
            raise ValueError("the manifest is too large")
        hidden = self.spool / f".tmp-{uuid.uuid4()}"
        (hidden / "components").mkdir(parents=True)
        for name, part in parts.items():
            target, known = hidden / part["path"], self.held.get(part["digest"])
            try:
                if known is None:
                    raise FileNotFoundError
                os.link(known, target)
            except OSError:  # taken in meanwhile, or no links here: the bytes are written, as they would have been
                self.held.pop(part["digest"], None)
                _synced(target, components[name])
        _synced(hidden / "bundle.json", text)
        _sync_folder(hidden)
        ready = self.spool / ready_name(manifest["capture"]["session_id"], manifest["capture"]["sequence"])
        _publish(hidden, ready)
        for part in parts.values():
            self.held.setdefault(part["digest"], ready / part["path"])
        return ready


def bundle_fault(folder: Path) -> str | None:
    """What a bundle's folder lacks, None if it is whole."""
    try:
        raw = (folder / "bundle.json").read_bytes()
    except OSError:
        return "no manifest"
    if len(raw) > MAX_MANIFEST:
        return "the manifest is too large"
    if (fault := problem(raw, BUNDLE_KEYS)) is not None:
        return fault
    doc = json.loads(raw)
    capture, parts = doc.get("capture") or {}, doc.get("components") or {}
    if not isinstance(capture.get("session_id"), str) or not isinstance(capture.get("sequence"), int):
        return "no session and sequence"
    if not 0 < len(parts) <= MAX_COMPONENTS or sum(p.get("size", 0) for p in parts.values()) > MAX_ALL:
        return "no valid number or size of components"
    for name, part in parts.items():
        path = part.get("path") or ""
        if RELATIVE_PATH_FAULTS.search(path) or not 0 <= part.get("size", -1) <= MAX_ONE:
            return f"component {name} has no valid reference"
        file = folder / path
        if not file.is_file() or file.stat().st_size != part["size"] or hashlib.sha256(file.read_bytes()).hexdigest() != part.get("digest"):
            return f"component {name} is missing or altered"
    return None


def recover(spool: str | Path) -> dict[str, str | None]:
    """After a crash: whole bundles that were not published yet are, others are put aside. Of each the new name, and the fault if there is one; nothing is deleted."""
    spool, found = Path(spool), {}
    for hidden in sorted(p for p in spool.iterdir() if p.name.startswith(".tmp-")):
        fault = bundle_fault(hidden)
        if fault is None:
            capture = json.loads((hidden / "bundle.json").read_bytes())["capture"]
            ready = spool / ready_name(capture["session_id"], capture["sequence"])
            if ready.exists():
                fault = "its sequence was published already"
        target = ready if fault is None else spool / f"quarantine-{uuid.uuid4()}"
        _publish(hidden, target)
        found[target.name] = fault
    return found
