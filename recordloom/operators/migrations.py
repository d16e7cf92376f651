"""Forward-only schema versions of a store: an application id, an ordered history of steps, and their checksums."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable
from dataclasses import dataclass

APPLICATION = "recordloom-store"


class MigrationError(ValueError):
    pass


@dataclass(frozen=True)
class Step:
    """A version's name, its definition (what the checksum covers) and the function that applies it to a store's root."""

    version: int
    name: str
    definition: str
    apply: Callable[[str], None]

    @property
    def checksum(self) -> str:
        return hashlib.sha256(self.definition.encode()).hexdigest()


def read_history(root: str) -> list[dict]:
    path = os.path.join(root, "schema.json")
    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8") as f:
        state = json.load(f)
    if state.get("application") != APPLICATION:
        raise MigrationError(f"{root} is a store of another application")
    return state["history"]


def check_history(history: list[dict], steps: list[Step]) -> None:
    """The history must be the first steps, one after the other, with their names and checksums."""
    if len(history) > len(steps):
        raise MigrationError(f"the store has version {history[-1]['version']}, newer than {len(steps)}")
    for row, step in zip(history, steps, strict=False):
        if (row["version"], row["name"], row["sha256"]) != (step.version, step.name, step.checksum):
            raise MigrationError(f"version {row['version']} of the store isn't as it was applied")


def migrate(root: str, steps: list[Step]) -> list[dict]:
    """Apply the steps that the store lacks, in order. A step counts once the history that names it is in place."""
    if [s.version for s in steps] != list(range(1, len(steps) + 1)) or len({s.name for s in steps}) != len(steps):
        raise MigrationError("steps are numbered from 1 and have names of their own")
    history = read_history(root)
    check_history(history, steps)
    os.makedirs(root, exist_ok=True)
    for step in steps[len(history) :]:
        step.apply(root)
        history.append({"version": step.version, "name": step.name, "sha256": step.checksum})
        part = os.path.join(root, ".schema.json.part")
        with open(part, "w", encoding="utf-8") as f:
            json.dump({"application": APPLICATION, "history": history}, f, indent=2)
        os.replace(part, os.path.join(root, "schema.json"))
    return history
