"""A ledger of stages, so that a run goes on where it stopped."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterable


def job_fingerprint(settings: Iterable[str], inputs: Iterable[tuple[str, int, str]]) -> str:
    """SHA-256 of settings and of inputs ``(path, size, sha256)`` in the order given, every field ended by a NUL."""
    digest = hashlib.sha256()
    for field in [*settings, *(str(x) for row in inputs for x in row)]:
        digest.update(field.encode() + b"\0")
    return digest.hexdigest()


class Ledger:
    """Finished stages under a folder: a stage is skipped if its mark has the job's fingerprint and its outputs are there."""

    def __init__(self, folder: str, fingerprint: str):
        self.folder, self.fingerprint = folder, fingerprint
        os.makedirs(folder, exist_ok=True)

    def _mark(self, stage: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_-]+", stage):
            raise ValueError(f"not a name of a stage: {stage}")
        return os.path.join(self.folder, f"{stage}.json")

    def done(self, stage: str) -> bool:
        try:
            with open(self._mark(stage)) as f:
                mark = json.load(f)
        except (OSError, ValueError):
            return False
        return mark.get("fingerprint") == self.fingerprint and all(map(os.path.exists, mark.get("outputs", [])))

    def run(self, stage: str, work: Callable[[], None], outputs: list[str]) -> bool:
        """Whether the work was needed; the mark is written aside and renamed once all outputs are there."""
        if self.done(stage):
            return False
        work()
        missing = [p for p in outputs if not os.path.exists(p)]
        if missing:
            raise RuntimeError(f"stage {stage} left out {missing}")
        with open(self._mark(stage) + ".tmp", "w") as f:
            json.dump({"fingerprint": self.fingerprint, "outputs": outputs}, f)
        os.replace(self._mark(stage) + ".tmp", self._mark(stage))
        return True


def last_json_line(text: str) -> dict | None:
    """The last line of a log that is a JSON object."""
    for line in reversed(text.splitlines()):
        try:
            value = json.loads(line)
        except ValueError:
            continue
        if isinstance(value, dict):
            return value
    return None
