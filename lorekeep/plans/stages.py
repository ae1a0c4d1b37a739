"""Stage runs with a critical first step and resume."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from pathlib import Path

DONE = ("success", "skipped")


def run_flow(steps: list[tuple[str, Callable[[], object]]], critical_first: bool = True) -> list[tuple[str, str, str]]:
    """(name, status, error) of steps in order: a failing first step ends the flow, later failures don't."""
    out: list[tuple[str, str, str]] = []
    for i, (name, step) in enumerate(steps):
        if out and critical_first and out[0][1] == "failed":
            out.append((name, "skipped", ""))
            continue
        try:
            step()
            out.append((name, "success", ""))
        except Exception as e:
            out.append((name, "failed", str(e) or type(e).__name__))
            if i == 0 and critical_first:
                continue
    return out


class Orchestrator:
    """Stages with a state file and a lock; a run resumes behind what is done, and skipped counts as done."""

    def __init__(self, state: str) -> None:
        self.file, self.lock = Path(state), Path(state + ".lock")

    def load(self) -> dict[str, dict]:
        return json.loads(self.file.read_text()) if self.file.exists() else {}

    def run(self, stages: list[tuple[str, Callable[[], object]]], again: bool = False) -> dict[str, dict]:
        self.file.parent.mkdir(parents=True, exist_ok=True)
        try:
            self.lock.touch(exist_ok=False)
        except FileExistsError:
            raise RuntimeError("another run holds the lock") from None
        try:
            state = {} if again else self.load()
            for name, stage in stages:
                if state.get(name, {}).get("status") in DONE:
                    state[name]["status"] = "skipped"
                    continue
                began = time.time()
                try:
                    stage()
                    state[name] = {"status": "success", "seconds": round(time.time() - began, 3)}
                except Exception as e:
                    state[name] = {"status": "failed", "error": str(e) or type(e).__name__}
                    break
                finally:
                    self.file.write_text(json.dumps(state))
            self.file.write_text(json.dumps(state))
            return state
        finally:
            self.lock.unlink()
