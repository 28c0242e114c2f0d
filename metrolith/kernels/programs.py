"""Engines that are programs of their own: found, probed and run where the fragments are, within bounds."""

from __future__ import annotations

import json
import os
import re
import resource
import shutil
import subprocess
import sys
import tempfile
import threading
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

SECONDS, MEMORY, KEPT = 30, 1 << 30, 10 << 20
CUT = "\n[output cut]"


@dataclass
class Outcome:
    code: int | None
    out: str = ""
    err: str = ""
    timed_out: bool = False
    cut: bool = False

    @property
    def ok(self) -> bool:
        return self.code == 0 and not self.timed_out


@dataclass
class _Stream:
    """Reads a pipe to its end, so that the child never waits on it, and keeps the first bytes."""

    pipe: object
    most: int
    kept: list[bytes] = field(default_factory=list)
    size: int = 0

    def drain(self) -> None:
        while block := self.pipe.read(1 << 16):
            if self.size < self.most:
                self.kept.append(block[: self.most - self.size])
            self.size += len(block)

    def text(self) -> str:
        return b"".join(self.kept).decode("utf-8", "replace") + (CUT if self.size > self.most else "")


def bounded(argv: list[str], given: str | None = None, folder: str | None = None, seconds: float = SECONDS, memory: int = MEMORY, kept: int = KEPT) -> Outcome:
    """Runs a program in a session of its own: killed with all its children after `seconds`, with `memory` bytes of
    address space, of each stream the first `kept` bytes; a program that isn't there has the code None."""

    def limits() -> None:
        hard = resource.getrlimit(resource.RLIMIT_AS)[1]
        resource.setrlimit(resource.RLIMIT_AS, (memory if hard == resource.RLIM_INFINITY else min(memory, hard), hard))

    try:
        child = subprocess.Popen(argv, cwd=folder, stdin=subprocess.PIPE if given is not None else subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.PIPE, start_new_session=True, preexec_fn=limits)
    except OSError as e:
        return Outcome(None, err=str(e))
    streams = [_Stream(child.stdout, kept), _Stream(child.stderr, kept)]
    threads = [threading.Thread(target=s.drain, daemon=True) for s in streams]
    for t in threads:
        t.start()
    late = False
    try:
        if given is not None:
            try:
                child.stdin.write(given.encode())
                child.stdin.close()
            except BrokenPipeError:
                pass
        child.wait(seconds)
    except subprocess.TimeoutExpired:
        late = True
    finally:
        try:
            os.killpg(child.pid, 9)
        except ProcessLookupError:
            pass
        child.wait()
    for t in threads:
        t.join(5)
    return Outcome(child.returncode, streams[0].text(), streams[1].text(), late, any(s.size > kept for s in streams))


def which(name: str) -> str | None:
    """A program beside the interpreter, else on the path."""
    beside = Path(sys.executable).with_name(name)
    return str(beside) if os.access(beside, os.X_OK) and beside.is_file() else shutil.which(name)


@lru_cache(maxsize=64)
def _answer(path: str, stamp: float) -> str | None:
    got = bounded([path, "--version"], seconds=60)
    return (got.out.strip() or got.err.strip()) if got.ok else None


def responds(path: str | None) -> str | None:
    """What a program says of its version; null if it doesn't run. Asked once while the file is the same."""
    try:
        return _answer(path, os.stat(path).st_mtime) if path else None
    except OSError:
        return None


class Program:
    """An engine that a program computes; `binary` may be replaced, as by tests."""

    binary = ""
    seconds = 60.0

    def probe(self) -> tuple[str | None, str | None]:
        """Path and version, null where it doesn't answer; asked on whatever machine this runs."""
        path = which(self.binary)
        said = responds(path)
        found = re.search(r"\d+(?:\.\d+)+", said or "")
        return path, found[0] if found else said

    def kernel(self, code: str) -> dict:
        """Its metrics of a text; none where the program isn't there, an error where it fails or takes too long."""
        path = which(self.binary)
        if responds(path) is None:
            return {}
        with tempfile.TemporaryDirectory(prefix="metrolith-") as folder:
            Path(folder, "fragment.py").write_text(code, encoding="utf-8")
            got = bounded([path, *self.arguments, "fragment.py"], folder=folder, seconds=self.seconds)
        if got.timed_out:
            raise TimeoutError(f"{self.binary} took more than {self.seconds:g} s")
        if not got.out.strip():
            raise RuntimeError(f"{self.binary} ended with {got.code} and no report: {got.err[:200]}")
        return self.read(got.out)

    arguments: tuple[str, ...] = ()

    def read(self, out: str) -> dict:
        raise NotImplementedError


class Lint(Program):
    binary = "pylint"
    arguments = ("--score=y", "--reports=n", "--msg-template={C}:{msg_id}", "--persistent=n")

    def read(self, out: str) -> dict:
        kinds = Counter(re.findall(r"^([CRWEF]):[A-Z]?\d+", out, re.M))
        rated = re.search(r"rated at (-?\d+(?:\.\d+)?)/10", out)
        return {"pylint_score": float(rated[1]) if rated else None, "pylint_convention": kinds["C"], "pylint_refactor": kinds["R"], "pylint_warning": kinds["W"], "pylint_error": kinds["E"] + kinds["F"]}


class Linters(Program):
    binary = "prospector"
    seconds = 180.0
    arguments = ("--output-format", "json", "--no-autodetect")
    tools = ("pylint", "pyflakes", "pycodestyle", "mccabe", "dodgy", "profile-validator")

    def read(self, out: str) -> dict:
        told = [m for m in json.loads(out).get("messages") or [] if isinstance(m, dict)]
        by = Counter(m.get("source") for m in told)
        counts = {f"prospector_{t.replace('-', '_')}": by[t] for t in self.tools}
        return {"prospector_messages": len(told), "prospector_fixable": sum(bool(m.get("isFixable")) for m in told), "prospector_tools_reporting": len(by), **counts}


ENGINES: dict[str, Program] = {"lint": Lint(), "linters": Linters()}
