"""Single files on the driver's disk: targets are checked before work begins, and written by way of a part beside them, so
that a reader sees the old file or the new one and never half of either."""

from __future__ import annotations

import os
import shutil
import uuid
from pathlib import Path

BACKUP = ".bak"


def resolved(path: str | Path) -> Path:
    """Absolute and without links; of a file that isn't there yet its folder's links are followed."""
    return Path(os.path.realpath(path))


def same_file(a: str | Path, b: str | Path) -> bool:
    """Whether both name one file, by links or otherwise; of files that aren't there, whether their names are equal."""
    if not str(a) or not str(b):
        return False
    try:
        return os.path.samefile(a, b)
    except OSError:
        return os.path.normpath(a) == os.path.normpath(b)


def check_writable(path: str | Path) -> Path:
    """The resolved path if a file can be written there; nothing is changed by the test."""
    if not str(path):
        raise ValueError("the path is empty")
    goal = resolved(path)
    if not goal.parent.is_dir():
        raise NotADirectoryError(f"no such folder: {goal.parent}")
    if goal.is_dir():
        raise IsADirectoryError(f"a folder: {goal}")
    if goal.exists():
        with goal.open("ab"):
            return goal
    probe = goal.with_name(f".{goal.name}.{uuid.uuid4().hex}.probe")
    probe.touch(exist_ok=False)
    probe.unlink()
    return goal


def check_new(path: str | Path) -> Path:
    """As check_writable(), for a target that must not be there yet."""
    if str(path) and resolved(path).exists():
        raise FileExistsError(f"already there: {path}")
    return check_writable(path)


def write_part(goal: Path, content: str) -> Path:
    """The content on disk, beside the goal."""
    part = goal.with_name(f".{goal.name}.{uuid.uuid4().hex}.part")
    try:
        with part.open("x", encoding="utf-8", newline="") as out:
            out.write(content)
            out.flush()
            os.fsync(out.fileno())
    except BaseException:
        part.unlink(missing_ok=True)
        raise
    return part


def put_new(part: Path, goal: Path) -> None:
    """The part becomes the goal, which must not be there: a link is made or fails as one step."""
    os.link(part, goal)
    part.unlink()


def create(path: str | Path, content: str) -> Path:
    """A new file; FileExistsError if there is one."""
    goal = check_new(path)
    part = write_part(goal, content)
    try:
        put_new(part, goal)
    finally:
        part.unlink(missing_ok=True)
    return goal


def publish(path: str | Path, content: str, target: str | Path | None = None, backup: bool = True, dry_run: bool = False) -> bool:
    """Writes target (else path itself). Nothing happens on a dry run or if it holds the content already. Before the input
    is overwritten, a copy with its mode and times goes to its whole name and BACKUP, in place of an older one. The new
    file keeps the old one's mode. Returns whether it was written."""
    source, goal = resolved(path), resolved(target or path)
    if dry_run or (goal.exists() and goal.read_bytes() == content.encode("utf-8")):
        return False
    check_writable(goal)
    if backup and goal.exists() and same_file(source, goal):
        kept = goal.with_name(goal.name + BACKUP)
        kept.unlink(missing_ok=True)
        shutil.copy2(goal, kept)
    part = write_part(goal, content)
    try:
        if goal.exists():
            shutil.copymode(goal, part)
        os.replace(part, goal)
    finally:
        part.unlink(missing_ok=True)
    return True
