"""Run configurations: checked values, read from a small text."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

from assayer.sources.files import BadSource


def _scalar(text: str):
    text = text.strip()
    if text.startswith("[") and text.endswith("]"):
        return tuple(_scalar(x) for x in text[1:-1].split(",") if x.strip())
    if text[:1] in "'\"" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    try:
        return json.loads(text)
    except ValueError:
        return {"~": None, "": None, "yes": True, "no": False}.get(text, text)


def parse(text: str) -> dict:
    """Nested ``key: value`` lines by indentation, ``- item`` lists, comments; the part of YAML that configurations use."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in (line.split(" #")[0].rstrip() for line in text.splitlines())]
    lines = [(n, x) for n, x in lines if x and not x.startswith("#")]

    def block(i: int, depth: int):
        if i < len(lines) and lines[i][1].startswith("- "):
            out = []
            while i < len(lines) and lines[i][0] == depth and lines[i][1].startswith("- "):
                out.append(_scalar(lines[i][1][2:]))
                i += 1
            return tuple(out), i
        out: dict = {}
        while i < len(lines) and lines[i][0] == depth:
            key, colon, rest = lines[i][1].partition(":")
            if not colon or key in out:
                raise BadSource(f"not a key of its own: {lines[i][1]}")
            i += 1
            if rest.strip():
                out[key] = _scalar(rest)
            elif i < len(lines) and (lines[i][0] > depth or lines[i][0] == depth and lines[i][1].startswith("- ")):
                out[key], i = block(i, lines[i][0])
            else:
                out[key] = None
        if i < len(lines) and lines[i][0] > depth:
            raise BadSource(f"indented too far: {lines[i][1]}")
        return out, i

    found, end = block(0, 0) if lines else ({}, 0)
    if end < len(lines):
        raise BadSource(f"unexpected: {lines[end][1]}")
    return found


def read_config(spark: SparkSession, path: str, kind: type):
    """A configuration of the given dataclass, from a file in any store that Spark reads; unknown keys are an error."""
    values = parse(spark.read.text(path, wholetext=True).first()[0])
    if unknown := set(values) - {f.name for f in fields(kind)}:
        raise BadSource(f"unknown keys {sorted(unknown)}")
    return kind(**values)


def whole(name: str, value, least: int, most: int | None = None) -> None:
    """An error unless the value is an int, which a bool isn't, within bounds."""
    if type(value) is not int or value < least or (most is not None and value > most):
        raise ValueError(f"{name} must be a whole number from {least}{f' to {most}' if most is not None else ''}, not {value!r}")


def share(name: str, value) -> None:
    if type(value) not in (int, float) or not 0 <= value <= 1:
        raise ValueError(f"{name} must be a share from 0 to 1, not {value!r}")


@dataclass(frozen=True)
class Windowing:
    """A window grid with smoothing; lengths in samples."""

    length: int
    hop: int
    smoothing: int = 1
    guard: int = 0

    def __post_init__(self) -> None:
        whole("length", self.length, 1)
        whole("hop", self.hop, 1, self.length)
        whole("guard", self.guard, 0)
        if type(self.smoothing) is not int or self.smoothing not in (1, 3):
            raise ValueError("smoothing must be 1 or 3")


@dataclass(frozen=True)
class Edits:
    """Where an edit may lie: its length, the crossfade at both ends, and the share of it that must be active."""

    length: int
    fade: int
    active: float
    seed: int = 0

    def __post_init__(self) -> None:
        whole("length", self.length, 1)
        whole("fade", self.fade, 0, (self.length - 1) // 2)
        whole("seed", self.seed, 0)
        share("active", self.active)


def find_folder(spark: SparkSession, root: str, holds: str, depth: int = 4) -> str:
    """The first folder, by depth and then name, that holds a file of this name; an error that says what was found else."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(root).getFileSystem(spark._jsc.hadoopConfiguration())
    level, seen = [root.rstrip("/")], []
    for _ in range(depth + 1):
        for folder in level:
            if fs.exists(hadoop(f"{folder}/{holds}")):
                return folder
        seen += level
        level = sorted(s.getPath().toString() for folder in level for s in fs.listStatus(hadoop(folder)) if s.isDirectory())
    raise BadSource(f"no folder below {root} holds {holds}; looked into {seen[:20]}")
