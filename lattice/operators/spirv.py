"""Specialization constants of SPIR-V modules, as a table function over binary files.

Walks the instruction stream (little header of five words, then words of count and opcode) of the public SPIR-V format up to the first
function, and reports what the decorations, names, types and constants say about every specialization id.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Fixed values of the SPIR-V format.
MAGIC = 0x07230203
NAME, TYPE_BOOL, TYPE_INT, TYPE_FLOAT, SPEC_TRUE, SPEC_FALSE, SPEC_CONSTANT, FUNCTION, DECORATE = 5, 20, 21, 22, 48, 49, 50, 54, 71
SPEC_ID = 1
#: Fewest words after the first of the instructions that are read.
LEAST_ARGS = {NAME: 1, TYPE_BOOL: 1, TYPE_INT: 3, TYPE_FLOAT: 2, SPEC_TRUE: 2, SPEC_FALSE: 2, SPEC_CONSTANT: 3, DECORATE: 2}
FORMATS = {"i1": "b", "i2": "h", "i4": "i", "i8": "q", "u1": "B", "u2": "H", "u4": "I", "u8": "Q", "f2": "e", "f4": "f", "f8": "d"}

SCHEMA = "path string, spec_id long, dtype string, name string, itemsize int, default_value string"


def _instructions(data: bytes) -> Iterator[tuple[int, tuple[int, ...]]]:
    if len(data) < 20 or len(data) % 4:
        raise ValueError("not a whole SPIR-V module")
    words = struct.unpack(f"={len(data) // 4}I", data)
    if words[0] != MAGIC:
        raise ValueError("bad magic number")
    at = 5
    while at < len(words):
        count, op = words[at] >> 16, words[at] & 0xFFFF
        if count == 0:
            raise ValueError("an instruction of no words")
        if at + count > len(words):
            raise ValueError("a truncated instruction")
        if op == FUNCTION:
            return
        yield op, words[at + 1 : at + count]
        at += count


def _text(words: tuple[int, ...]) -> str:
    try:
        return struct.pack(f"={len(words)}I", *words).split(b"\0")[0].decode()
    except UnicodeDecodeError as e:
        raise ValueError("a name that isn't UTF-8") from e


def _number(raw: bytes, code: str, width: int) -> int | float | None:
    """The literal of a type, or None if it isn't one of FORMATS."""
    return struct.unpack(f"={FORMATS[code]}", raw[:width])[0] if code in FORMATS and len(raw) >= width else None


def specializations(data: bytes) -> list[dict]:
    """spec_id, dtype, name, itemsize and default of each specialization constant, by spec_id.

    An id whose type the module doesn't say has dtype ``unknown_type`` and size 0, one without a default a null; of an id that several
    targets bear the first counts.
    """
    names: dict[int, str] = {}
    kinds: dict[int, tuple[str, int]] = {}
    targets: dict[int, int] = {}
    values: dict[int, tuple[int, bytes | bool]] = {}
    for op, args in _instructions(data):
        if len(args) < LEAST_ARGS.get(op, 0) or op == DECORATE and args[1] == SPEC_ID and len(args) < 3:
            raise ValueError("a truncated instruction")
        if op == NAME:
            names[args[0]] = _text(args[1:])
        elif op == DECORATE and args[1] == SPEC_ID:
            targets.setdefault(args[2], args[0])
        elif op == TYPE_BOOL:
            kinds[args[0]] = ("?", 1)
        elif op == TYPE_INT:
            kinds[args[0]] = (f"{'i' if args[2] else 'u'}{args[1] // 8}", args[1] // 8)
        elif op == TYPE_FLOAT:
            kinds[args[0]] = (f"f{args[1] // 8}", args[1] // 8)
        elif op in (SPEC_TRUE, SPEC_FALSE):
            values[args[1]] = (args[0], op == SPEC_TRUE)
        elif op == SPEC_CONSTANT:
            values[args[1]] = (args[0], struct.pack(f"={len(args) - 2}I", *args[2:]))
    out = []
    for spec_id, target in sorted(targets.items()):
        kind, value = values.get(target, (None, None))
        code, width = kinds.get(kind, ("unknown_type", 0))
        default = _number(value, code, width) if isinstance(value, bytes) else value
        out.append({"spec_id": spec_id, "dtype": code, "name": names.get(target, f"unnamed_spec_const_{spec_id}"), "itemsize": width, "default_value": None if default is None else str(default)})
    return out


def parse_modules(files: DataFrame) -> DataFrame:
    """(path, content) as spark.read.format("binaryFile") gives them, to a row for each specialization constant."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [{"path": p, **r} for p, c in zip(f["path"], f["content"], strict=True) for r in specializations(bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "spec_id", "dtype", "name", "itemsize", "default_value"])

    return files.select("path", "content").mapInPandas(run, SCHEMA)
