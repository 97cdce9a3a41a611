"""Positioned text from PDF bytes: inflated streams, ToUnicode maps, text-showing operators.

One file gives many rows, so this is a ``mapInPandas`` over (path, content); everything after it is relational.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_STREAM = re.compile(rb"stream\r?\n")
_CHAR = re.compile(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>")
_RANGE = re.compile(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[([^\]]*)\])")
_NUMBER = r"[-+]?[0-9]*\.?[0-9]+"
_SHOW = re.compile(rf"((?:{_NUMBER}\s+){{6}})Tm|(?:<([0-9A-Fa-f\s]*)>|(\())\s*(?:Tj)?", re.S)


def streams(data: bytes) -> list[bytes]:
    """Contents of all streams, inflated where they are compressed; a stream without an end runs to the file's end."""
    out = []
    for m in _STREAM.finditer(data):
        end = data.find(b"endstream", m.end())
        raw = data[m.end():end if end >= 0 else len(data)]
        try:
            out.append(zlib.decompressobj().decompress(raw))
        except zlib.error:
            out.append(raw)
    return out


def utf16(hexa: str) -> str:
    digits = re.sub(r"\s", "", hexa)
    return bytes.fromhex(digits + "0" * (len(digits) % 2)).decode("utf-16-be", "replace")


def unicode_map(contents: list[bytes]) -> dict[int, str]:
    """Codes to text from all bfchar and bfrange sections; a later definition of a code counts."""
    table: dict[int, str] = {}
    for raw in contents:
        text = raw.decode("latin-1")
        for body in re.findall(r"beginbfchar(.*?)endbfchar", text, re.S):
            table.update((int(a, 16), utf16(b)) for a, b in _CHAR.findall(body))
        for body in re.findall(r"beginbfrange(.*?)endbfrange", text, re.S):
            for lo, hi, first, listed in _RANGE.findall(body):
                codes = range(int(lo, 16), min(int(hi, 16), int(lo, 16) + 0xFFFF) + 1)
                targets = [utf16(x) for x in re.findall(r"<([0-9A-Fa-f]+)>", listed)] if listed else None
                for i, c in enumerate(codes):
                    if targets is not None:
                        if i < len(targets):
                            table[c] = targets[i]
                    else:
                        table[c] = utf16(f"{int(first, 16) + i:0{len(first)}X}")
    return table


def literal(text: str, at: int) -> tuple[str, int]:
    """A string in parentheses that opens at ``at``, with escapes, octal codes and nesting; and the place after it."""
    out, depth, i = [], 0, at
    plain = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            octal = re.compile(r"[0-7]{1,3}").match(text, i + 1)
            if octal:
                out.append(chr(int(octal.group(), 8) & 0xFF))
                i = octal.end()
                continue
            if text[i + 1] not in "\r\n":
                out.append(plain.get(text[i + 1], text[i + 1]))
            i += 2
            continue
        if c == "(":
            depth += 1
            if depth > 1:
                out.append(c)
        elif c == ")":
            depth -= 1
            if depth == 0:
                return "".join(out), i + 1
            out.append(c)
        else:
            out.append(c)
        i += 1
    return "".join(out), i


def decoded(raw: bytes, table: dict[int, str]) -> str:
    """Bytes of a shown string: two-byte codes of the map, UTF-16 with its mark, else Latin-1."""
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace")
    if table and len(raw) % 2 == 0:
        codes = [raw[i] << 8 | raw[i + 1] for i in range(0, len(raw), 2)]
        if any(c in table for c in codes):
            return "".join(table.get(c, "") for c in codes)
    return raw.decode("latin-1")


def positioned(data: bytes) -> list[tuple[str, float, float]]:
    """(text, x, y) of all strings shown after a text matrix, in the order of the file; blank ones are left out."""
    contents = streams(data)
    table = unicode_map(contents)
    out = []
    for raw in contents:
        text = raw.decode("latin-1")
        x = y = None
        at = 0
        while m := _SHOW.search(text, at):
            at = m.end()
            if m.group(1):
                x, y = (float(v) for v in m.group(1).split()[4:6])
                continue
            if m.group(3):
                shown, at = literal(text, m.start(3))
                said = decoded(shown.encode("latin-1", "replace"), table)
            else:
                digits = re.sub(r"\s", "", m.group(2))
                said = decoded(bytes.fromhex(digits + "0" * (len(digits) % 2)), table)
            if x is not None and said.strip():
                out.append((said.strip(), x, y))
    return out


def extract_positioned(files: DataFrame) -> DataFrame:
    """Rows (name, seq, text, x, y) of the files (name, content). Files that are no PDF give no rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(name, i, *item) for name, data in zip(frame["name"], frame["content"]) if data is not None and bytes(data[:4]) == b"%PDF" for i, item in enumerate(positioned(bytes(data)))]
            yield pd.DataFrame(rows, columns=["name", "seq", "text", "x", "y"])

    return files.select("name", "content").mapInPandas(run, "name string, seq int, text string, x double, y double")
