"""Dictionary files: a text form for people, and a binary form that keeps ids.

A dictionary has a size the driver holds (see operators.dictionary), so its files are read and written there.
"""

from __future__ import annotations

import struct

from ..functions.bytestr import DELIMITER, END, MID, START, WHOLE, unescape_text
from ..operators.dictionary import Part, is_atom, listed_value, with_atoms
from ..session import file_system

MAGIC, VERSION = b"BDI2", 1  # fixed values
SECTION, MARK = "[delim]", "##"


def escape_text(value: str) -> str:
    """Control characters and backslashes written out."""
    names = {"\n": "\\n", "\t": "\\t", "\r": "\\r", "\\": "\\\\"}
    return "".join(names.get(c) or (f"\\x{ord(c):02X}" if c < " " or c == "\x7f" else c) for c in value)


def to_text(parts: list[Part]) -> str:
    """Parts of words, one a line, then [delim] and the delimiters; atoms are left out, they come back on reading."""
    own = [(k, v) for k, v in parts if not is_atom(k, v)]
    words = [listed_value(k, v) for k, v in own if k in (WHOLE, START, MID, END)]
    marks = [escape_text(v) for k, v in own if k == DELIMITER]
    return "".join(f"{line}\n" for line in (*words, SECTION, *marks))


def from_text(text: str) -> list[Part]:
    """The parts of a text form, atoms added."""
    parts: list[Part] = []
    marks = False
    for line in text.split("\n"):
        line = line.rstrip("\r")
        if not line:
            continue
        if line == SECTION:
            marks = True
        elif marks:
            parts.append((DELIMITER, unescape_text(line)))
        else:
            before, after = line.startswith(MARK), line.endswith(MARK)
            if before and after:
                if len(line) >= 4:
                    parts.append((MID, line[2:-2]))
            elif before:
                parts.append((END, line[2:]))
            elif after:
                parts.append((START, line[:-2]))
            else:
                parts.append((WHOLE, line))
    return with_atoms(parts)


def to_bytes(parts: list[Part]) -> bytes:
    """All parts but atoms in the order of their ids: kind, length, bytes."""
    out = [MAGIC, bytes((VERSION, 0, 0, 0))]
    for kind, value in parts:
        if is_atom(kind, value):
            continue
        raw = value.encode("latin-1")
        if len(raw) > 0xFFFF:
            raise ValueError("a part is longer than 65535 bytes")
        out += [struct.pack("<BH", kind, len(raw)), raw]
    return b"".join(out)


def from_bytes(data: bytes) -> list[Part]:
    """The parts of a binary form, atoms added."""
    if data[:4] != MAGIC:
        raise ValueError("this is no dictionary file")
    if len(data) < 8:
        raise ValueError("the header is cut off")
    if data[4] != VERSION:
        raise ValueError(f"version {data[4]} is not known")
    parts: list[Part] = []
    at = 8
    while at < len(data):
        if at + 3 > len(data):
            raise ValueError("a record's head is cut off")
        kind, size = struct.unpack_from("<BH", data, at)
        at += 3
        if kind > DELIMITER:
            raise ValueError(f"kind {kind} is not known")
        if at + size > len(data):
            raise ValueError("a record's value is cut off")
        parts.append((kind, data[at : at + size].decode("latin-1")))
        at += size
    return with_atoms(parts)


def save(parts: list[Part], path: str, form: str = "text") -> None:
    """Writes one file; form is text or binary."""
    data = to_bytes(parts) if form == "binary" else to_text(parts).encode("latin-1")
    fs, at = file_system(path)
    with fs.open_output_stream(at) as f:
        f.write(data)


def load(path: str, form: str = "text") -> list[Part]:
    fs, at = file_system(path)
    with fs.open_input_stream(at) as f:
        data = f.read()
    return from_bytes(data) if form == "binary" else from_text(data.decode("latin-1"))
