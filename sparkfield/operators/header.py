"""The self-describing header: magic, metadata and mode, packed from the lowest bit."""

from __future__ import annotations

from dataclasses import dataclass

from .. import errors
from ..config import Config
from ..schema import META_BITS, Scalar, metadata_word, read_metadata

# Fixed values of the format: three letters and the version of the code.
MAGIC = int.from_bytes(b"zfp\x05", "little")
MAGIC_BITS = 32
SECTIONS = ("magic", "meta", "mode")


@dataclass(frozen=True)
class Header:
    bits: int
    kind: Scalar | None = None
    dims: tuple[int, ...] | None = None
    config: Config | None = None


def write_header(cfg: Config, kind: str | Scalar, dims, sections: tuple[str, ...] = SECTIONS) -> tuple[int, int]:
    """(value, bits). Nothing is written if any part cannot be."""
    parts = []
    if "magic" in sections:
        parts.append((MAGIC, MAGIC_BITS))
    if "meta" in sections:
        parts.append((metadata_word(kind, dims), META_BITS))
    if "mode" in sections:
        parts.append(cfg.checked_mode_word())
    value = at = 0
    for word, bits in parts:
        value |= word << at
        at += bits
    return value, at


def header_bytes(cfg: Config, kind: str | Scalar, dims, sections: tuple[str, ...] = SECTIONS) -> bytes:
    """The header, filled up to whole words."""
    value, bits = write_header(cfg, kind, dims, sections)
    return value.to_bytes(-(-bits // 64) * 8, "little")


def read_header(data: bytes, sections: tuple[str, ...] = SECTIONS) -> Header:
    stream, at = int.from_bytes(bytes(data[:32]), "little"), 0

    def take(bits: int) -> int:
        nonlocal at
        at += bits
        return stream >> (at - bits) & ((1 << bits) - 1)

    kind = dims = cfg = None
    if "magic" in sections and take(MAGIC_BITS) != MAGIC:
        raise errors.InvalidMagic(bytes(data[:4]).hex())
    if "meta" in sections:
        kind, dims = read_metadata(take(META_BITS))
    if "mode" in sections:
        word = take(12)
        if word > 4094:
            word |= take(52) << 12
        try:
            cfg = Config.from_mode_word(word)
        except errors.InvalidParameters as e:
            raise errors.InvalidMode(hex(word)) from e
    return Header(at, kind, dims, cfg)
