"""CRC-32 in SQL, for oracles that need one where the database has no such function."""

from __future__ import annotations

import zlib


def _raw(data: bytes) -> int:
    """The CRC register after ``data``, from zero and without the final complement: linear in the bits."""
    return zlib.crc32(data) ^ zlib.crc32(bytes(len(data)))


def _linear(x: str, bits: int, image) -> str:
    """XOR of image(j) over the bits j that are set in the SQL integer ``x``."""
    out = "0"
    for j in range(bits):
        out = f"xor({out}, (({x} >> {j}) & 1) * {image(j)})"
    return out


def _step(state: str, byte: str) -> str:
    return f"xor({state} >> 8, {_linear(f'xor({state} & 255, {byte})', 8, lambda j: _raw(bytes([1 << j])))})"


def crc32(byte_list: str) -> str:
    """The CRC-32 of a SQL list of bytes (BIGINT), as an unsigned number."""
    return f"xor(list_reduce({byte_list}, lambda c, b: {_step('c', 'b')}, 4294967295::BIGINT), 4294967295)"


def utf8(text: str) -> str:
    """The UTF-8 bytes of a SQL string, as a list of BIGINT."""
    u = "u::BIGINT"
    tail = [f"128 + (({u} >> {6 * k}) & 63)" for k in (2, 1, 0)]
    return f"""flatten(list_transform(list_transform(string_split({text}, ''), lambda ch: unicode(ch)), lambda u: CASE WHEN u < 0 THEN []::BIGINT[]
      WHEN u < 128 THEN [{u}] WHEN u < 2048 THEN [192 + ({u} >> 6), {tail[2]}]
      WHEN u < 65536 THEN [224 + ({u} >> 12), {tail[1]}, {tail[2]}] ELSE [240 + ({u} >> 18), {tail[0]}, {tail[1]}, {tail[2]}] END))"""


BLOCK = 64


def crc32_blocks(source: str, key: str, byte_list: str) -> str:
    """SELECT (key, crc) for long texts: blocks of 64 bytes side by side, then put together. Four
    bytes in front stand for the initial register, zeros before them fill the first block."""
    lead = list(_lead())
    shift = _linear("s", 32, lambda j: _raw_after(1 << j, BLOCK))
    return f"""
      SELECT {key}, xor(list_reduce(list(c ORDER BY i), lambda s, c: xor({shift}, c), 0::BIGINT), 4294967295) AS crc FROM (
        SELECT {key}, i, list_reduce(bytes[i * {BLOCK} + 1:(i + 1) * {BLOCK}], lambda c, b: {_step('c', 'b')}, 0::BIGINT) AS c FROM (
          SELECT {key}, bytes, unnest(range(len(bytes) // {BLOCK})) AS i FROM (
            SELECT {key}, list_concat(list_transform(range(({BLOCK} - (len(b) + 4) % {BLOCK}) % {BLOCK}), lambda z: 0::BIGINT), {lead}::BIGINT[], b) AS bytes
            FROM (SELECT {key}, {byte_list} AS b FROM {source}))))
      GROUP BY {key}"""


def _raw_after(state: int, zeros: int) -> int:
    """The register ``state`` after so many zero bytes."""
    for _ in range(zeros):
        state = state >> 8 ^ _raw(bytes([state & 255]))
    return state


def _lead() -> bytes:
    """Four bytes after which a register that began at zero holds all ones: solved bit by bit."""
    rows = []
    for j in range(32):
        v = _raw((1 << j).to_bytes(4, "little"))
        m = 1 << j
        for pv, pm in rows:
            if v ^ pv < v:
                v, m = v ^ pv, m ^ pm
        rows.append((v, m))
        rows.sort(reverse=True)
    left, out = 0xFFFFFFFF, 0
    for v, m in rows:
        if left ^ v < left:
            left, out = left ^ v, out ^ m
    return out.to_bytes(4, "little")
