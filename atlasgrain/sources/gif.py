"""Animated GIF files of hard-edged frames (survey row 22): transparent place 255, frames cleared before the next."""

from __future__ import annotations

import struct

import numpy as np


def _palette(frames: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Up to 255 colours, and the number of each pixel's colour: all if they are few, else 8 x 8 x 3 steps of the channels."""
    colours = np.concatenate([f[..., :3].reshape(-1, 3) for f in frames]).astype(np.int64)
    code = colours @ np.array([65536, 256, 1])
    unique, number = np.unique(code, return_inverse=True)
    if len(unique) > 255:
        step = np.stack([colours[:, 0] // 32, colours[:, 1] // 32, colours[:, 2] // 86], axis=1)
        unique, number = np.unique(step @ np.array([24, 3, 1]), return_inverse=True)
        table = np.stack([unique // 24 * 32 + 16, unique // 3 % 8 * 32 + 16, unique % 3 * 85 + 42], axis=1)
        return table.astype(np.uint8), number.reshape(-1)
    return np.stack([unique >> 16, unique >> 8 & 255, unique & 255], axis=1).astype(np.uint8), number.reshape(-1)


def _codes(pixels: np.ndarray) -> bytes:
    """LZW data whose table is cleared before codes grow: nine bits each, a clear code before every 254 pixels."""
    n = len(pixels)
    groups = -(-n // 254)
    codes = np.concatenate([np.concatenate(([256], pixels[254 * k : 254 * k + 254])) for k in range(groups)] + [[257]])
    bits = (codes[:, None] >> np.arange(9)[None, :]) & 1
    data = np.packbits(bits.reshape(-1).astype(np.uint8), bitorder="little").tobytes()
    return b"".join(bytes([len(data[k : k + 255])]) + data[k : k + 255] for k in range(0, len(data), 255)) + b"\0"


def encode_gif(frames: list[np.ndarray], delay_ms: int = 125, loop: bool = True, threshold: int = 128) -> bytes:
    """h x w x 4 frames of one size. Pixels with alpha under the threshold are transparent."""
    h, w = frames[0].shape[:2]
    if any(f.shape[:2] != (h, w) for f in frames):
        raise ValueError("frames differ in size")
    table, number = _palette(frames)
    full = np.zeros((256, 3), np.uint8)
    full[: len(table)] = table
    out = [b"GIF89a" + struct.pack("<HHBBB", w, h, 0xF7, 255, 0) + full.tobytes()]
    if loop:
        out.append(b"!\xff\x0bNETSCAPE2.0\x03\x01" + struct.pack("<H", 0) + b"\0")
    for k, f in enumerate(frames):
        pixels = np.where(f[..., 3].reshape(-1) < threshold, 255, number[k * w * h : (k + 1) * w * h])
        out.append(b"!\xf9\x04" + struct.pack("<BHB", 2 << 2 | 1, max(2, round(delay_ms / 10)), 255) + b"\0")
        out.append(b"," + struct.pack("<HHHHB", 0, 0, w, h, 0) + b"\x08" + _codes(pixels))
    return b"".join(out) + b";"


def gif_report(data: bytes) -> dict:
    """Number of frames, their delay (hundredths of a second; -1 if it varies), whether all have a transparent place, loop."""
    if data[:3] != b"GIF":
        raise ValueError("not a GIF")
    flags = data[10]
    at = 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
    frames, delays, clear, loop = 0, set(), [], False

    def blocks(at: int) -> int:
        while data[at]:
            at += 1 + data[at]
        return at + 1

    while data[at : at + 1] not in (b";", b""):
        if data[at] == 0x21:
            if data[at + 1] == 0xF9:
                clear.append(bool(data[at + 3] & 1))
                delays.add(struct.unpack("<H", data[at + 4 : at + 6])[0])
            loop |= data[at + 1] == 0xFF and data[at + 3 : at + 14] == b"NETSCAPE2.0"
            at = blocks(at + 2)
        else:
            local = data[at + 9]
            at = blocks(at + 11 + (3 << (local & 7) + 1 if local & 0x80 else 0))
            frames += 1
    return {"frames": frames, "delay_ticks": delays.pop() if len(delays) == 1 else -1, "transparent": bool(clear) and all(clear), "loop": loop}
