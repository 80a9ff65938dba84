"""Media columns: payloads stored as baseline JPEG, and features read back from the stored bytes.

store() writes a payload as the luminance of a grey baseline JPEG: each byte is the DC coefficient of one 8 x 8 block
at a quantiser of 8, so the block's mean is the byte and nothing is lost. A frame has 192 blocks across and up to 8191
down, with a restart marker after each row of blocks; longer payloads are frames one after another. Payloads are coded
AT_ONCE rows at a time, and intervals are decoded AT_ONCE at a time, so that a text of any length takes, beside itself and
its stored form, a few bytes of memory for each of its bytes.

read() takes any grey or colour baseline JPEG: it parses the markers, Huffman-decodes the scans and reconstructs the
luminance thumbnail of block means from the DC coefficients alone. The intervals between restart markers, of all
frames of a batch, are decoded side by side in numpy, one symbol of each at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches

ACROSS, DOWN = 192, 8191
BATCH, AT_ONCE = 2 << 20, 8192
#: Fixed value: the DC categories by the length of their codes, from the commonest (differences of 16 to 31 and of 8 to 15, two bits) on; AC blocks are one bit (end of block).
DC_BY_LENGTH = {2: (5, 4), 3: (6, 3, 7), 5: (0, 2, 8), 6: (1,)}


def _codes(by_length: dict[int, tuple[int, ...]]) -> dict[int, tuple[int, int]]:
    """Canonical Huffman codes: symbol -> (code, length)."""
    code, last, out = 0, 0, {}
    for length in sorted(by_length):
        code <<= length - last
        last = length
        for symbol in by_length[length]:
            out[symbol] = (code, length)
            code += 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _huffman(kind: int, by_length: dict[int, tuple[int, ...]]) -> bytes:
    return _segment(0xC4, bytes([kind, *[len(by_length.get(n, ())) for n in range(1, 17)], *[s for n in sorted(by_length) for s in by_length[n]]]))


@lru_cache(maxsize=1)
def _writer() -> tuple[np.ndarray, np.ndarray]:
    """For each difference from -255 to 255: the bits of its code, value and end of block, and how many they are."""
    codes = _codes(DC_BY_LENGTH)
    bits, lengths = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = codes[size]
        bits[d + 255] = ((code << size) | (d if d >= 0 else d + (1 << size) - 1)) << 1
        lengths[d + 255] = n + size + 1
    return bits, lengths


def _header(rows: int) -> bytes:
    frame = bytes([8]) + (rows * 8).to_bytes(2, "big") + (ACROSS * 8).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
    return b"\xff\xd8" + _segment(0xDB, bytes([0] + [8] * 64)) + _segment(0xC0, frame) + _huffman(0x00, DC_BY_LENGTH) + _huffman(0x10, {1: (0,)}) + _segment(0xDD, ACROSS.to_bytes(2, "big")) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % ACROSS or (0 if raw else ACROSS))


def _coded(rows: np.ndarray) -> list[bytes]:
    """The entropy-coded interval of each row of payload bytes, with zeros stuffed behind bytes of ones."""
    bits, lengths = _writer()
    steps = np.diff(rows.astype(np.int64), axis=1, prepend=128) + 255
    value, n = bits[steps], lengths[steps]
    ends = n.cumsum(1)
    size = (ends[:, -1] + 7) // 8
    start = np.concatenate(([0], size.cumsum()))
    at = (ends - n) + start[:-1, None] * 8
    place, shift = at >> 3, 24 - (at & 7) - n
    word = value << shift
    total = int(start[-1])
    out = np.zeros(total + 3, np.int64)
    for k in range(3):
        out += np.bincount((place + k).ravel(), ((word >> (16 - 8 * k)) & 255).ravel(), total + 3).astype(np.int64)
    free = size * 8 - ends[:, -1]
    out[start[1:] - 1] |= (1 << free) - 1  # the last byte is filled with ones
    packed = out[:total].astype(np.uint8)
    full = packed == 255
    moved = np.concatenate(([0], full.cumsum()))
    stuffed = np.zeros(total + int(moved[-1]), np.uint8)
    stuffed[np.arange(total) + moved[:-1]] = packed
    edge, data = (start + moved[start]).tolist(), stuffed.tobytes()
    return [data[s:e] for s, e in zip(edge[:-1], edge[1:], strict=True)]


def store(payloads: list[bytes]) -> list[bytes]:
    """The stored form of each payload; lengths are positive multiples of 192."""
    joined = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ACROSS)
    coded = [x for at in range(0, len(joined), AT_ONCE) for x in _coded(joined[at : at + AT_ONCE])]
    result, row = [], 0
    for p in payloads:
        left, parts = len(p) // ACROSS, []
        while left:
            here = min(left, DOWN)
            parts.append(_header(here))
            for i in range(here):
                parts.append(coded[row + i])
                parts.append(bytes([0xFF, 0xD0 + i % 8]) if i < here - 1 else b"\xff\xd9")
            row, left = row + here, left - here
        result.append(b"".join(parts))
    return result


def _table(body: bytes) -> np.ndarray:
    """For the next 16 bits: the code's length and symbol, as length << 8 | symbol; 0 where no code fits."""
    counts, symbols, code, at = body[:16], body[16:], 0, 0
    table = np.zeros(1 << 16, np.int32)
    for length, count in enumerate(counts, 1):
        for s in symbols[at : at + count]:
            table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | s
            code += 1
        at, code = at + count, code << 1
    return table


def parse(media: bytes) -> list[dict]:
    """The frames of a stored form: width, height, components, tables, and the scan's intervals as bytes."""
    frames, at, now = [], 0, {}
    while at + 2 <= len(media):
        if media[at] != 0xFF:
            raise ValueError("no marker where one is due")
        marker = media[at + 1]
        at += 2
        if marker == 0xD8:
            now = {"quant": {}, "huff": {}, "every": 0}
        elif marker == 0xD9:
            frames.append(now)
        elif marker != 0xFF and marker != 0x01:
            size = int.from_bytes(media[at : at + 2], "big")
            body, at = media[at + 2 : at + size], at + size
            while marker == 0xDB and body:
                wide = body[0] >> 4
                now["quant"][body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")  # of the DC coefficient
                body = body[1 + 64 * (1 + wide) :]
            while marker == 0xC4 and body:
                n = 17 + sum(body[1:17])
                now["huff"][body[0]] = body[1:n]
                body = body[n:]
            if marker == 0xC0:
                now |= {"height": int.from_bytes(body[1:3], "big"), "width": int.from_bytes(body[3:5], "big"), "parts": [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]}
            elif marker in (0xC1, 0xC2, 0xC3):
                raise ValueError("not a baseline JPEG")
            elif marker == 0xDD:
                now["every"] = int.from_bytes(body[:2], "big")
            elif marker == 0xDA:
                tables = {body[i]: body[i + 1] for i in range(1, 1 + 2 * body[0], 2)}
                now["scan"] = [(*p, now["huff"][tables[p[0]] >> 4], now["huff"][16 | tables[p[0]] & 15]) for p in now["parts"]]
                end = at
                while media[(end := media.index(b"\xff", end)) + 1] == 0 or 0xD0 <= media[end + 1] <= 0xD7:
                    end += 2
                now["data"], at = media[at:end], end
    return frames


def _intervals(data: bytes) -> list[bytes]:
    a = np.frombuffer(data, np.uint8)
    marks = np.flatnonzero((a[:-1] == 255) & (a[1:] >= 0xD0) & (a[1:] <= 0xD7)) if len(a) > 1 else np.zeros(0, np.int64)
    starts, ends = np.concatenate(([0], marks + 2)).tolist(), np.concatenate((marks, [len(a)])).tolist()
    return [data[s:e].replace(b"\xff\x00", b"\xff") for s, e in zip(starts, ends, strict=True)]


def thumbnails(media: list[bytes]) -> list[list[dict]]:
    """For each stored form its frames: width, height, and the luminance block means (uint8, rows x blocks across)."""
    parsed = [parse(m) for m in media]
    lanes: dict[tuple, list] = {}
    for frames in parsed:
        for f in frames:
            wide, high = max(p[1] for p in f["scan"]), max(p[2] for p in f["scan"])
            if len(f["scan"]) == 1:
                wide = high = 1
            f["units"] = [-(-f["width"] // (8 * wide)), -(-f["height"] // (8 * high))]
            pieces = _intervals(f["data"])
            every = f["every"] or f["units"][0] * f["units"][1]
            f["luma"] = np.zeros((f["units"][0] * f["units"][1], f["scan"][0][1] * f["scan"][0][2] if len(f["scan"]) > 1 else 1), np.int32)
            # one block of a unit after another: component and its tables
            order = tuple((c, p[4], p[5]) for c, p in enumerate(f["scan"]) for _ in range(p[1] * p[2] if len(f["scan"]) > 1 else 1))
            for i, piece in enumerate(pieces):
                lanes.setdefault(order, []).append((f, i * every, min(every, len(f["luma"]) - i * every), piece))
    for order, group in lanes.items():
        for at in range(0, len(group), AT_ONCE):
            _decode(order, group[at : at + AT_ONCE])
    out = []
    for frames in parsed:
        shots = []
        for f in frames:
            across, down = f["units"]
            h, v = (f["scan"][0][1], f["scan"][0][2]) if len(f["scan"]) > 1 else (1, 1)
            blocks = f["luma"].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
            means = np.clip((blocks.astype(np.int64) * f["quant"][f["scan"][0][3]] + 4) // 8 + 128, 0, 255).astype(np.uint8)
            del f["luma"]
            shots.append({"width": f["width"], "height": f["height"], "thumb": means[: -(-f["height"] // 8), : -(-f["width"] // 8)]})
        out.append(shots)
    return out


def _decode(order: tuple, group: list) -> None:
    """Decodes intervals that share their tables, side by side, and puts luminance DC levels into their frames."""
    dc, ac = [_table(x[1]) for x in order], [_table(x[2]) for x in order]
    plain = len(order) == 1 and not (ac[0] & 255).any()  # no AC coefficient can occur: a block is a DC code and an end
    joined = np.frombuffer(b"".join(p + b"\xff\xff\xff\xff\xff" for *_, p in group), np.uint8)
    ahead = np.zeros(len(joined), np.uint64)
    for k in range(5):
        ahead[: len(joined) - k] |= joined[k:].astype(np.uint64) << np.uint64(32 - 8 * k)
    bit = np.cumsum([0] + [len(p) + 5 for *_, p in group])[:-1] * 8
    units = np.array([n for _, _, n, _ in group])
    levels = np.zeros((len(group), len([0 for x in order if x[0] == 0]), int(units.max())), np.int64)
    last = np.zeros((len(group), 1 + max(x[0] for x in order)), np.int64)

    def peek(at, n):  # the next n bits at each place, n up to 16, and a number or an array
        return (ahead[at >> 3] >> (40 - (at & 7) - n).astype(np.uint64)).astype(np.int64) & ((1 << n) - 1)

    even = bool((units == units[0]).all())
    for u in range(levels.shape[2]):
        live = None if even else np.flatnonzero(units > u)
        at = bit if live is None else bit[live]
        for b, (component, *_) in enumerate(order):
            code = dc[b][peek(at, np.int64(16))]
            at, size = at + (code >> 8), (code & 255).astype(np.int64)
            value = peek(at, size)
            at = at + size
            step = np.where(value < (1 << size) >> 1, value - (1 << size) + 1, value)
            if live is None:
                last[:, component] += step
            else:
                last[live, component] += step
            if component == 0:
                levels[slice(None) if live is None else live, b, u] = last[:, 0] if live is None else last[live, 0]
            if plain:
                at = at + (ac[b][peek(at, np.int64(16))] >> 8)
                continue
            k, todo = np.ones(len(at), np.int64), np.arange(len(at))
            while len(todo):
                code = ac[b][peek(at[todo], np.int64(16))]
                size = (code & 15).astype(np.int64)
                at[todo] += (code >> 8) + size
                run = (code & 255) >> 4
                k[todo] = np.where((size == 0) & (run != 15), 64, k[todo] + run + 1)
                todo = todo[k[todo] < 64]
        if live is None:
            bit = at
        else:
            bit[live] = at
    for (f, first, n, _), got in zip(group, levels, strict=True):
        f["luma"][first : first + n] = got[:, :n].T


def _hashes(thumb: np.ndarray) -> tuple[str, str]:
    """Average hash and difference hash of an 8 x 8 (8 x 9) grid of the thumbnail's means."""
    def grid(across: int) -> np.ndarray:
        rows, cols = (np.arange(n) * size // n for n, size in ((8, thumb.shape[0]), (across, thumb.shape[1])))
        sums = np.add.reduceat(np.add.reduceat(thumb, rows, 0, dtype=np.int64), cols, 1)
        count = np.diff(np.append(rows, thumb.shape[0])).clip(1)[:, None] * np.diff(np.append(cols, thumb.shape[1])).clip(1)[None]
        return sums // count

    a, d = grid(8), grid(9)
    bits = (a * 64 >= a.sum(), d[:, 1:] > d[:, :-1])
    return tuple(np.packbits(x).tobytes().hex() for x in bits)


def _stacked(frames: list[dict]) -> np.ndarray:
    """The thumbnails of all frames, one below the other; narrower ones are filled up with 0."""
    across = max(f["thumb"].shape[1] for f in frames)
    return np.vstack([f["thumb"] if f["thumb"].shape[1] == across else np.pad(f["thumb"], ((0, 0), (0, across - f["thumb"].shape[1]))) for f in frames])


def _weighed(texts: pd.Series, size) -> Iterator[slice]:
    """Slices of a batch with about BATCH bytes each."""
    start = held = 0
    for i, t in enumerate(texts):
        held += size(t)
        if held >= BATCH:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def with_media(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds media (binary) to docs: each text's UTF-8 bytes, filled up with blanks to a positive multiple of 192, stored.

    A null text is stored as an empty one, and so is an empty one: 192 blanks. Equal texts are stored alike; repeated rows
    stay. Very long texts are several frames. Other columns pass through; a column named media is replaced. An empty
    table stays so.
    """
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("binary")
    def stored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out = []
            for s in _weighed(texts, lambda t: len(t or "") + ACROSS):
                out += store([payload_of(t) for t in texts.iloc[s]])
            yield pd.Series(out, dtype=object)

    return docs.withColumn("media", stored(F.col(text_col)))


FEATURES = "width long, height long, frames int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, ahash string, dhash string, feature string"


def with_features(docs: DataFrame, media_col: str = "media") -> DataFrame:
    """Adds the struct features to a table of stored media: dimensions, digests of the bytes read back, thumbnail hashes.

    width and height are in pixels, height over all frames; hashes are of all frames, stacked. A null media has null
    features. What is no baseline JPEG raises an error. Other columns pass through; a column named features is replaced.
    """
    bounded_batches(docs.sparkSession)

    @F.pandas_udf(FEATURES)
    def features(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in FEATURES.split(", ")]
        for media in parts:
            rows = []
            for s in _weighed(media, lambda m: len(m or b"")):
                held = media.iloc[s].tolist()
                shots = iter(thumbnails([bytes(m) for m in held if m is not None]))
                for m in held:
                    if m is None:
                        rows.append([None] * len(names))
                        continue
                    frames = next(shots)
                    back = b"".join(f["thumb"].tobytes() for f in frames)
                    width, height = frames[0]["width"], sum(f["height"] for f in frames)
                    a, d = _hashes(_stacked(frames))
                    rows.append([width, height, len(frames), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(m), hashlib.sha256(m).hexdigest(), a, d, f"{width}x{height}:{a}:{d}"])
            yield pd.DataFrame(rows, columns=names)

    return docs.withColumn("features", features(F.col(media_col)))
