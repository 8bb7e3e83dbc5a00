"""Media columns: AVI files of motion JPEG, their index, frames and shots.

Frames are JPEG images in the lossless process (SOF3, one 8-bit component, each sample predicted from its left
neighbour, Huffman-coded differences), so samples come back as they were. A file is RIFF: headers, a `movi` list of
`00dc` chunks and an `idx1` index, by which the reader finds the frames. Writer and reader work on many frames at a
time: the k-th sample of all of them is coded or decoded in one step.

A reader meets other JPEG processes, colour or other predictors with a ValueError; clips() and payloads() give such a
file, a null one or one that is no AVI a row without clips or payload and the reason in `error`.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts

WIDTH, HEIGHT = 16, 12
FRAME = WIDTH * HEIGHT
MICROS = 40_000  # of time a frame
#: Frames that are coded together; bounds the working memory whatever a file's length.
TOGETHER = 8192
#: Length of the Huffman code of each category 0 to 8 (the bits that a difference needs beside it).
CODE_LENGTHS = (4, 4, 4, 3, 3, 3, 3, 3, 4)
BINS = 16
#: A shot begins where the histograms differ by more than the mean plus SPREADS deviations of the RECENT differences before, and by FLOOR samples at least.
RECENT, SPREADS, FLOOR = 8, 2, FRAME // 4


def _codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """(code, length) of each category, canonical: by length, then in the order of the table."""
    code, out, last = 0, {}, 0
    for cat, n in sorted(lengths.items(), key=lambda x: x[1]):
        code <<= n - last
        out[cat], code, last = (code, n), code + 1, n
    return out


def _table() -> bytes:
    """The DHT segment of CODE_LENGTHS."""
    order = sorted(range(len(CODE_LENGTHS)), key=lambda c: CODE_LENGTHS[c])
    counts = bytes(CODE_LENGTHS.count(n) for n in range(1, 17))
    return b"\xff\xc4" + struct.pack(">H", 19 + len(order)) + b"\x00" + counts + bytes(order)


HEAD = (
    b"\xff\xd8\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, HEIGHT, WIDTH, 1, 1, 0x11, 0)
    + _table() + b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0)
)


@lru_cache(maxsize=1)
def _writing() -> tuple[np.ndarray, np.ndarray]:
    """For each difference + 255 its bits and their number."""
    codes = _codes(dict(enumerate(CODE_LENGTHS)))
    bits, n = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        cat = abs(d).bit_length()
        code, length = codes[cat]
        extra = d if d >= 0 else d + (1 << cat) - 1
        bits[d + 255], n[d + 255] = code << cat | extra, length + cat
    return bits, n


@lru_cache(maxsize=64)
def _reading(head: bytes) -> tuple[int, int, np.ndarray, np.ndarray, int]:
    """Width, height, and for every possible next `peek` bits the difference and its length, from a frame's header."""
    at, size, table = 2, None, None
    if head[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    while True:
        marker, n = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body = head[at + 4 : at + 2 + n]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            precision, height, width, parts = struct.unpack_from(">BHHB", body)
            if marker != 0xC3 or precision != 8 or parts != 1:
                raise ValueError(f"JPEG process {marker:#x} with {parts} components of {precision} bits is not supported")
            size = width, height
        elif marker == 0xC4:
            counts, symbols = body[1:17], body[17:]
            lengths = [n for n, c in enumerate(counts, 1) for _ in range(c)]
            table = _codes(dict(zip(symbols, lengths, strict=True)))
        elif marker == 0xDA:
            if body[3] != 1:
                raise ValueError(f"predictor {body[3]} is not supported")
            break
        at += 2 + n
    peek = max(n + cat for cat, (_, n) in table.items())
    if not size or peek > 16:
        raise ValueError("a frame header or a short Huffman table is missing")
    diffs, used = np.zeros(1 << peek, np.int32), np.full(1 << peek, peek, np.int64)
    for cat, (code, n) in table.items():
        extra = np.arange(1 << cat)
        value = np.where(extra >> max(cat - 1, 0) & 1, extra, extra - (1 << cat) + 1) if cat else extra
        rest = peek - n - cat
        first = code << (peek - n)
        diffs[first : first + (1 << (peek - n))] = np.repeat(value, 1 << rest)
        used[first : first + (1 << (peek - n))] = n + cat
    return *size, diffs, used, peek


def encode_frames(frames: np.ndarray) -> tuple[bytes, np.ndarray]:
    """`00dc` chunks of frames (n x FRAME samples) one after the other, and the length of each JPEG in them."""
    n = len(frames)
    image = frames.reshape(n, HEIGHT, WIDTH).astype(np.int64)
    diff = np.empty_like(image)
    diff[:, :, 1:] = image[:, :, 1:] - image[:, :, :-1]
    diff[:, 1:, 0] = image[:, 1:, 0] - image[:, :-1, 0]
    diff[:, 0, 0] = image[:, 0, 0] - 128
    bits, width = (t[diff.reshape(n, FRAME) + 255] for t in _writing())
    ends = width.cumsum(axis=1)
    size = (ends[:, -1] + 7) // 8
    first = size.cumsum() - size
    at = first[:, None] * 8 + ends - width  # where each symbol's bits start
    out = np.zeros(int(size.sum()) + 3, np.int64)
    placed = (bits << (24 - (at & 7) - width)).ravel()
    byte = (at >> 3).ravel()
    for k in range(3):  # a symbol has at most 12 bits, so it meets at most 3 bytes; bits don't overlap, hence sums
        out += np.bincount(byte + k, weights=placed >> (16 - 8 * k) & 255, minlength=len(out)).astype(np.int64)
    last = first + size - 1
    out[last] |= (1 << (size * 8 - ends[:, -1])) - 1  # the rest of the last byte is ones
    data = out[:-3].astype(np.uint8)
    # after each 0xFF a zero is stuffed
    stuffed = data == 255
    shift = stuffed.cumsum()
    scan = size + np.diff(np.append(0, shift[last]))
    jpeg = len(HEAD) + scan + 2
    chunk = 8 + jpeg + (jpeg & 1)
    begin = chunk.cumsum() - chunk
    buffer = np.zeros(int(chunk.sum()), np.uint8)
    buffer[begin[:, None] + np.arange(4)] = np.frombuffer(b"00dc", np.uint8)
    buffer[begin[:, None] + np.arange(4, 8)] = jpeg.astype("<u4").view(np.uint8).reshape(n, 4)
    buffer[begin[:, None] + np.arange(8, 8 + len(HEAD))] = np.frombuffer(HEAD, np.uint8)
    before = np.append(0, shift)[first]  # stuffed bytes in the frames before
    frame = np.repeat(np.arange(n), size)
    spot = begin[frame] + 8 + len(HEAD) + np.arange(len(data)) - first[frame] + (shift - stuffed) - before[frame]
    buffer[spot] = data
    end = begin + 8 + jpeg - 2
    buffer[end], buffer[end + 1] = 0xFF, 0xD9
    return buffer.tobytes(), jpeg


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def container(movi: list[bytes], sizes: np.ndarray) -> bytes:
    """The AVI file of frames whose `00dc` chunks stand in `movi`."""
    n, most = len(sizes), int(sizes.max())
    avih = struct.pack("<10I16x", MICROS, most * 1_000_000 // MICROS, 0, 0x10, n, 0, 1, most, WIDTH, HEIGHT)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, MICROS, 1_000_000, 0, n, most, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    index = np.zeros((n, 4), "<u4")
    index[:, 0], index[:, 1], index[:, 3] = int.from_bytes(b"00dc", "little"), 0x10, sizes
    whole = 8 + sizes + (sizes & 1)
    index[:, 2] = 4 + whole.cumsum() - whole  # counted from the list's type
    body = hdrl + b"LIST" + struct.pack("<I", 4 + int(whole.sum())) + b"movi"
    parts = [body, *movi, _chunk(b"idx1", index.tobytes())]
    return b"RIFF" + struct.pack("<I", 4 + sum(map(len, parts))) + b"AVI " + b"".join(parts)


def padded(text: str | None) -> tuple[int, bytes]:
    """The number of a text's UTF-8 bytes, and these with blanks up to a positive multiple of FRAME."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (max(FRAME, -(-len(raw) // FRAME) * FRAME) - len(raw))


def write(payloads: list[bytes]) -> list[bytes]:
    """An AVI file of each payload, a positive multiple of FRAME bytes. Short ones are coded together."""
    counts = [len(p) // FRAME for p in payloads]
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, FRAME)
    out, parts, sizes = [], [], []
    for at in range(0, len(samples), TOGETHER):
        coded, size = encode_frames(samples[at : at + TOGETHER])
        parts.append(coded)
        sizes.append(size)
    size = np.concatenate(sizes)
    whole = np.append(0, (8 + size + (size & 1)).cumsum())
    movi = parts[0] if len(parts) == 1 else b"".join(parts)
    first = 0
    for n in counts:
        out.append(container([movi[whole[first] : whole[first + n]]], size[first : first + n]))
        first += n
    return out


def index(file: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Where each frame's JPEG starts in the file and how long it is, by idx1, and the microseconds a frame."""
    if file[:4] != b"RIFF" or file[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, micros, found = 12, None, MICROS, None
    while at + 8 <= len(file):
        name, n = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
        if name == b"LIST" and file[at + 8 : at + 12] == b"hdrl":
            if file[at + 12 : at + 16] == b"avih":
                micros = struct.unpack_from("<I", file, at + 20)[0]
        elif name == b"LIST" and file[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            found = np.frombuffer(file, "<u4", n // 16 * 4, at + 8).reshape(-1, 4).astype(np.int64)
        at += 8 + n + (n & 1)
    if movi is None or found is None:
        raise ValueError("no index or no frames")
    found = found[(found[:, 0] >> 16) == int.from_bytes(b"dc", "little")]
    # offsets count from the list's type or from the file's start; the first chunk's name tells
    base = movi if len(found) and file[movi + found[0, 2] : movi + found[0, 2] + 4] == found[0, 0].astype("<u4").tobytes() else 0
    return found[:, 2] + base + 8, found[:, 3], micros


def decode_frames(file: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The samples of the JPEG images at `start`, frames x height x width; all must share their headers."""
    data = np.frombuffer(file, np.uint8)
    scan = file.index(b"\xff\xda", start[0])
    head = scan - start[0] + 2 + struct.unpack_from(">H", file, scan + 2)[0]
    heads = data[start[:, None] + np.arange(head)]
    if (heads != heads[0]).any():
        raise ValueError("the frames' headers differ")
    width, height, diffs, used, peek = _reading(heads[0].tobytes())
    n = len(start)
    length = size - head - 2
    first = length.cumsum() - length
    frame = np.repeat(np.arange(n), length)
    raw = data[start[frame] + head + np.arange(len(frame)) - first[frame]]
    fake = np.zeros(len(raw), bool)
    fake[1:] = (raw[:-1] == 255) & (raw[1:] == 0) & (frame[1:] == frame[:-1])
    raw, lost = raw[~fake], np.append(0, fake.cumsum())
    bit = (first - lost[first]) * 8
    w = np.append(raw, np.zeros(3, np.uint8)).astype(np.int32)
    w = w[:-2] << 16 | w[1:-1] << 8 | w[2:]  # three bytes from each place: 16 bits after at most 7
    out = np.empty((width * height, n), np.int32)
    mask, rest = (1 << peek) - 1, 24 - peek
    for k in range(width * height):
        ahead = w[bit >> 3] >> (rest - (bit & 7)) & mask
        out[k] = diffs[ahead]
        bit += used[ahead]
    image = out.reshape(height, width, n)
    image[0, 0] += 128
    image[:, 0] = image[:, 0].cumsum(axis=0)
    return (image.cumsum(axis=1) & 255).astype(np.uint8).transpose(2, 0, 1)


def read(file: bytes) -> Iterator[np.ndarray]:
    """The file's frames, TOGETHER at a time."""
    start, size, _ = index(file)
    for at in range(0, len(start), TOGETHER):
        yield decode_frames(file, start[at : at + TOGETHER], size[at : at + TOGETHER])


def histograms(frames: np.ndarray) -> np.ndarray:
    n = len(frames)
    bins = frames.reshape(n, -1).astype(np.int64) * BINS // 256
    return np.bincount((bins + np.arange(n)[:, None] * BINS).ravel(), minlength=n * BINS).reshape(n, BINS)


def shots(hist: np.ndarray) -> list[int]:
    """The frames at which a shot begins, 0 first."""
    if len(hist) < 2:
        return [0] * min(1, len(hist))
    d = np.abs(np.diff(hist, axis=0)).sum(axis=1)
    one, two = np.append(0, d.cumsum()), np.append(0, (d * d).cumsum())
    k = np.arange(len(d))
    low = np.maximum(0, k - RECENT)
    n = np.maximum(k - low, 1)
    s, q = one[k] - one[low], two[k] - two[low]
    # d > s/n + SPREADS * sqrt(q/n - (s/n)^2), in whole numbers
    over = n * d - s
    far = (over > 0) & (over * over > SPREADS**2 * (n * q - s * s)) & (k > low) & (d >= FLOOR)
    return [0, *(np.flatnonzero(far) + 1).tolist()]


def write_avi(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the AVI file (`media`) of each text; equal texts give equal files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [padded(t.as_py()) for t in batch.column("text")]
            media = [f for part in _parts(raw) for f in write([p for _, p in part])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([n for n, _ in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"]
            )

    return texts(df).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _parts(raw: list[tuple[int, bytes]]) -> Iterator[list[tuple[int, bytes]]]:
    part, frames = [], 0
    for x in raw:
        part.append(x)
        frames += len(x[1]) // FRAME
        if frames >= TOGETHER:
            yield part
            part, frames = [], 0
    if part:
        yield part


CLIPS = "doc_id long, clip int, first_frame long, last_frame long, start_s double, end_s double, error string"


def clips(df: DataFrame) -> DataFrame:
    """A row for each shot of each AVI file in (doc_id, media): frames and seconds, the end exclusive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, m in zip(batch.column("doc_id").to_pylist(), batch.column("media"), strict=True):
                try:
                    file = m.as_py()
                    if file is None:
                        raise ValueError("no file")
                    start, size, micros = index(file)
                    hist = np.concatenate([histograms(f) for f in read(file)]) if len(start) else np.zeros((0, BINS))
                    cuts = shots(hist)
                    for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(hist)], strict=True)):
                        rows.append((d, k, a, b - 1, a * micros / 1e6, b * micros / 1e6, None))
                except (ValueError, IndexError, struct.error) as e:
                    rows.append((d, None, None, None, None, None, str(e)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in CLIPS.split(", ")])

    return df.select("doc_id", "media").mapInArrow(run, CLIPS)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(df: DataFrame) -> DataFrame:
    """Writes each text's file, reads it back by its index and digests both; the feature lists the frames where shots begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part in _parts([padded(t.as_py()) for t in batch.column("text")]):
                files = write([p for _, p in part])
                for (n, _), file, frames in zip(part, files, _read_all(files), strict=True):
                    payload = frames.tobytes()
                    cuts = ",".join(map(str, shots(np.concatenate([histograms(frames[k : k + TOGETHER]) for k in range(0, len(frames), TOGETHER)]))))
                    rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(file), hashlib.sha256(file).hexdigest(), cuts))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            arrays = [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in DIGEST.split(", ")])

    return texts(df).mapInArrow(run, DIGEST)


def _read_all(files: list[bytes]) -> Iterator[np.ndarray]:
    """The frames of each file; short files are decoded together."""
    found = [index(f)[:2] for f in files]
    base = np.cumsum([0] + [len(f) for f in files])
    start = np.concatenate([s + b for (s, _), b in zip(found, base, strict=False)])
    size = np.concatenate([n for _, n in found])
    whole = b"".join(files)
    frames = np.concatenate([decode_frames(whole, start[k : k + TOGETHER], size[k : k + TOGETHER]) for k in range(0, len(start), TOGETHER)])
    first = 0
    for s, _ in found:
        yield frames[first : first + len(s)]
        first += len(s)
