"""Media columns: AVI motion-JPEG.

encode() stores bytes as a film: each frame of 128 x 96 samples holds 192 bytes,
a flat 8 x 8 block of luma samples for each byte, so that baseline JPEG keeps them
exactly: a block has only a DC coefficient, 8 (value - 128), quantised by 8. The
frames are self-contained baseline JPEGs in an AVI file with an idx1 index.

read_film() parses RIFF, takes the frames by idx1 (or by walking `movi` where there
is none), and decodes the entropy-coded data of all frames of a batch in step:
the k-th symbol of every frame, or restart interval, at once. It takes baseline
JPEGs of one component or several in one scan, with any sampling, tables and restart
intervals; frames without Huffman tables get the standard ones, as is the custom for
motion-JPEG. Of colour frames luma is kept. An empty chunk repeats the frame before.

Shots: a frame's luma histogram is compared to the one before; a cut is where the
difference is a local maximum above the mean and `factor` deviations of its
surroundings. Each shot is a clip row with start and end seconds at the film's rate.

A null text is an empty one, stored as 192 spaces. Equal bytes give equal films. A
film that can't be read, null ones included, is a row whose `error` says why, with
neither payload nor clips; it never ends the job. Repeated rows each stay. Extra
columns are not read. RIFF's sizes have 32 bits and a value 2 GB, which bounds a film.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.shipping import ship

FRAME, ACROSS, DOWN, FPS = 192, 16, 12, 25
DC_BITS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
AC_BITS = [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 0x7D]
AC_VALUES = bytes.fromhex(
    "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a"
    "434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
    "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
)
ZIGZAG = [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]
#: Frames decoded in step, at most: bounds memory whatever a film's length.
STEP = 4096


def jpeg_head() -> bytes:
    """All of a frame of encode() before its entropy-coded data. The only AC code is the end of a block, one bit."""
    quant = b"\xff\xdb\x00\x43\x00" + bytes([8] * 64)
    frame = b"\xff\xc0\x00\x0b\x08" + struct.pack(">HH", DOWN * 8, ACROSS * 8) + b"\x01\x01\x11\x00"
    tables = b"\x00" + bytes(DC_BITS) + bytes(range(12)) + b"\x10" + bytes([1] + [0] * 15) + b"\x00"
    return b"\xff\xd8" + quant + frame + b"\xff\xc4" + struct.pack(">H", 2 + len(tables)) + tables + b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00"


def huffman(bits: list[int], values: bytes) -> dict[int, tuple[int, int]]:
    """Symbol to (code, length)."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            out[values[at]] = code, length
            code, at = code + 1, at + 1
        code <<= 1
    return out


def peeks(table: dict[int, tuple[int, int]]):
    """For each next 16 bits: length << 8 | symbol; 0 where no code fits."""
    import numpy as np

    out = np.zeros(65536, np.int32)
    for symbol, (code, length) in table.items():
        out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
    return out


def entropy(payload) -> list[bytes]:
    """The entropy-coded data of each frame of `payload`, bytes in a (frames, 192) array."""
    import numpy as np

    codes = huffman(DC_BITS, bytes(range(12)))
    value, length = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = codes[size]
        value[d + 255] = ((code << size) | (d if d >= 0 else d + (1 << size) - 1)) << 1  # and the end of the block, bit 0
        length[d + 255] = n + size + 1
    samples = payload.astype(np.int64)
    step = np.diff(samples, axis=1, prepend=128) + 255
    lengths = length[step]
    ends = lengths.cumsum(axis=1)
    sizes = (ends[:, -1] + 7) >> 3
    words = (sizes + 3) >> 2
    first = np.concatenate([[0], words.cumsum()])
    at = (ends - lengths + (first[:-1] << 5)[:, None]).ravel()
    shifted = value[step].ravel() << (64 - (at & 31) - lengths.ravel()).astype(np.uint64)
    n = int(first[-1]) + 1
    packed = np.bincount(at >> 5, (shifted >> np.uint64(32)).astype(np.float64), n) + np.bincount((at >> 5) + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    raw = packed[:n].astype(np.uint64).astype(">u4").view(np.uint8)
    last = (first[:-1] << 2) + sizes - 1
    raw[last] |= ((1 << (-ends[:, -1] & 7)) - 1).astype(np.uint8)
    data = raw.tobytes()
    return [data[a : a + s].replace(b"\xff", b"\xff\x00") for a, s in zip((first[:-1] << 2).tolist(), sizes.tolist())]


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def avi(frames: list[bytes]) -> bytes:
    """An AVI file of motion-JPEG frames."""
    width, height, most = ACROSS * 8, DOWN * 8, max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    parts, index, at = [b"movi"], [], 4
    for frame in frames:
        part = chunk(b"00dc", frame)
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(frame)))
        parts.append(part)
        at += len(part)
    return chunk(b"RIFF", b"AVI " + head + chunk(b"LIST", b"".join(parts)) + chunk(b"idx1", b"".join(index)))


def walk(data: bytes, at: int, end: int):
    """(name, start, size) of the chunks of a RIFF list."""
    while at + 8 <= end:
        size = struct.unpack_from("<I", data, at + 4)[0]
        yield data[at : at + 4], at + 8, size
        at += 8 + size + (size & 1)


def film_rate(data: bytes) -> float:
    """Frames a second, of the video stream's header or else of the file's."""
    rate = 0.0
    for name, at, size in walk(data, 12, len(data)):
        if name != b"LIST" or data[at : at + 4] != b"hdrl":
            continue
        for inner, start, length in walk(data, at + 4, min(at + size, len(data))):
            if inner == b"avih" and (micro := struct.unpack_from("<I", data, start)[0]):
                rate = rate or 1e6 / micro
            if inner == b"LIST" and data[start : start + 4] == b"strl":
                for leaf, place, _ in walk(data, start + 4, min(start + length, len(data))):
                    if leaf == b"strh" and data[place : place + 4] == b"vids":
                        scale, per = struct.unpack_from("<II", data, place + 20)
                        if scale and per:
                            return per / scale
    return rate or float(FPS)


def film_frames(data: bytes) -> list[bytes]:
    """The video frames of an AVI file, in order."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, index = None, None
    for name, at, size in walk(data, 12, len(data)):
        if name == b"LIST" and data[at : at + 4] == b"movi":
            movi = at, min(at + size, len(data))
        elif name == b"idx1":
            index = list(struct.iter_unpack("<4sIII", data[at : at + min(size, len(data) - at) // 16 * 16]))
    if movi is None:
        raise ValueError("an AVI file without movi")
    if index is None:
        index, lists = [], [(movi[0] + 4, movi[1])]
        while lists:
            start, end = lists.pop(0)
            for name, at, size in walk(data, start, end):
                if name == b"LIST":
                    lists.insert(0, (at + 4, min(at + size, end)))
                else:
                    index.append((name, 0, at - 8 - movi[0], size))
        index.sort(key=lambda x: x[2])
    video = [x for x in index if x[0][2:] in (b"dc", b"db")]
    # Offsets count from movi or, in some files, from the start of the file.
    base = 0 if video and data[video[0][2] : video[0][2] + 4] == video[0][0] and video[0][2] >= movi[0] else movi[0]
    out: list[bytes] = []
    for _, _, at, size in video:
        if base + at + 8 + size > len(data):
            raise ValueError("a frame reaches beyond the file")
        out.append(data[base + at + 8 : base + at + 8 + size] if size or not out else out[-1])
    return out


def jpeg_parts(frame: bytes) -> dict:
    """The tables and geometry of a baseline JPEG and where its entropy-coded data starts."""
    out = {"quant": {}, "dc": {}, "ac": {}, "every": 0}
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at = 2
    while True:
        if at + 4 > len(frame) or frame[at] != 0xFF:
            raise ValueError("a JPEG frame without a scan")
        if frame[at + 1] == 0xFF:
            at += 1
            continue
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        if marker == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                out["quant"][body[0] & 15] = struct.unpack_from(f">64{'H' if wide == 2 else 'B'}", body, 1)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                bits = list(body[1:17])
                out["ac" if body[0] >> 4 else "dc"][body[0] & 15] = peeks(huffman(bits, body[17 : 17 + sum(bits)]))
                body = body[17 + sum(bits) :]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("only 8-bit frames are decoded")
            out["height"], out["width"] = struct.unpack_from(">HH", body, 1)
            out["components"] = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("only baseline frames are decoded")
        elif marker == 0xDD:
            out["every"] = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            out["scan"] = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            if not out.get("components") or not out["width"] or not out["height"] or [c[0] for c in out["components"]] != [x[0] for x in out["scan"]]:
                raise ValueError("only frames of one scan are decoded")
            if any(not 1 <= f <= 4 for c in out["components"] for f in c[1:3]) or out["components"][0][3] not in out["quant"]:
                raise ValueError("a JPEG frame without its tables")
            return out | {"at": at + 2 + size}
        at += 2 + size


def decode(frames: list[bytes]):
    """Of frames with one head: luma samples, and which frames have damaged data.

    Flat frames give a (frames, blocks) array, a sample per block; others a
    (frames, blocks, 64) array. Blocks of several components come unit by unit.
    """
    import re

    import numpy as np

    parts = jpeg_parts(frames[0])
    several = len(parts["components"]) > 1
    across, down = (max(c[k] for c in parts["components"]) if several else 1 for k in (1, 2))
    units = -(-parts["width"] // (8 * across)) * -(-parts["height"] // (8 * down))
    standard = peeks(huffman(DC_BITS, bytes(range(12)))), peeks(huffman(AC_BITS, AC_VALUES))
    tables = [(parts["dc"].get(d, standard[0]), parts["ac"].get(a, standard[1])) for _, d, a in parts["scan"]]
    # The components of a unit's blocks, in order; luma comes first.
    order = [i for i, c in enumerate(parts["components"]) for _ in range(c[1] * c[2] if several else 1)]
    luma = order.count(0)
    every = parts["every"] or units
    each = -(-units // every)
    streams: list[bytes] = []
    for frame in frames:
        end = frame.rfind(b"\xff\xd9")
        data = frame[parts["at"] : end if end >= parts["at"] else len(frame)]
        if parts["every"]:
            found = re.split(rb"\xff[\xd0-\xd7]", data)
            streams += (found + [b""] * each)[:each]
        else:
            streams.append(data)
    streams = [s.replace(b"\xff\x00", b"\xff") for s in streams]
    n = len(streams)
    sizes = np.fromiter(map(len, streams), np.int64, n)
    raw = np.frombuffer(b"".join(streams) + b"\xff" * 8, np.uint8).astype(np.uint64)
    window = np.zeros(len(raw) - 4, np.uint64)
    for k in range(5):
        window |= raw[k : len(raw) - 4 + k] << np.uint64(32 - 8 * k)
    bits = (len(window) - 1) << 3
    window = window.astype(np.int64)
    ends = sizes.cumsum() << 3
    at = ends - (sizes << 3)
    # Units of a frame's last restart interval that lie beyond the frame don't count.
    real = np.full(n, every)
    real[each - 1 :: each] = units - every * (each - 1)
    broken = np.zeros(n, bool)

    def take(who, where, table):
        """The next symbol's (zeros before it, value) and the bits it takes."""
        seen = window[where >> 3] >> (24 - (where & 7)) & 0xFFFF
        hit = table[seen]
        broken[who[(hit == 0) | (where >= ends[who])]] = True
        length, symbol = hit >> 8, hit & 255
        size = symbol & 15
        after = where + length
        wide = window[np.minimum(after, bits) >> 3]
        extra = wide >> (40 - (after & 7) - size) & ((1 << size) - 1)
        value = np.where((size > 0) & (extra < (1 << np.maximum(size - 1, 0))), extra - (1 << size) + 1, extra)
        return symbol, value, np.minimum(after + size, bits)

    coefficients = None
    levels = np.zeros((len(tables), n), np.int64)
    flat = np.zeros((n, every * luma), np.int64)
    everyone = np.arange(n)
    for unit in range(every):
        live = everyone if unit < units - every * (each - 1) else np.flatnonzero(unit < real)
        for k, own in enumerate(order):
            dc, ac = tables[own]
            _, value, at[live] = take(live, at[live], dc)
            levels[own, live] += value
            kept = own == 0
            b = unit * luma + k
            if kept:
                flat[live, b] = levels[own, live]
            symbol, value, at[live] = take(live, at[live], ac)
            busy = np.flatnonzero(symbol)
            if not len(busy):
                continue
            if kept and coefficients is None:
                coefficients = np.zeros((n, every * luma, 64), np.int16)
            who, place = live[busy], np.ones(len(busy), np.int64)
            symbol, value = symbol[busy], value[busy]
            while len(who):
                place = place + (symbol >> 4)
                put = ((symbol & 15) > 0) & (place < 64)
                if kept:
                    coefficients[who[put], b, place[put]] = value[put]
                place = place + 1
                more = (place < 64) & (symbol != 0)
                who, place = who[more], place[more]
                if not len(who):
                    break
                symbol, value, at[who] = take(who, at[who], ac)
                going = symbol != 0
                who, place, symbol, value = who[going], place[going], symbol[going], value[going]
    blocks = units * luma
    damaged = broken.reshape(len(frames), each).any(axis=1)
    flat = flat.reshape(len(frames), -1)[:, :blocks]
    quant = np.array(parts["quant"][parts["components"][0][3]], np.int64)
    if coefficients is None:
        return np.clip((flat * quant[0] + 1024 + 4) >> 3, 0, 255).astype(np.uint8), damaged
    full = coefficients.reshape(len(frames), -1, 64)[:, :blocks].astype(np.float64)
    full[:, :, 0] = flat
    full *= quant
    square = np.zeros_like(full)
    square[:, :, ZIGZAG] = full
    basis = np.array([[(0.5 if u else 0.5**1.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    pixels = np.einsum("fbuv,ux,vy->fbxy", square.reshape(*square.shape[:2], 8, 8), basis, basis)
    return np.clip(np.rint(pixels + 128), 0, 255).astype(np.uint8).reshape(*full.shape[:2], 64), damaged


def histograms(samples):
    """A row of 32 shares of luma for each frame."""
    import numpy as np

    n = len(samples)
    bins = (samples.reshape(n, -1) >> 3).astype(np.int64) + (np.arange(n) << 5)[:, None]
    return np.bincount(bins.ravel(), minlength=n << 5).reshape(n, 32) / (samples.size // n)


def cuts(shares, reach: int = 8, factor: float = 2.5, floor: float = 0.15) -> list[int]:
    """The frames at which a new shot starts."""
    import numpy as np

    n = len(shares)
    if n < 2:
        return []
    change = np.abs(np.diff(shares, axis=0)).sum(axis=1) / 2
    sums, squares = (np.concatenate([[0.0], x.cumsum()]) for x in (change, change * change))
    low, high = np.maximum(np.arange(n - 1) - reach, 0), np.minimum(np.arange(n - 1) + reach + 1, n - 1)
    mean = (sums[high] - sums[low]) / (high - low)
    spread = np.sqrt(np.maximum((squares[high] - squares[low]) / (high - low) - mean * mean, 0))
    peak = (change >= np.concatenate([[0.0], change[:-1]])) & (change >= np.concatenate([change[1:], [0.0]]))
    return (np.flatnonzero(peak & (change > np.maximum(mean + factor * spread, floor))) + 1).tolist()


MEDIA = "doc_id long, n_bytes long, media binary"
FILM = "doc_id long, n_bytes long, payload binary, media_bytes long, media_sha256 string, n_frames int, clips array<struct<start_frame: int, end_frame: int, start_s: double, end_s: double>>, error string"
#: What reading damaged bytes may raise.
DAMAGE = (ValueError, KeyError, IndexError, struct.error)


def encode(docs: DataFrame) -> DataFrame:
    """Rows of MEDIA: each text's UTF-8 bytes, padded with spaces to a positive multiple of 192, as a film."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        head = jpeg_head()

        def films(payloads: list[bytes]) -> list[bytes]:
            data = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, FRAME)
            frames = []
            for a in range(0, len(data), STEP):
                frames += [head + x + b"\xff\xd9" for x in entropy(data[a : a + STEP])]
            out, at = [], 0
            for p in payloads:
                out.append(avi(frames[at : at + len(p) // FRAME]))
                at += len(p) // FRAME
            return out

        def made(ids, sizes, payloads):
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(films(payloads) if payloads else [], pa.binary())], names=["doc_id", "n_bytes", "media"])

        for batch in batches:
            ids, sizes, payloads, held = [], [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                body = (text.as_py() or "").encode("utf-8", "surrogatepass")
                ids.append(doc_id)
                sizes.append(len(body))
                payloads.append(body + b" " * (max(FRAME, -(-len(body) // FRAME) * FRAME) - len(body)))
                held += len(payloads[-1])
                if held > 2_000_000:
                    yield made(ids, sizes, payloads)
                    ids, sizes, payloads, held = [], [], [], 0
            yield made(ids, sizes, payloads)

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, MEDIA)


def read_films(media: DataFrame) -> DataFrame:
    """Rows of FILM: the payload read back from the decoded samples of flat one-component frames (null where a frame isn't one), the shots, or an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import numpy as np

        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("n_frames", pa.int32()), ("clips", pa.list_(pa.struct([("start_frame", pa.int32()), ("end_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())]))), ("error", pa.string())])

        def read(films: list[list[bytes]], errors: list[str | None]) -> list[tuple]:
            """Payload and histograms of each film; frames of one head are decoded together across films."""
            frames = [(f, i) for i, film in enumerate(films) for f in film]
            samples: list = [None] * len(frames)
            shares = np.zeros((len(frames), 32))
            groups: dict[bytes, list[int]] = {}
            known = b""
            for at, (frame, film) in enumerate(frames):
                try:
                    if not known or not frame.startswith(known):
                        known = frame[: jpeg_parts(frame)["at"]]
                    groups.setdefault(known, []).append(at)
                except DAMAGE as e:
                    errors[film] = errors[film] or f"{type(e).__name__}: {e}"
            for members in groups.values():
                for a in range(0, len(members), STEP):
                    part = members[a : a + STEP]
                    try:
                        got, damaged = decode([frames[at][0] for at in part])
                    except DAMAGE as e:
                        for at in part:
                            errors[frames[at][1]] = errors[frames[at][1]] or f"{type(e).__name__}: {e}"
                        continue
                    shares[part] = histograms(got)
                    for at in np.array(part)[damaged].tolist():
                        errors[frames[at][1]] = errors[frames[at][1]] or "a frame's data is damaged"
                    if got.ndim == 2 and len(jpeg_parts(frames[part[0]][0])["components"]) == 1:
                        for at, row in zip(part, got):
                            samples[at] = row.tobytes()
            out, at = [], 0
            for film in films:
                own = samples[at : at + len(film)]
                out.append((None if None in own else b"".join(own), shares[at : at + len(film)]))
                at += len(film)
            return out

        def opened(data: bytes | None) -> tuple[list[bytes], float, str | None]:
            try:
                if data is None:
                    raise ValueError("no film")
                return film_frames(data), film_rate(data), None
            except DAMAGE as e:
                return [], float(FPS), f"{type(e).__name__}: {e}"

        for batch in batches:
            ids, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            start = 0
            while start < len(ids) or start == 0:
                rows, raw, held = [], [], 0
                stop = start
                while stop < len(ids) and held < 6_000_000:
                    raw.append(batch.column(2)[stop].as_py())
                    held += len(raw[-1] or b"")
                    stop += 1
                films, rates, errors = (list(x) for x in zip(*map(opened, raw))) if raw else ([], [], [])
                for i, (data, film, (payload, shares)) in enumerate(zip(raw, films, read(films, errors))):
                    row = {"doc_id": ids[start + i], "n_bytes": sizes[start + i], "media_bytes": None if data is None else len(data), "media_sha256": None if data is None else hashlib.sha256(data).hexdigest(), "n_frames": len(film), "error": errors[i]}
                    if errors[i] is None:
                        edges = [0, *cuts(shares), len(film)]
                        row |= {"payload": payload, "clips": [{"start_frame": a, "end_frame": b, "start_s": a / rates[i], "end_s": b / rates[i]} for a, b in zip(edges, edges[1:]) if b > a]}
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                start = max(stop, 1)

    ship(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FILM)


def clip_rows(films: DataFrame) -> DataFrame:
    """A timed row for each shot."""
    return films.select("doc_id", "media_sha256", F.posexplode("clips").alias("clip", "_c")).select("doc_id", "media_sha256", "clip", "_c.*")


def digest(films: DataFrame) -> DataFrame:
    """The contract's columns; feature names the number of frames and shots and a checksum of where the shots start."""
    starts = F.array_join(F.transform("clips", lambda c: c["start_frame"].cast("string")), ",")
    feature = F.concat_ws(";", F.concat(F.lit("frames="), "n_frames"), F.concat(F.lit("shots="), F.size("clips")), F.concat(F.lit("cuts="), F.lower(F.hex(F.crc32(starts)))))
    return films.select("doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature"))
