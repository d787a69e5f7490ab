"""Films that encode() doesn't make: colour frames, other rates, missing indexes and damage."""

import struct

import numpy as np
import pytest

from quern.llm import media

rng = np.random.default_rng(3)


def colour_frame(luma, across, restart=0, head_only=False):
    """A three-component frame, luma `across` blocks wide and high in each unit, of flat blocks: (units, across * across) samples; 16 units in 4 rows."""
    size = 8 * across * 4
    quant = b"\xff\xdb\x00\x43\x00" + bytes([8] * 64)
    frame = b"\xff\xc0\x00\x11\x08" + struct.pack(">HH", size, size) + bytes([3, 1, across << 4 | across, 0, 2, 0x11, 0, 3, 0x11, 0])
    tables = b"\x00" + bytes(media.DC_BITS) + bytes(range(12)) + b"\x10" + bytes([1] + [0] * 15) + b"\x00"
    every = b"\xff\xdd\x00\x04" + struct.pack(">H", restart) if restart else b""
    head = b"\xff\xd8" + quant + frame + b"\xff\xc4" + struct.pack(">H", 2 + len(tables)) + tables + every + b"\xff\xda\x00\x0c\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00"
    codes = media.huffman(media.DC_BITS, bytes(range(12)))
    out, bits, before = [], "", [128, 128, 128]

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        out.append(int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00") if bits else b"")
        bits = ""

    for u, unit in enumerate(luma):
        if restart and u and u % restart == 0:
            flush()
            before = [128, 128, 128]
        for component, value in [*((0, int(v)) for v in unit), (1, 90 + u), (2, 200 - u)]:
            d = value - before[component]
            before[component] = value
            n = abs(d).bit_length()
            code, length = codes[n]
            bits += f"{code:0{length}b}" + (f"{d if d > 0 else d + (1 << n) - 1:0{n}b}" if n else "") + "0"
    flush()
    data = b"".join(x + (b"\xff" + bytes([0xD0 + i % 8]) if i + 1 < len(out) else b"") for i, x in enumerate(out))
    return head if head_only else head + data + b"\xff\xd9"


@pytest.mark.parametrize("across", [1, 2])
@pytest.mark.parametrize("restart", [0, 5])
def test_luma_of_colour_frames(across, restart):
    luma = rng.integers(0, 256, (6, 16, across * across))
    got, damaged = media.decode([colour_frame(x, across, restart) for x in luma])
    assert (got == luma.reshape(6, -1)).all() and not damaged.any()


def films():
    """Films by name, with what their rows should say."""
    plain = rng.integers(0, 256, (30, media.FRAME)).astype(np.uint8)
    good = media.avi([media.jpeg_head() + x + b"\xff\xd9" for x in media.entropy(plain)])
    dark, bright = np.full((16, 4), 20), np.full((16, 4), 220)
    colour = media.avi([colour_frame(dark, 2)] * 20 + [colour_frame(bright, 2)] * 20)
    slow = bytearray(colour)
    at = colour.index(b"vidsMJPG") + 20
    struct.pack_into("<II", slow, at, 2, 10)
    first = good.index(b"\xff\xda") + 10
    broken = bytearray(good)
    broken[first : first + 40] = b"\xfe" * 40
    progressive = good.replace(b"\xff\xc0\x00\x0b", b"\xff\xc2\x00\x0b")
    return {
        "good": (good, plain.tobytes(), None), "colour": (colour, None, None), "slow": (bytes(slow), None, None), "empty": (b"", None, "ValueError"), "null": (None, None, "no film"),
        "text": (b"no film at all", None, "not an AVI"), "cut": (good[: len(good) // 2], None, "Error"), "broken": (bytes(broken), None, "damaged"), "progressive": (progressive, None, "baseline"),
        "headless": (good.replace(b"\xff\xd8", b"\x00\x00"), None, "not a JPEG"), "no movi": (good.replace(b"movi", b"mivo"), None, "movi"), "no scan": (media.avi([colour_frame(dark, 2, head_only=True)[:90]] * 3), None, "scan"), "no data": (media.avi([colour_frame(dark, 2, head_only=True)] * 3), None, "damaged"),
    }


def test_rows_and_errors(spark):
    every = films()
    rows = [(i, 7, None if f is None else bytearray(f)) for i, (f, _, _) in enumerate(every.values())]
    made = media.read_films(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary").repartition(1))
    got = {r["doc_id"]: r for r in made.collect()}
    for i, (name, (film, payload, error)) in enumerate(every.items()):
        r = got[i]
        assert (r["error"] is None) == (error is None), (name, r["error"])
        assert r["error"] is None or error in r["error"], (name, r["error"])
        assert (None if r["payload"] is None else bytes(r["payload"])) == payload, name
        assert r["media_bytes"] == (None if film is None else len(film))
        assert r["error"] is None or (r["clips"] is None and r["payload"] is None)
    clips = [(r["doc_id"], r["clip"], r["start_frame"], r["end_frame"], r["start_s"], r["end_s"]) for r in media.clip_rows(made).orderBy("doc_id", "clip").collect()]
    names = list(every)
    assert [c[1:] for c in clips if c[0] == names.index("colour")] == [(0, 0, 20, 0.0, 20 / 25), (1, 20, 40, 20 / 25, 40 / 25)]
    assert [c[1:] for c in clips if c[0] == names.index("slow")] == [(0, 0, 20, 0.0, 4.0), (1, 20, 40, 4.0, 8.0)]
    assert {c[0] for c in clips} == {names.index(n) for n in ("good", "colour", "slow")}
    edges = [c for c in clips if c[0] == 0]
    assert edges[0][2] == 0 and edges[-1][3] == 30 and all(a[3] == b[2] for a, b in zip(edges, edges[1:]))


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, None), (2, "")]
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["payload_bytes"], r["media_sha256"]) for r in media.digest(media.read_films(media.encode(spark.createDataFrame(rows, "doc_id long, text string")))).collect())
    assert [g[:3] for g in got] == [(0, 0, 192), (0, 1, 192), (1, 1, 192), (1, 1, 192), (2, 0, 192)]
    assert len({g[3] for g in got if g[1] == 1}) == 1
