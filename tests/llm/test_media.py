import hashlib
import random
import zlib

import numpy as np
import pytest

from cadenza.llm import flac

RNG = random.Random(1)
TEXTS = [None, "", "a", "x" * 576, "ab" * 5000, "é漢字" * 700, "".join(RNG.choice("abcdefgh \n") for _ in range(40_000)), "\x00\xff" * 300]


@pytest.mark.parametrize("order", [0, 6])
def test_round_trip(order):
    payloads = [flac.payload_of(t) for t in TEXTS]
    streams = flac.encode(payloads, lpc_order=order)
    assert flac.payloads(streams) == payloads
    assert len(flac.encode(payloads)[4]) < len(payloads[4])
    assert all(len(p) % 576 == 0 and p for p in payloads)


def test_any_sample_is_found_by_its_offset():
    payload = flac.payload_of(TEXTS[6])
    stream = flac.encode([payload])[0]
    samples = np.frombuffer(payload, np.uint8).astype(int) - 128
    for start, count in ((0, 5), (575, 2), (10_000, 1500), (len(samples) - 3, 10)):
        assert flac.read_samples(stream, start, count)[:, 0].tolist() == samples[start : start + count].tolist()
    # without a seek table the frames are found by their sync codes
    plain = flac.Stream(stream)
    plain.seek = None
    assert plain.frame_starts(stream).tolist() == flac.Stream(stream).frame_starts(stream).tolist()


def test_damage_is_noticed():
    stream = bytearray(flac.encode([flac.payload_of(TEXTS[6])])[0])
    first = flac.Stream(bytes(stream)).start
    for at in ((first + len(stream)) // 2, len(stream) - 1, first + 2):
        broken = bytes(stream[:at]) + bytes([stream[at] ^ 0x10]) + bytes(stream[at + 1 :])
        with pytest.raises(flac.FlacError):
            flac.decode([broken])
    with pytest.raises(flac.FlacError):
        flac.decode([b"no stream"])


def test_columns(spark):
    df = spark.createDataFrame([(i, t, "kept", "clash") for i, t in enumerate([*TEXTS[:-1], TEXTS[2]])], "doc_id long, text string, extra string, media string")
    rows = flac.decode_column(flac.encode_column(df)).orderBy("doc_id").collect()
    assert [bytes(r["pcm"]) for r in rows] == [flac.payload_of(t) for t in [*TEXTS[:-1], TEXTS[2]]]
    assert rows[2]["feature"] == rows[-1]["feature"] and rows[0]["extra"] == "kept" and rows[0]["n_bytes"] == 0
    assert flac.decode_column(flac.encode_column(df.limit(0))).count() == 0


class Writer:
    """A stream of verbatim subframes, bit by bit."""

    def __init__(self):
        self.bits = ""

    def put(self, value, width):
        self.bits += format(value & (1 << width) - 1, f"0{width}b") if width else ""

    def bytes(self):
        self.bits += "0" * (-len(self.bits) % 8)
        return int(self.bits, 2).to_bytes(len(self.bits) // 8, "big") if self.bits else b""


def plain_stream(x, bps, coding, block, wasted=0):
    """x (samples, channels) as a stream of another maker: no seek table, any coding, a short last block."""
    body, sizes = b"", {8: 1, 16: 4, 24: 6}
    for number, at in enumerate(range(0, len(x), block)):
        part = x[at : at + block].T
        channels = [(c.tolist(), bps) for c in part]
        if coding >= 8:
            left, right = part
            side = (left - right).tolist()
            channels = {8: [(left.tolist(), bps), (side, bps + 1)], 9: [(side, bps + 1), (right.tolist(), bps)], 10: [(((left + right) >> 1).tolist(), bps), (side, bps + 1)]}[coding]
        w = Writer()
        w.put(0xFFF8, 16), w.put(7 << 4 | 0, 8), w.put(coding << 4 | sizes[bps] << 1, 8), w.put(number, 8), w.put(part.shape[1] - 1, 16)
        head = w.bytes()
        w.put(int(flac.crc(np.frombuffer(head, np.uint8), np.array([0]), np.array([len(head)]), 8)[0]), 8)
        for samples, depth in channels:
            w.put(2 | bool(wasted), 8)
            if wasted:
                w.put(1, wasted)
            for v in samples:
                w.put(v >> wasted, depth - wasted)
        frame = w.bytes()
        body += frame + int(flac.crc(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]), 16)[0]).to_bytes(2, "big")
    packed = 44100 << 44 | (x.shape[1] - 1) << 41 | (bps - 1) << 36 | len(x)
    info = block.to_bytes(2, "big") * 2 + b"\0" * 6 + packed.to_bytes(8, "big") + hashlib.md5(flac.pcm_bytes(x, bps)).digest()
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + body


def test_streams_of_other_kinds():
    rng = np.random.default_rng(4)
    wanted, streams = [], []
    for bps, channels, coding, wasted in ((16, 2, 1, 0), (16, 2, 8, 0), (16, 2, 9, 0), (24, 2, 10, 0), (16, 1, 0, 3), (8, 3, 2, 0)):
        x = rng.integers(-(1 << bps - 2), 1 << bps - 2, (210, channels)) >> wasted << wasted
        wanted.append(x)
        streams.append(plain_stream(x, bps, coding, 64, wasted))
    for x, y in zip(wanted, flac.decode(streams)):
        assert (x == y).all()
    assert (flac.read_samples(streams[3], 60, 100) == wanted[3][60:160]).all()


def test_linear_predictors_are_written():
    t = np.arange(576 * 8)
    wave = (128 + 60 * np.sin(t / 5) + 40 * np.sin(t / 11)).astype(np.uint8).tobytes()
    with_lpc, without = flac.encode([wave], lpc_order=flac.LPC_ORDER)[0], flac.encode([wave], lpc_order=0)[0]
    assert len(with_lpc) < len(without) and flac.payloads([with_lpc]) == [wave]


def test_query_against_plain_python(spark):
    """All columns but those of the stored form, over the whole table; the stored form by reading it back."""
    from cadenza.llm.queries import op1_media_flac

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op1_media_flac(spark, sf).collect()
    assert len(rows) == len(texts)
    streams = dict(zip(texts, flac.encode([flac.payload_of(t) for t in texts.values()], lpc_order=flac.LPC_ORDER)))
    for r in rows:
        payload = flac.payload_of(texts[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"]) == (len((texts[r["doc_id"]] or "").encode()), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        stream = streams[r["doc_id"]]
        assert (r["media_bytes"], r["media_sha256"]) == (len(stream), hashlib.sha256(stream).hexdigest())
        assert r["feature"] == flac.features(payload)
