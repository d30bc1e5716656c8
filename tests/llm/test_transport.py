import hashlib
import random
import zlib

import pytest

from gleaner.llm import transport


def plain_demux(media):
    """The payload of PID 256, packet by packet."""
    out, expected = b"", None
    pes = b""
    for at in range(0, len(media), 188):
        p = media[at : at + 188]
        assert p[0] == 0x47
        if (p[1] & 31) << 8 | p[2] != 256:
            continue
        if expected is not None:
            assert p[3] & 15 == expected
        expected = (p[3] + 1) & 15
        if p[1] & 0x40:
            out, pes = out + pes[9 + pes[8] :] if pes else out, b""
        pes += p[4 + (1 + p[4] if p[3] & 0x20 else 0) :]
    return out + pes[9 + pes[8] :]


SIZES = [1, 160, 161, 162, 163, 169, 170, 171, 176, 184, 192, 346, 354, 19_199, 19_200, 19_201, 19_200 * 13 + 5, 19_200 * 25]


@pytest.mark.parametrize("n", SIZES)
def test_round_trip(n):
    payload = random.Random(n).randbytes(n)
    media = transport.mux(payload)
    assert len(media) % 188 == 0 and plain_demux(media) == payload
    (s,) = transport.demux(media)
    units = -(-n // transport.UNIT)
    assert (s.program, s.pid, s.kind, s.payload) == (1, 256, 6, payload)
    assert s.timestamps == [k * 3600 for k in range(units)] and (s.lost, s.repeated, s.left_out) == (0, 0, 0)
    assert [p for p, _ in s.points] == s.timestamps[:: transport.GOP]
    for _, offset in s.points:  # a reader can begin at each point
        assert media[offset] == 0x47 and media[offset + 5] & 0x40 and media[offset + 1] & 0x40


def test_a_reader_begins_at_any_random_access_point():
    payload = random.Random(5).randbytes(transport.UNIT * 30 + 7)
    media = transport.mux(payload)
    (s,) = transport.demux(media)
    assert len(s.points) == 3
    for k, (pts, offset) in enumerate(s.points):
        (own,) = transport.demux(media[offset - 2 * 188 :])
        assert own.payload == payload[k * transport.GOP * transport.UNIT :] and own.timestamps[0] == pts and own.lost == 0
    tables = [p for p in (media[i : i + 188] for i in range(0, len(media), 188)) if (p[1] & 31) << 8 | p[2] in (0, 0x1000)]
    assert [p[3] & 15 for p in tables] == [0, 0, 1, 1, 2, 2]
    broken = bytearray(media)
    broken[10] ^= 1
    assert transport.demux(bytes(broken))[0].payload == payload  # by the next whole table


def test_crc_of_mpeg_tables():
    assert transport.crc32_mpeg(b"123456789") == 0x0376E6E7
    pat = transport.mux(b"x")[5:]
    assert transport.crc32_mpeg(pat[:16]) == 0


def test_damage_is_counted():
    payload = random.Random(0).randbytes(60_000)
    media = transport.mux(payload)
    cut = media[: 188 * 10] + media[188 * 11 :]
    (s,) = transport.demux(cut)
    assert s.lost == 1 and s.left_out == 1 and s.payload == payload[transport.UNIT :]
    twice = media[: 188 * 10] + media[188 * 9 : 188 * 10] + media[188 * 10 :]
    (s,) = transport.demux(twice)
    assert s.repeated == 1 and s.lost == 0 and s.payload == payload
    broken = bytearray(media)
    broken[10] ^= 1  # in the association table
    assert transport.demux(bytes(broken)) == [] and transport.facts(b"")[0] == 0


def test_report(spark):
    texts = [None, "", "a", "é" * 96, "b" * 192, "c" * 193, "long text " * 60_000, "a"]
    df = spark.createDataFrame([(i if i != 2 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    got = transport.report(df).collect()
    assert len(got) == len(texts)
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        size = max(1, -(-len(raw) // 192)) * 192
        payload = raw.ljust(size, b" ")
        r = by[i if i != 2 else None]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        media = transport.mux(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert f"units={-(-size // transport.UNIT)};left_out=0;" in r.feature and len(r.timestamps) == -(-size // transport.UNIT)
    assert by[None].media_sha256 == by[7].media_sha256
    assert transport.report(df.limit(0)).count() == 0
