import hashlib
import zlib

from foliant.llm import transport_stream as ts


def text(n):
    return bytes(i * 7 % 251 for i in range(n))


def test_round_trip_for_many_sizes():
    for n in [0, 1, 63, 64, 65, 150, 156, 157, 158, 159, 160, 170, 175, 176, 177, 183, 184, 185, 1023, 1024, 1025, 9000]:
        media = ts.multiplex(text(n))
        found = ts.demultiplex(media)
        assert b"".join(u.data for u in found.units) == text(n), n
        assert len(media) % 188 == 0 and not (found.continuity_errors or found.damaged_packets or found.table_errors)
        assert found.streams == {ts.SAMPLES_PID: (ts.PRIVATE_PES_TYPE, ts.PROGRAM)}


def test_times_and_random_access():
    found = ts.demultiplex(ts.multiplex(text(1024 * 17)))
    assert [u.pts for u in found.units] == [i * 11_520 for i in range(17)]
    assert [i for i, u in enumerate(found.units) if u.random_access] == [0, 8, 16]


def test_checksum_is_that_of_the_standard():
    assert ts.crc32_mpeg(b"123456789") == 0x0376E6E7


def packets(data):
    return [data[i : i + 188] for i in range(0, len(data), 188)]


def test_a_lost_packet_is_a_gap_and_breaks_its_unit():
    p = packets(ts.multiplex(text(5000)))
    at = next(i for i, x in enumerate(p) if i > 5 and not x[1] & 0x40 and x[2] == ts.SAMPLES_PID & 255)
    found = ts.demultiplex(b"".join(p[:at] + p[at + 1 :]))
    assert found.continuity_errors == 1 and sum(not u.complete for u in found.units) == 1


def test_a_repeated_packet_is_dropped():
    p = packets(ts.multiplex(text(5000)))
    found = ts.demultiplex(b"".join(p[:6] + [p[5]] + p[6:]))
    assert found.duplicates == 1 and found.continuity_errors == 0 and b"".join(u.data for u in found.units) == text(5000)


def test_lost_sync_bad_tables_and_damage():
    media = ts.multiplex(text(3000))
    found = ts.demultiplex(b"xyz" + media + b"G")
    assert found.skipped_bytes == 4 and b"".join(u.data for u in found.units) == text(3000)
    broken = bytearray(media)
    broken[10] ^= 1
    assert ts.demultiplex(bytes(broken)).table_errors == 1
    broken = bytearray(media)
    broken[188 * 5 + 1] |= 0x80
    found = ts.demultiplex(bytes(broken))
    assert found.damaged_packets == 1 and found.continuity_errors == 1
    assert ts.demultiplex(b"").units == [] and ts.demultiplex(b"\x00" * 500).packets == 0


def test_query_shape(spark):
    rows = [(1, "é" * 40, "a"), (2, None, "b"), (3, "", "c"), (4, "x" * 300_000, "d"), (4, "x" * 300_000, "d"), (None, "é" * 40, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    texts = ts.text_payloads(df).withColumn("media", ts.F.lit("clash"))
    got = ts.digests(ts.store(texts, "payload"), "doc_id").collect()
    assert len(got) == 6
    for r in got:
        if r.doc_id in (2, 3):
            assert r.payload_bytes == 64 and r.payload_sha256 == hashlib.sha256(bytes(64)).hexdigest() and r.tail_crc32 == zlib.crc32(bytes(64))
        if r.doc_id == 4:
            assert r.payload_bytes == 300_032 and r.faults == 0
    same = [r for r in got if r.doc_id in (1, None)]
    assert same[0].feature == same[1].feature and same[0].media_sha256 == same[1].media_sha256
    assert ts.digests(ts.store(texts.limit(0), "payload"), "doc_id").count() == 0
    units = ts.elementary_packets(ts.store(texts, "payload"), "doc_id").where("doc_id = 4 and unit = 1").collect()
    assert len(units) == 2 and units[0].pts == 11_520 and units[0].complete and len(units[0].data) == 1024


def foreign(pid, payload, counter, start=False, random_access=False):
    """One packet by hand, filled up by its adaptation field."""
    room = 184 - len(payload)
    field = b"" if not room else b"\0" if room == 1 else bytes([room - 1, 0x40 if random_access else 0]) + b"\xff" * (room - 2)
    return bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255, (0x30 if room else 0x10) | counter & 15]) + field + payload


def section(table, number, body):
    head = bytes([table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255]) + number.to_bytes(2, "big") + b"\xc1\0\0" + body
    return b"\0" + head + ts.crc32_mpeg(head).to_bytes(4, "big")


def stamp(mark, t):
    return bytes([mark << 4 | (t >> 30 & 7) << 1 | 1, t >> 22 & 255, (t >> 15 & 127) << 1 | 1, t >> 7 & 255, (t & 127) << 1 | 1])


def test_a_stream_by_other_hands():
    # two programs; video of unbounded length with PTS and DTS, sound with its length and PTS; a packet without payload, and null packets
    pat = section(0, 1, b"\0\1\xe1\0" + b"\0\2\xe2\0")
    one = section(2, 1, b"\xe1\x01\xf0\0" + b"\x1b\xe1\x01\xf0\0")
    two = section(2, 2, b"\xe2\x01\xf0\0" + b"\x0f\xe2\x01\xf0\0")
    picture, later, sound = bytes(range(250)), b"second picture", b"sound" * 30
    big = (1 << 32) + 12_345
    video = b"\0\0\1\xe0\0\0\x80\xc0\x0a" + stamp(3, big) + stamp(1, big - 3003) + picture
    video_2 = b"\0\0\1\xe0\0\0\x80\x80\x05" + stamp(2, big + 3003) + later
    audio = b"\0\0\1\xc0" + (8 + len(sound)).to_bytes(2, "big") + b"\x80\x80\x05" + stamp(2, 90_000) + sound
    empty = bytes([0x47, 0x01, 0x01, 0x20 | 7, 183, 0x10]) + b"\xff" * 182  # adaptation only: its counter stands still
    null = b"\x47\x1f\xff\x10" + b"\xff" * 184
    data = b"".join(
        [
            foreign(0, pat, 3, True), foreign(0x100, one, 0, True), foreign(0x200, two, 9, True), null,
            foreign(0x101, video[:150], 7, True, True), empty, foreign(0x201, audio[:100], 15, True), foreign(0x101, video[150:], 8),
            null, foreign(0x201, audio[100:], 0), foreign(0x101, video_2, 9, True),
        ]
    )
    found = ts.demultiplex(data)
    assert found.streams == {0x101: (0x1B, 1), 0x201: (0x0F, 2)}
    assert not (found.continuity_errors or found.damaged_packets or found.table_errors or found.duplicates)
    units = {(u.pid, u.pts): u for u in found.units}
    assert units[0x101, big].data == picture and units[0x101, big].dts == big - 3003 and units[0x101, big].random_access
    assert units[0x101, big + 3003].data == later and not units[0x101, big + 3003].random_access
    assert units[0x201, 90_000].data == sound and units[0x201, 90_000].complete and len(found.units) == 3
