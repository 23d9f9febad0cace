import struct
import zlib

import numpy as np
import pytest

from rasterfold.functions import kernels
from rasterfold.sources import images
from rasterfold.streaming import telemetry


@pytest.mark.parametrize("kind", sorted(images.ENCODERS))
def test_round_trip(kind):
    px = np.random.default_rng(1).integers(0, 4, (7, 13, 4)).astype(np.uint8) * 80
    px[2] = px[2, 0]  # runs
    if kind == "pnm":
        px[:, :, 3] = 255
    assert (images.decode(images.ENCODERS[kind](px)) == px).all()


def test_png_filters():
    """Every filter type, in RGB."""
    px = np.random.default_rng(2).integers(0, 256, (5, 6, 3))
    pad = np.zeros((6, 7, 3), int)
    pad[1:, 1:] = px
    rows = b""
    for y in range(5):
        rows += bytes([y])
        for x in range(6):
            left, up, corner = pad[y + 1, x], pad[y, x + 1], pad[y, x]
            p = left + up - corner
            a, b, c = abs(p - left), abs(p - up), abs(p - corner)
            paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
            rows += bytes(((px[y, x] - (0, left, up, (left + up) // 2, paeth)[y]) % 256).tolist())
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    assert (images.decode(data)[:, :, :3] == px).all()


def test_files(spark, tmp_path):
    px = np.arange(48, dtype=np.uint8).reshape(3, 4, 4)
    (tmp_path / "a.png").write_bytes(images.encode_png(px))
    (tmp_path / "b.qoi").write_bytes(images.encode_qoi(px[:2]))
    rows = images.read_images(spark, str(tmp_path)).groupBy("image_id").count().collect()
    assert sorted(r["count"] for r in rows) == [8, 12]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([(i, f"2024-01-0{1 + i % 3} 0{i % 7}:10:00", i % 5, "decode", float(i)) for i in range(50)], "event_id long, ts string, user_id int, event_type string, value double").withColumn("ts", telemetry.F.col("ts").cast("timestamp"))
    for part in range(2):
        events.where(f"event_id % 2 = {part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    stream = telemetry.drained(telemetry.windowed(telemetry.event_stream(spark, f"{tmp_path}/events")))
    assert sorted(map(str, stream.collect())) == sorted(map(str, telemetry.windowed(events).collect()))


def test_kernels():
    for sampler in kernels.SAMPLERS:
        for source, target in ((16, 5), (5, 16), (7, 7)):
            sums = [0.0] * target
            for t, s, w in kernels.axis_taps(source, target, sampler):
                assert 0 <= s < source
                sums[t] += w
            assert all(abs(s - 1) < 1e-9 for s in sums)
    assert kernels.bayer(4) == [[0, 8, 2, 10], [12, 4, 14, 6], [3, 11, 1, 9], [15, 7, 13, 5]]
    assert kernels.compass(((5, 5, 5), (-3, 0, -3), (-3, -3, -3)))[2] in (((5, -3, -3), (5, 0, -3), (5, -3, -3)), ((-3, -3, 5), (-3, 0, 5), (-3, -3, 5)))
