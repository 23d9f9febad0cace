"""Signatures and headers against plain versions of them."""

import base64
import hashlib
import hmac

import numpy as np
from pyspark.sql import functions as F

from rasterfold.operators import analytics
from rasterfold.sources import images


def test_signatures(spark):
    urls = spark.createDataFrame([("/a.png?height=5&width=6",), ("/ü/b.png",), ("",)], "canonical string")
    for key in (b"secret", b"k" * 100):
        for r in analytics.is_signed(analytics.signed(urls, key), key).collect():
            want = base64.urlsafe_b64encode(hmac.new(key, r["canonical"].encode(), hashlib.sha256).digest()).rstrip(b"=").decode()
            assert r["signed"] == r["canonical"] + ("&" if "?" in r["canonical"] else "?") + "sig=" + want and r["valid"] == (r["canonical"] != "")
        forged = analytics.signed(urls, key).withColumn("signed", F.replace("signed", F.lit("width=6"), F.lit("width=9")))
        assert [r["valid"] for r in analytics.is_signed(forged, key).collect()] == [False, True, False]


def test_headers(spark):
    px = np.full((7, 13, 4), 255, np.uint8)
    files = [(f"a.{kind}", bytearray(make(px)), kind, 13, 7) for kind, make in images.ENCODERS.items()]
    files += [("x.gif", bytearray(b"GIF89a" + (300).to_bytes(2, "little") + (20).to_bytes(2, "little") + b"\0" * 9), "gif", 300, 20), ("y.jpg", bytearray(b"\xff\xd8\xff\xe0" + b"\0" * 20), "jpeg", None, None), ("z", bytearray(b"text"), None, None, None), ("n", None, None, None, None), ("c.pgm", bytearray(b"P5 # note\n4 3\n255\n" + b"\0" * 12), "pnm", 4, 3)]
    got = images.identify(spark.createDataFrame(files, "path string, content binary, want string, w long, h long")).collect()
    assert [(r["format"], r["width"], r["height"]) for r in got] == [(r["want"], r["w"], r["h"]) for r in got]
    assert [r[0] for r in spark.createDataFrame([("A/B.JPEG",), ("x.tiff",), ("none",), (None,)], "path string").select(images.format_for_path()).collect()] == ["jpeg", "tiff", None, None]
