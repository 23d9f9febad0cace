"""Tags of blocks in both byte orders, and of blocks that are cut, strange, or lead in circles."""

import struct

from rasterfold.operators import metadata


def block(order, entries, data=b"", following=0):
    """A block whose one directory has entries (tag, type, count, value as 4 bytes or a number)."""
    pack = lambda fmt, *v: struct.pack(order + fmt, *v)
    out = (b"MM" if order == ">" else b"II") + pack("HIH", 42, 8, len(entries))
    for tag, kind, count, value in entries:
        out += pack("HHI", tag, kind, count) + (value if isinstance(value, bytes) else pack("I", value))
    return out + pack("I", following) + data


def tags(spark, blobs):
    files = spark.createDataFrame([(i, b) for i, b in enumerate(blobs)], "image_id long, exif binary")
    return {(r["image_id"], r["directory"], r["tag"]): (r["type"], r["count"], r["text"], r["numbers"]) for r in metadata.exif_tags(files).collect()}


def test_values_in_both_orders(spark):
    blobs = []
    for order in "<>":
        at = 8 + 2 + 5 * 12 + 4
        data = b"Maker\0" + struct.pack(order + "IIIi", 7, 2, 0, 0) + struct.pack(order + "ii", -3, 4)
        blobs.append(block(order, [(271, 2, 6, at), (282, 5, 2, at + 6), (33434, 10, 1, at + 22), (274, 3, 1, struct.pack(order + "HH", 6, 0)), (700, 7, 3, b"\1\2\xff\0")], data))
    got = tags(spark, [*blobs, b"Exif\0\0" + blobs[1]])
    for i in range(3):
        assert got[i, "image", 271] == (2, 6, "Maker", None)
        assert got[i, "image", 282] == (5, 2, None, [3.5, None])
        assert got[i, "image", 33434] == (10, 1, None, [-0.75])
        assert got[i, "image", 274] == (3, 1, None, [6.0])
        assert got[i, "image", 700] == (7, 3, "0102ff", None)


def test_damaged_blocks(spark):
    far = block("<", [(271, 2, 60, 500), (256, 4, 1, 77), (9, 99, 1, 5), (305, 2, 0, 0)])
    circle = block(">", [(34665, 4, 1, 8)], following=8)
    cut = block("<", [(256, 4, 1, 1), (257, 4, 1, 2)])[:-10]
    got = tags(spark, [far, circle, cut, None, b"", b"II*\0", b"not such a block at all", far[:9], struct.pack("<2sHI", b"II", 42, 4_000_000_000)])
    assert got[0, "image", 271] == (2, 60, None, None) and got[0, "image", 256] == (4, 1, None, [77.0])
    assert got[0, "image", 9] == (99, 1, None, None) and got[0, "image", 305] == (2, 0, None, None)
    assert {k[1] for k in got if k[0] == 1} == {"image", "photo", "thumbnail"}
    assert [k for k in got if k[0] == 2] == [(2, "image", 256)]
    assert {k[0] for k in got} == {0, 1, 2}
