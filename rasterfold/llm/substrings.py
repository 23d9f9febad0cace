"""Repeated passages by suffix arrays: bytes of any 200-byte string that starts elsewhere too are removed.

A window of LENGTH bytes can only repeat where a sample of it does. In every window the GRAM-byte
piece with the smallest hash is an anchor; equal windows have equal anchors, and LENGTH - GRAM more
bytes at most are needed on either side to tell the windows around an anchor apart. Anchors that
occur once are passed over. The surroundings of the others are counted, and the different ones go
into suffix arrays: left bytes, one symbol for the anchor, right bytes. A window is repeated if it
stands in two of these, which then are neighbours in the array, or in one that occurs twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from rasterfold.llm.common import durable, perhaps_among, text_of, whole_row
from rasterfold.llm.grouping import suffix_array, suffix_arrays

LENGTH, GRAM = 200, 165
SIDE = LENGTH - GRAM
#: Symbols that are gathered before suffix arrays are built, and cells of a table of short strings whose arrays are built at once.
SYMBOLS, CELLS = 1_000_000, 1 << 17
#: Fewer strings than this are sorted one by one.
FEW = 8
#: Anchors seen more often are split by the longer half of their sides.
HOT = 2048
#: Of groups that this leaves with more surroundings, windows are counted one by one, not put into a suffix array.
LARGE = 256
#: The filters of anchors have a bit or two for each anchor of the corpus, up to 128 MB.
MOST_BITS = 1 << 30
#: Bits of a hash that are shuffled to count anchors for the first filter; what these confuse, the next count of whole hashes tells apart.
COUNTED = (1 << 40) - 1
#: Bytes that are hashed at once: few enough for the caches of a core, and for the memory of a worker.
_PART = 1 << 18
_PLACE = np.uint64((1 << 22) - 1)
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_table: list[np.ndarray] = []


def _hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on, from running sums of a polynomial modulo 2 ** 64."""
    n = len(data)
    if not _table or len(_table[0]) < n:
        _table[:] = [_powers(_BASE, 2 * _PART), _powers(pow(_BASE, -1, 1 << 64), 2 * _PART)]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _table[0][:n], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * _table[1][: n - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _anchors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place, hash) of anchors in ascending order, for several texts at once; long ones go in parts.

    No window is in two parts. Anchors ascend with the windows, so only the last anchor of a part
    can come again, as the first of the next.
    """
    last = (-1, -1)
    parts = [(n, at, t[at : at + _PART + LENGTH - 1]) for n, t in enumerate(texts) if len(t) >= LENGTH for at in range(0, len(t) - LENGTH + 1, _PART)]
    while parts:
        total, k = 0, 0
        while k < len(parts) and (not k or total + len(parts[k][2]) <= _PART):
            total += len(parts[k][2])
            k += 1
        now, parts = parts[:k], parts[k:]
        data = np.frombuffer(b"".join(x[2] for x in now), np.uint8)
        sizes = np.array([len(x[2]) for x in now])
        begin = np.cumsum(sizes) - sizes
        h = _hashes(data)
        least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        reach, windows = 1, len(data) - LENGTH + 1
        while 2 * reach <= SIDE + 1:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        rest = SIDE + 1 - reach
        least = np.minimum(least[: windows], least[rest : rest + windows])
        whole = np.zeros(windows + LENGTH, bool)
        for b, size in zip(begin.tolist(), sizes.tolist(), strict=True):
            whole[b : b + size - LENGTH + 1] = True
        places = (least[whole[:windows]] & _PLACE).astype(np.int64)
        places = places[np.r_[True, places[1:] != places[:-1]]]
        part = np.searchsorted(begin, places, side="right") - 1
        which, h = np.array([x[0] for x in now])[part], h[places].view(np.int64)
        places = places - begin[part] + np.array([x[1] for x in now])[part]
        new = np.r_[(which[0], places[0]) != last, (which[1:] != which[:-1]) | (places[1:] != places[:-1])]
        last = (which[-1], places[-1])
        yield which[new], places[new], h[new]


def _encoded(texts: pd.Series) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts]


def _all_anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for _, _, h in _anchors(_encoded(batch["text"])):
            yield pd.DataFrame({"h": h & COUNTED})


def _bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """A filter of a fixed number of bits: slot h modulo bits is set for each hash."""
    slot, size = F.pmod("h", F.lit(bits)), 1 << 15
    rows = hashes.select(slot.alias("s")).groupBy(F.floor(F.col("s") / size).cast("int").alias("part")).agg(F.bitmap_construct_agg(F.col("s") % size).alias("map")).collect()
    out = np.zeros(bits // size * (size // 8), np.uint8)
    for row in rows:
        out[row["part"] * (size // 8) :][: size // 8] = np.frombuffer(bytes(row["map"]), np.uint8)
    return out


def _is_set(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h & (8 * len(bitmap) - 1)
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def _around(texts: list[bytes], only: np.ndarray) -> Iterator[tuple[np.ndarray, list[int], list[int], np.ndarray]]:
    """(text, place, anchor's hash, hash of the anchor with its sides) of the anchors in the filter."""
    digest = xxhash.xxh64_intdigest
    for which, places, h in _anchors(texts):
        ok = _is_set(only, h)
        which, places, h = which[ok], places[ok].tolist(), h[ok]
        sides = [digest(texts[n][p - min(p, SIDE) : p + GRAM + SIDE], min(p, SIDE)) for n, p in zip(which.tolist(), places, strict=True)]
        yield which, places, h, np.array(sides, np.uint64).view(np.int64)


def _sides(rows: DataFrame, repeated) -> DataFrame:
    """h, k of each occurrence of a repeated anchor; k is a hash of the anchor with its sides."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, _, h, k in _around(_encoded(batch["text"]), repeated.value):
                yield pd.DataFrame({"h": h, "k": k})

    return rows.mapInPandas(found, "h long, k long")


def _contexts(rows: DataFrame, only) -> DataFrame:
    """h, k, left, right, n: how many occurrences of the anchors in a filter have each surrounding."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = _encoded(batch["text"])
            for which, places, h, k in _around(texts, only.value):
                pairs = list(zip(which.tolist(), places, strict=True))
                yield pd.DataFrame({"h": h, "k": k, "left": [texts[n][max(0, p - SIDE) : p] for n, p in pairs], "right": [texts[n][p + GRAM : p + LENGTH] for n, p in pairs]})

    return rows.mapInPandas(found, "h long, k long, left binary, right binary").groupBy("h", "k", "left", "right").agg(F.count("*").alias("n"))


def _halves(counted: DataFrame, large: int) -> tuple[DataFrame, DataFrame | None]:
    """Surroundings of frequent anchors by the 17 bytes on either side (g): those of groups of at most large, and the windows of all others.

    Of a group by its left bytes the windows with more than 17 of them are listed, of one by its
    right bytes the others: h, k, w (a hash of the bytes around the anchor), j (which window of the
    surrounding), n. The filter of large groups may let a small one in, which then is counted in the same way.
    """
    half = SIDE // 2
    left = F.struct(F.xxhash64("h", F.expr(f"right(hex(left), {2 * half})"), F.lit("l")).alias("g"), F.lit(half + 1).alias("low"), F.lit(SIDE).alias("high"))
    right = F.struct(F.xxhash64("h", F.substring("right", 1, half), F.lit("r")).alias("g"), F.lit(0).alias("low"), F.lit(half).alias("high"))
    rows = counted.select("h", "k", "left", "right", "n", F.inline(F.array(left, right)))
    sizes = durable(rows.groupBy("g").count().where(F.col("count") > large))
    if sizes.isEmpty():
        return rows.select("h", "k", "left", "right", "n", "g"), None
    rows = perhaps_among(rows, sizes, "g")
    listed = rows.where("_among").withColumn("a", F.explode(F.sequence("low", "high"))).where(f"a <= length(left) and {SIDE} - a <= length(right)")
    w = F.expr(f"xxhash64(a, substring(left, length(left) - a + 1, a), substring(right, 1, {SIDE} - a))")
    return rows.where("not _among").select("h", "k", "left", "right", "n", "g"), listed.select("h", "k", w.alias("w"), F.expr("length(left) - a").cast("long").alias("j"), "n")


def _again(windows: DataFrame) -> DataFrame:
    """h, k, first, last of surroundings with repeated windows: counted with a sum before the shuffle, then joined, so no group is gathered."""
    repeated = durable(windows.groupBy("h", "w").agg(F.sum("n").alias("times")).where("times > 1").select("h", "w"))
    return windows.join(repeated, ["h", "w"]).groupBy("h", "k").agg(F.min("j").alias("first"), F.max("j").alias("last"))


def _places(rows: DataFrame, repeated) -> DataFrame:
    """h, k, id, begin, until, windows of each occurrence: where its surrounding begins and how many windows it has.

    Equal whole surroundings that follow each other in a text are one row, from the first's begin until
    the last's: what is repeated in each is at least LENGTH long and at the same place, so they touch.
    Of equal texts in a batch, one is read.
    """

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.drop_duplicates("id")
            texts = _encoded(batch["text"])
            sizes = np.array(list(map(len, texts)), np.int64)
            for which, places, h, k in _around(texts, repeated.value):
                if not places:
                    continue
                p = np.array(places, np.int64)
                begin = np.maximum(p - SIDE, 0)
                windows = np.minimum(p + LENGTH, sizes[which]) - begin - LENGTH + 1
                whole, alike = windows == SIDE + 1, (h[1:] == h[:-1]) & (k[1:] == k[:-1]) & (which[1:] == which[:-1])
                goes_on = alike & whole[1:] & whole[:-1] & (np.diff(begin) <= LENGTH)
                first, last = np.r_[True, ~goes_on], np.r_[~goes_on, True]
                yield pd.DataFrame({"h": h[first], "k": k[first], "id": batch["id"].to_numpy()[which[first]], "begin": begin[first], "until": begin[last], "windows": windows[first].astype(np.int32)})

    return rows.mapInPandas(found, "h long, k long, id binary, begin long, until long, windows int")


def _sorted_windows(text: np.ndarray, ok: np.ndarray, begin: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Places in text of each string's windows in the order of its suffix array; strings of like length are sorted together."""
    order, at = np.argsort(size, kind="stable"), 0
    while at < len(order):
        least = int(size[order[at]])
        most = min(len(order), at + max(FEW, CELLS // (least + 1)))
        some = order[at : at + int(np.searchsorted(size[order[at:most]], least + least // 8, side="right"))]
        at += len(some)
        width = int(size[some[-1]]) + 1
        if len(some) < FEW or len(some) * width > 2 * CELLS:
            for i in some.tolist():
                places = begin[i] + suffix_array(text[begin[i] : begin[i] + size[i]])
                yield places[ok[places]]
            continue
        owner = np.repeat(np.arange(len(some)), size[some])
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
        cells = np.ones((len(some), width), np.int64)
        cells[:, -1] = 0
        cells[owner, offset] = text[begin[some][owner] + offset]
        sa = suffix_arrays(cells)
        inside = sa < size[some][:, None]
        for places in np.split((begin[some][:, None] + sa)[inside], np.cumsum(inside.sum(1))[:-1]):
            yield places[ok[places]]


def repeated_windows(left: list[bytes], right: list[bytes], group: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window (counted from that which begins with left) of each surrounding that is repeated; -1: none.

    Surroundings of a group (ascending numbers from 0) stand together. One of a left and b right
    bytes has a + b + 1 - SIDE windows of SIDE + 1 symbols, each with the symbol of the anchor
    between them. The suffix array of a group's surroundings brings its equal windows together.
    """
    size = np.array([len(a) + len(b) + 2 for a, b in zip(left, right, strict=True)])
    begin = np.cumsum(size) - size
    text = np.frombuffer(b"".join(a + b"\0" + b + b"\0" for a, b in zip(left, right, strict=True)), np.uint8).astype(np.int64) + 2
    text[begin + np.array([len(a) for a in left])] = 258
    text[begin + size - 1] = 1
    windows = np.maximum(0, size - 1 - SIDE)
    owner = np.repeat(np.arange(len(size)), size)
    ok = np.arange(len(text)) - begin[owner] < windows[owner]
    first_of = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    of_group = begin[first_of]
    sorted_places = list(_sorted_windows(text, ok, of_group, np.diff(np.r_[of_group, len(text)])))
    sa = np.concatenate(sorted_places)
    same = np.repeat(np.arange(len(sorted_places)), list(map(len, sorted_places)))
    pairs = np.flatnonzero(same[1:] == same[:-1])
    for k in range(SIDE + 1):
        pairs = pairs[text[sa[pairs + 1] + k] == text[sa[pairs] + k]]
    again = np.zeros(len(text), bool)
    again[sa[pairs + 1]] = True
    again[sa[pairs]] = True
    again |= ok & (times[owner] > 1)
    first, last = np.full(len(size), -1), np.full(len(size), -1)
    at = np.flatnonzero(again)
    last[owner[at]] = at - begin[owner[at]]
    first[owner[at[::-1]]] = at[::-1] - begin[owner[at[::-1]]]
    return first, last


def _verdicts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches are sorted by g and h; whole groups are gathered up to SYMBOLS."""

    def judged(rows: pd.DataFrame) -> pd.DataFrame:
        g, h, n = (rows[c].to_numpy() for c in "ghn")
        new = np.r_[True, (g[1:] != g[:-1]) | (h[1:] != h[:-1])]
        ids = np.cumsum(new) - 1
        alone = (np.bincount(ids) == 1)[ids]
        first, last = np.where(alone & (n > 1), 0, -1), np.where(alone & (n > 1), SIDE, -1)
        if not alone.all():
            some = rows[~alone]
            first[~alone], last[~alone] = repeated_windows(some["left"].tolist(), some["right"].tolist(), np.unique(ids[~alone], return_inverse=True)[1], n[~alone])
        return pd.DataFrame({"h": h, "k": rows["k"].to_numpy(), "first": first, "last": last})[first >= 0]

    kept: list[pd.DataFrame] = []
    for batch in batches:
        while len(batch):
            rows = pd.concat([*kept, batch], ignore_index=True) if kept else batch
            g = rows["g"].to_numpy()
            ends = np.flatnonzero(np.r_[g[1:] != g[:-1], False]) + 1
            symbols = np.cumsum(rows["left"].str.len().to_numpy() + rows["right"].str.len().to_numpy() + 2)
            full = ends[symbols[ends - 1] >= SYMBOLS] if len(ends) else ends
            if not len(full):
                kept, batch = [rows], rows[:0]
            else:
                yield judged(rows.iloc[: full[0]])
                kept, batch = [], rows.iloc[full[0] :]
    if kept:
        yield judged(kept[0])


_RUNS = StructType([StructField("begins", ArrayType(LongType())), StructField("ends", ArrayType(LongType()))])
_REPORT = StructType([StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("n_spans", LongType()), StructField("kept_sha256", StringType())])


@F.pandas_udf(_RUNS)
def _merged(begins: pd.Series, ends: pd.Series) -> pd.DataFrame:
    """Ranges that ascend by begin, with those that overlap or touch made one."""
    out = []
    for b, e in zip(begins, ends, strict=True):
        reach = np.maximum.accumulate(e)
        new = np.r_[True, b[1:] > reach[:-1]]
        out.append((b[new], reach[np.r_[new[1:], True]]))
    return pd.DataFrame(out, columns=_RUNS.names)


def repeated_spans(docs: DataFrame, hot: int = HOT, text: str = "text", large: int = LARGE) -> DataFrame:
    """id (MD5 of the text), begins, ends: the byte ranges of each different text that its repeated windows cover, in order.

    Texts are whole; a null one counts as empty. A text that occurs twice is covered as a whole if
    it has LENGTH bytes. Anchors with more than hot occurrences are grouped by the 17 bytes next to
    them on either side: of the two sides of any window one has that many. Where such a group has
    more than large surroundings, their windows are hashed and counted.
    """
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.unhex(F.md5(text_of(text).cast("binary"))).alias("id"), text_of(text).alias("text"))
    n_bytes = docs.agg(F.sum(F.octet_length(text_of(text)))).first()[0] or 0
    bits = min(MOST_BITS, max(1 << 15, 1 << (n_bytes // SIDE).bit_length() + 1))
    repeated = context.broadcast(_bitmap(rows.mapInPandas(_all_anchors, "h long").groupBy("h").count().where("count > 1"), bits))

    sides = _sides(rows, repeated).groupBy("h").agg(F.count("*").alias("n"), F.min("k").alias("k"), F.max("k").alias("most"))
    anchors = durable(sides.where("n > 1"))
    different = anchors.where("k < most")
    mixed, often = (_bitmap(x, bits) for x in (different, different.where(F.col("n") > hot)))
    alike = anchors.where("k = most").select("h", "k", F.lit(0).cast("long").alias("first"), F.lit(SIDE).cast("long").alias("last"))

    dealt = _contexts(rows, context.broadcast(mixed & ~often)).withColumn("g", F.col("h"))
    if often.any():
        halves, windows = _halves(durable(_contexts(rows, context.broadcast(mixed & often))), large)
        dealt = dealt.unionByName(halves)
        if windows is not None:
            alike = alike.unionByName(_again(windows))
    judged = dealt.repartition("g").sortWithinPartitions("g", "h", "k").mapInPandas(_verdicts, "h long, k long, first long, last long")
    verdicts = judged.unionByName(alike).groupBy("h", "k").agg(F.min("first").alias("first"), F.max("last").alias("last"))

    places = _places(rows, repeated)
    end = F.col("until") + F.least(F.col("last"), F.col("windows") - 1) + LENGTH
    covered = places.join(verdicts, ["h", "k"]).select("id", F.struct((F.col("begin") + F.col("first")).alias("begin"), end.alias("end")).alias("span"))
    spans = covered.groupBy("id").agg(F.sort_array(F.collect_set("span")).alias("spans"))
    return spans.select("id", _merged("spans.begin", "spans.end").alias("r")).select("id", "r.*")


def _runs(begins, ends) -> list[tuple[int, int]]:
    return [] if begins is None else list(zip(begins.tolist(), ends.tolist(), strict=True))


@F.pandas_udf(_REPORT)
def _report(texts: pd.Series, begins: pd.Series, ends: pd.Series) -> pd.DataFrame:
    rows = []
    for text, a, b in zip(_encoded(texts), begins, ends, strict=True):
        runs = _runs(a, b)
        digest, at = hashlib.sha256(), 0
        for begin, end in [*runs, (len(text), len(text))]:
            digest.update(text[at:begin])
            at = end
        rows.append((len(text), sum(b - a for a, b in runs), len(runs), digest.hexdigest()))
    return pd.DataFrame(rows, columns=_REPORT.names)


def _with_spans(docs: DataFrame, hot: int, large: int) -> tuple[DataFrame, DataFrame]:
    """docs that may have repeated windows, with these in _begins and _ends; and all others, whose texts aren't shuffled."""
    spans = durable(repeated_spans(docs, hot, large=large).toDF("_id", "_begins", "_ends"))
    keyed = perhaps_among(docs.withColumn("_id", F.unhex(F.md5(text_of().cast("binary")))), spans, "_id")
    return keyed.where("_among").join(spans, "_id", "left"), keyed.where("not _among")


def repeated_passages(docs: DataFrame, hot: int = HOT, large: int = LARGE) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a string of LENGTH bytes over it also starts anywhere else, in this text (also
    overlapping) or another; all is judged on the texts as they came, so repeated rows and copies
    lose all their bytes. Runs that touch are one. Texts shorter than LENGTH, empty or null keep
    all they have. An empty table gives no rows; null ids stay; other columns are ignored.
    """
    touched, others = _with_spans(docs.select("doc_id", "text"), hot, large)
    cut = touched.select("doc_id", _report(text_of(), "_begins", "_ends").alias("r")).select("doc_id", "r.*")
    none = F.lit(0).cast("long")
    return cut.unionByName(others.select("doc_id", F.octet_length(text_of()).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(text_of().cast("binary"), 256).alias("kept_sha256")))


def without_repeats(docs: DataFrame, hot: int = HOT, large: int = LARGE) -> DataFrame:
    """docs with the repeated bytes cut out of text; parts of characters that a cut leaves are dropped.

    Rows that repeat are cut alike; a null text stays null, or becomes empty; texts of any length
    are read whole; an empty table gives no rows; other columns, whatever their names, stay.
    """

    @F.pandas_udf(StringType())
    def kept(texts: pd.Series, begins: pd.Series, ends: pd.Series) -> pd.Series:
        out = []
        for text, a, b in zip(_encoded(texts), begins, ends, strict=True):
            at, parts = 0, []
            for begin, end in _runs(a, b):
                parts.append(text[at:begin])
                at = end
            out.append(b"".join([*parts, text[at:]]).decode("utf-8", "ignore"))
        return pd.Series(out)

    cut: Column = kept(text_of(), "_begins", "_ends")
    touched, others = _with_spans(docs.select("text", whole_row(docs, "text").alias("doc")), hot, large)
    out = [F.col("text") if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns]
    return touched.withColumn("text", cut).select(*out).unionByName(others.select(*out))
