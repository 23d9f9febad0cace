"""Aggregates, joins and per-image steps behind the measuring queries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterfold.operators.pixels import with_own


def percentiles(px: DataFrame, points: tuple[int, ...], level: str = "l") -> DataFrame:
    """The smallest level that so many per cent of an image's pixels don't exceed, from its histogram."""
    upto = W.partitionBy("image_id").orderBy("level")
    h = px.groupBy("image_id", F.col(level).alias("level")).agg(F.count("*").alias("n"))
    h = h.select("image_id", "level", F.sum("n").over(upto).alias("upto"), F.sum("n").over(W.partitionBy("image_id")).alias("w"))
    return h.groupBy("image_id").agg(*(F.min(F.when(F.col("upto") * 100 >= F.col("w") * p, F.col("level"))).alias(f"p{p}") for p in points))


def value_percentiles(rows: DataFrame, key: str, value: str, shares: dict[str, float], cells: int = 4096) -> DataFrame:
    """For each key the smallest value that so large a share of its rows doesn't exceed, whatever number of values it has.

    Values are cut into cells between the least and the largest of their key; counts of cells find
    the cell of each share, and only values of such cells are counted one by one.
    """
    rows = rows.where(F.col(value).isNotNull()).select(key, F.col(value).alias("_v"))
    bounds = rows.groupBy(key).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("_n"))
    placed = rows.join(bounds, key)
    cell = F.when(F.col("_high") > F.col("_low"), F.least(F.lit(cells - 1), F.floor((F.col("_v") - F.col("_low")) * cells / (F.col("_high") - F.col("_low"))))).otherwise(0).cast("int")
    placed = placed.select(key, "_v", "_n", cell.alias("_cell"))
    upto = W.partitionBy(key).orderBy("_cell")
    counts = placed.groupBy(key, "_cell", "_n").agg(F.count("*").alias("_m")).withColumn("_upto", F.sum("_m").over(upto))
    wanted = [F.greatest(F.lit(1), F.ceil(F.col("_n") * p)) for p in shares.values()]
    hit = [(w <= F.col("_upto")) & (w > F.col("_upto") - F.col("_m")) for w in wanted]
    some = counts.where(reduce(or_, hit)).select(key, "_cell", (F.col("_upto") - F.col("_m")).alias("_before"))
    values = placed.join(some, [key, "_cell"]).groupBy(key, "_cell", "_before", "_n", "_v").agg(F.count("*").alias("_m"))
    within = W.partitionBy(key, "_cell").orderBy("_v")
    values = values.withColumn("_upto", F.col("_before") + F.sum("_m").over(within))
    return values.groupBy(key).agg(*(F.min(F.when(F.col("_upto") >= w, F.col("_v"))).alias(name) for name, w in zip(shares, wanted, strict=True)))


def joined_to_own(px: DataFrame, aggregates: str) -> DataFrame:
    """px with figures of its image; only one row an image is shuffled besides px."""
    return with_own(px, px.groupBy("image_id").agg(*(F.expr(a) for a in aggregates.split(", "))))


def equalize(px: DataFrame, tile: str = "0") -> DataFrame:
    """Levels by their rank in the image or tile, through a table of levels."""
    cells = px.withColumn("_tile", F.expr(tile))
    upto, whole = W.partitionBy("image_id", "_tile").orderBy("l"), W.partitionBy("image_id", "_tile")
    h = cells.groupBy("image_id", "_tile", "l").agg(F.count("*").alias("n"))
    h = h.select("image_id", "_tile", "l", F.sum("n").over(upto).alias("upto"), F.sum("n").over(whole).alias("w"))
    h = h.withColumn("least", F.min("upto").over(whole))
    new = F.expr("CASE WHEN w = least THEN l ELSE CAST(floor((upto - least) * 255D / (w - least) + 0.5D) AS INT) END")
    return cells.join(h.select("image_id", "_tile", "l", new.alias("_new")), ["image_id", "_tile", "l"]).select("image_id", "y", "x", F.col("_new").alias("l"))


def difference_hash(px: DataFrame, height: int = 16, width: int = 64) -> DataFrame:
    """64 bits of a 9 x 8 grid of means, set where a cell is brighter than the next (the last is the sign bit), and how many are set."""
    cells = px.groupBy("image_id", F.expr(f"y * 8 div {height}").alias("v"), F.expr(f"x * 9 div {width}").alias("u")).agg(F.avg("l").alias("m"))
    bits = cells.withColumn("bit", F.col("m") > F.lead("m").over(W.partitionBy("image_id", "v").orderBy("u")))
    value = F.expr("CASE WHEN bit AND u < 8 THEN shiftleft(1L, CAST(v * 8 + u AS INT)) ELSE 0L END")
    return bits.groupBy("image_id").agg(F.bit_or(value).alias("hash"), F.count_if(F.col("bit") & (F.col("u") < 8)).alias("ones"))


def runs(px: DataFrame) -> DataFrame:
    """Runs of ink along lines: image_id, y, x, length."""
    order = W.partitionBy("image_id", "y").orderBy("x")
    return px.where("ink = 1").withColumn("g", F.col("x") - F.row_number().over(order)).groupBy("image_id", "y", "g").agg(F.min("x").alias("x"), F.count("*").alias("length")).drop("g")


def suppress(boxes: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Greedy suppression: boxes by falling score stay unless they overlap one that stayed too much.

    An image's boxes are folded in order, an expression within the plan: no Python.
    """
    inter = lambda p, q: F.greatest(F.lit(0), F.least(p["x"] + p["w"], q["x"] + q["w"]) - F.greatest(p["x"], q["x"])) * F.greatest(F.lit(0), F.least(p["y"] + p["h"], q["y"] + q["h"]) - F.greatest(p["y"], q["y"]))
    over = lambda p, q: inter(p, q) > F.lit(threshold) * (p["w"] * p["h"] + q["w"] * q["h"] - inter(p, q))
    row = F.struct((-F.col("score")).alias("minus"), "box", "x", "y", "w", "h")
    ranked = boxes.groupBy("img").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    stay = F.aggregate("rows", F.slice("rows", 1, 0), lambda kept, b: F.when(F.exists(kept, lambda k: over(k, b)), kept).otherwise(F.concat(kept, F.array(b))))
    return ranked.select("img", F.explode(stay).alias("r")).select("img", "r.box", "r.x", "r.y", "r.w", "r.h", (-F.col("r.minus")).alias("score"))


def grouped_errors(pairs: DataFrame) -> DataFrame:
    """Edits over characters, in all and by category and by script: ratios of sums."""
    sums = pairs.groupingSets([[], ["category"], ["script"]], "category", "script")
    out = sums.agg(F.grouping_id("category", "script").alias("level"), F.sum(F.levenshtein("ref", "hyp")).alias("edits"), F.sum(F.length("ref")).alias("characters"), F.count_if(F.col("ref") == F.col("hyp")).alias("exact"))
    return out.withColumn("edits", F.col("edits").cast("long")).withColumn("characters", F.col("characters").cast("long")).withColumn("cer", F.round(F.col("edits") / F.col("characters").cast("double"), 9))


def coverage(expected: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """Whether each key is on both sides once: missing, extra, duplicate or matched."""
    a, b = expected.groupBy(key).agg(F.count("*").alias("na")), given.groupBy(key).agg(F.count("*").alias("nb"))
    state = F.when(F.col("nb").isNull(), "missing").when(F.col("na").isNull(), "extra").when((F.col("na") > 1) | (F.col("nb") > 1), "duplicate").otherwise("matched")
    return a.join(b, key, "full").select(key, state.alias("state"))


def telemetry(events: DataFrame) -> DataFrame:
    """Calls by day and operation; a plain frame and a stream of events are counted alike."""
    return events.groupBy(F.date_trunc("day", "ts").alias("day"), F.col("event_type").alias("op")).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("longest"), F.count_if(F.col("value") < 10).alias("fast"))


def requests(pages: DataFrame) -> DataFrame:
    """Requests with their commands in order, and the key that they are cached by."""
    query = "concat(lower(url), '?width=', page_id % 800 + 1, '&mode=', element_at(array('max', 'crop', 'pad'), CAST(page_id % 3 + 1 AS INT)), '&height=', page_id % 600 + 1)"
    parts = pages.selectExpr("page_id", f"{query} AS url").selectExpr("page_id", "split_part(url, '?', 1) AS path", "array_sort(split(split_part(url, '?', 2), '&')) AS parts")
    canonical = parts.select("page_id", F.concat("path", F.lit("?"), F.array_join("parts", "&")).alias("canonical"), F.size("parts").alias("commands"))
    return canonical.withColumn("cache_key", F.sha2("canonical", 256))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """The hexadecimal HMAC-SHA256 of a text: two nested hashes, with the padded key as literals."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def signed(urls: DataFrame, key: bytes, url: str = "canonical") -> DataFrame:
    """urls with a column signed: the URL with its signature as a last command, in base 64 that URLs bear."""
    tag = F.translate(F.base64(F.unhex(hmac_sha256(key, F.col(url)))), "+/=\r\n", "-_")
    mark = F.when(F.contains(F.col(url), F.lit("?")), "&").otherwise("?")
    return urls.withColumn("signed", F.concat(F.col(url), mark, F.lit("sig="), tag))


def is_signed(urls: DataFrame, key: bytes, url: str = "signed") -> DataFrame:
    """urls with a column valid: whether the signature at the end is that of the rest."""
    bare = F.regexp_extract(url, r"^(.*)[?&]sig=[A-Za-z0-9_-]+$", 1)
    given = urls.withColumns({"_bare": bare, "_given": F.col(url)})
    valid = (F.col("_bare") != "") & (F.col("signed") == F.col("_given"))
    again = signed(given, key, "_bare").withColumn("valid", F.coalesce(valid, F.lit(False)))
    return again.select(*(F.col("_given").alias(c) if c == url else F.col(c) for c in urls.columns), "valid")


def linked(line: np.ndarray, begin: np.ndarray, end: np.ndarray, reach: int) -> np.ndarray:
    """For each run (begin to end of a line, in order of line and begin) the first run of its component.

    Runs of neighbouring lines touch where they overlap, reach places on either side counted. Roots
    are hooked to the smallest of their neighbours, all at once, until every touching pair has one.
    """
    parent = np.arange(len(line))
    if not len(line):
        return parent
    wide = int(end.max()) + 2 * reach + 2
    first, last = line * wide + begin + reach, line * wide + end + reach
    low = np.searchsorted(last, first - wide - reach)
    many = np.maximum(np.searchsorted(first, last - wide + reach, "right") - low, 0)
    one = np.repeat(parent, many)
    other = np.arange(len(one)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    while len(one):
        np.minimum.at(parent, np.maximum(one, other), np.minimum(one, other))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        one, other = parent[one], parent[other]
        apart = one != other
        one, other = one[apart], other[apart]
    return parent


def label_components(px: DataFrame, connectivity: int = 8) -> DataFrame:
    """image_id, y, x, label of ink: runs of lines are joined where they touch; labels count in raster order.

    Runs are found by windows; one image's runs, not its pixels, are gathered for the labelling.
    """

    def labelled(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["y", "x"], ignore_index=True)
        y, begin, length = (rows[c].to_numpy().astype(np.int64) for c in ("y", "x", "length"))
        roots = linked(y - y.min(), begin - begin.min(), begin - begin.min() + length - 1, int(connectivity == 8))
        return rows.assign(label=(np.cumsum(roots == np.arange(len(roots)))[roots]).astype(np.int32))

    found = runs(px)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    out = found.groupBy("image_id").applyInPandas(labelled, f"{kinds}, label int")
    return out.select("image_id", "y", F.explode(F.expr("sequence(x, CAST(x + length - 1 AS INT))")).alias("x"), "label")


#: Bytes of text that are labelled at once (whole pages; a longer page is one by itself).
PIECE = 1 << 22


def labelled_text(data: np.ndarray, cuts: np.ndarray, width: int, reach: int) -> dict[str, np.ndarray]:
    """Runs of ink of pages of text (UTF-8 bytes, cut at cuts), width characters a line, blank where there is white space.

    page, y, x, length, label (in raster order), area of the component, and whether it is the largest of its page (of equal ones the first).
    """
    begins = (data & 0xC0) != 0x80
    if begins.all():
        chars, at = data, cuts
    else:
        chars, at = data[begins], np.concatenate([[0], np.cumsum(begins)])[cuts]
    ink = (chars != 32) & (chars != 9) & (chars != 10)
    size = np.diff(at)
    place = np.arange(len(chars), dtype=np.int32) - np.repeat(at[:-1].astype(np.int32), size)
    starts = ink.copy()
    starts[1:] &= ~ink[:-1] | (place[1:] % width == 0)
    stops = ink.copy()
    stops[:-1] &= ~ink[1:] | (place[1:] % width == 0)
    first, last = np.flatnonzero(starts), np.flatnonzero(stops)
    page = np.searchsorted(at, first, "right") - 1
    y, x = np.divmod(place[first].astype(np.int64), width)
    length = last - first + 1
    above = np.concatenate([[0], np.cumsum(-(-size // width) + 1)[:-1]])  # a line between pages stays blank
    roots = linked(above[page] + y, x, x + length - 1, reach)
    own = roots == np.arange(len(roots))
    before = np.concatenate([[0], np.cumsum(own)])
    label = before[1:][roots]  # from 1, over all pages
    areas = np.bincount(label - 1, length, int(before[-1])).astype(np.int64)
    pages = page[own]
    order = np.lexsort((np.arange(len(areas)), -areas, pages))
    largest = np.zeros(len(areas), bool)
    largest[order[np.concatenate([[True], pages[order][1:] != pages[order][:-1]])] if len(order) else order] = True
    of_page = before[np.searchsorted(page, np.arange(len(size)))]  # components of the pages before
    return {"page": page, "y": y.astype(np.int32), "x": x.astype(np.int32), "length": length.astype(np.int32), "label": (label - of_page[page]).astype(np.int32), "area": areas[label - 1], "largest": largest[label - 1]}


def text_components(pages: DataFrame, width: int, connectivity: int = 8, piece: int = PIECE) -> DataFrame:
    """image_id, y, x, length, label, area, largest: the labelled runs of pages (image_id, text), each page a row.

    As label_components of the pages' pixels has it, but a page comes as its text and leaves as its
    runs, so nothing is shuffled; many pages are labelled at once.
    """
    reach = 1 if connectivity == 8 else 0

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            cuts = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))])
            at = 0
            while at < batch.num_rows:
                upto = max(at + 1, int(np.searchsorted(cuts, cuts[at] + piece, "right")) - 1)
                data = np.frombuffer(b"".join(texts.slice(at, upto - at).to_pylist()), np.uint8)
                found = labelled_text(data, cuts[at : upto + 1] - cuts[at], width, reach)
                ids = batch.column("image_id").slice(at, upto - at).take(pa.array(found.pop("page")))
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, found.values())], ["image_id", *found])
                at = upto

    kind = pages.schema["image_id"].dataType.simpleString()
    given = pages.select("image_id", F.col("text").cast("binary").alias("text")).where("text IS NOT NULL AND length(text) > 0")
    return given.mapInArrow(labelled, f"image_id {kind}, y int, x int, length int, label int, area long, largest boolean")


def run_pixels(runs: DataFrame, *columns: str) -> DataFrame:
    """image_id, y, x and columns of the pixels of runs (image_id, y, x, length)."""
    return runs.select("image_id", "y", F.explode(F.expr("sequence(x, x + length - 1)")).alias("x"), *columns)


def diffused(levels: np.ndarray, divisor: int, weights: tuple, threshold: int = 128) -> np.ndarray:
    """Black and white (0, 255) by error diffusion; weights are (dx, dy, share).

    Pixels of one slanted diagonal depend on none of each other, so each is handled as a whole. The
    slant is so flat that every pixel gets its errors in the order of a scan line by line.
    """
    h, w = levels.shape
    reach = max(abs(dx) for dx, _, _ in weights)
    deepest, slant = max(dy for _, dy, _ in weights), 2 * reach + 1
    v = np.zeros((h + deepest, w + 2 * reach))
    v[:h, reach : reach + w] = levels
    order = sorted(weights, key=lambda t: (-t[1], t[0]))
    for t in range(w + slant * (h - 1)):
        y = np.arange(max(0, -((w - 1 - t) // slant)), min(h - 1, t // slant) + 1)
        x = t - slant * y + reach
        new = np.where(v[y, x] >= threshold, 255.0, 0.0)
        error = (v[y, x] - new) / divisor
        v[y, x] = new
        for dx, dy, share in order:
            v[y + dy, x + dx] += error * share
    return v[:h, reach : reach + w].astype(np.int32)


def diffuse(px: DataFrame, divisor: int, weights: tuple, threshold: int = 128) -> DataFrame:
    """Error diffusion to black and white; every pixel depends on those before it, so one image is one task's work."""

    def dithered(rows: pd.DataFrame) -> pd.DataFrame:
        levels = np.zeros((int(rows["y"].max()) + 1, int(rows["x"].max()) + 1))
        levels[rows["y"], rows["x"]] = rows["l"]
        return rows.assign(l=diffused(levels, divisor, weights, threshold)[rows["y"], rows["x"]])

    return px.groupBy("image_id").applyInPandas(dithered, px.schema)


def word_errors(pairs: DataFrame) -> DataFrame:
    """category, words, word_errors, wer of pairs (category, ref, hyp): edits of words, as edits of characters that stand for them."""
    words = lambda c: F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != "")
    split = pairs.select("category", words("ref").alias("r"), words("hyp").alias("h")).withColumn("known", F.array_union("r", "h"))
    coded = lambda c: F.array_join(F.transform(c, lambda x: F.decode(F.unhex(F.lpad(F.hex(F.array_position("known", x) + 0x10000), 8, "0")), "UTF-32")), "")
    sums = split.select("category", F.size("r").alias("n"), F.levenshtein(coded("r"), coded("h")).alias("e")).groupBy("category").agg(F.sum("n").cast("long").alias("words"), F.sum("e").cast("long").alias("word_errors"))
    return sums.withColumn("wer", F.when(F.col("words") > 0, F.round(F.col("word_errors") / F.col("words"), 9)))


def most_pairs(sources: list, targets: list) -> int:
    """The largest number of the given (source, target) pairs that share no end: rounds of shortest augmenting paths.

    Each round layers the sources by their distance from free ones, then walks down the layers with a
    stack of its own, so chains may be of any length.
    """
    goals: dict = {}
    for source, target in sorted(set(zip(sources, targets, strict=True))):
        goals.setdefault(source, []).append(target)
    of_source: dict = {}
    of_target: dict = {}
    while True:
        layer = {s: 0 for s in goals if s not in of_source}
        front, reached = list(layer), False
        while front and not reached:
            following = []
            for s in front:
                for t in goals[s]:
                    other = of_target.get(t)
                    if other is None:
                        reached = True
                    elif other not in layer:
                        layer[other] = layer[s] + 1
                        following.append(other)
            front = following
        if not reached:
            return len(of_source)
        left = {s: iter(goals[s]) for s in layer}
        for start in [s for s in layer if layer[s] == 0]:
            path = [start]
            while path:
                s = path[-1]
                t = next(left[s], None)
                if t is None:
                    path.pop()
                    continue
                other = of_target.get(t)
                if other is None:
                    for s in reversed(path):  # each takes the target that the next one gives up
                        given_up = of_source.get(s)
                        of_source[s], of_target[t] = t, s
                        t = given_up
                    break
                if layer.get(other) == layer[s] + 1:
                    path.append(other)


#: Rounds of taking pairs that a box has only one of, for all images of a batch at once, before augmenting paths.
ROUNDS = 16


def _first(keys: np.ndarray) -> np.ndarray:
    """The place of the first of each key."""
    return np.unique(keys, return_index=True)[1]


def most_pairs_each(groups: np.ndarray, sources: np.ndarray, targets: np.ndarray, n: int) -> np.ndarray:
    """most_pairs of each of n groups (numbers from 0); sources and targets are numbers not below 0.

    A box with one pair only can always take it, so such pairs are taken in rounds, of all groups at
    once; what is left after them, if anything, goes to augmenting paths group by group.
    """
    hits = np.zeros(n, np.int64)
    if not len(groups):
        return hits
    ends = []
    for values in (sources, targets):
        span = int(values.max()) + 1
        ends.append(np.unique(groups * span + values, return_inverse=True)[1])
    keep = _first(ends[0] * (int(ends[1].max()) + 1) + ends[1])
    groups, sides = groups[keep], [e[keep] for e in ends]
    for turn in range(2 * ROUNDS):
        if not len(groups):
            return hits
        leaf, other = sides[turn % 2], sides[1 - turn % 2]
        alone = np.flatnonzero(np.bincount(leaf)[leaf] == 1)
        taken = alone[_first(other[alone])]
        np.add.at(hits, groups[taken], 1)
        gone = np.zeros(int(other.max()) + 1, bool)
        gone[other[taken]] = True
        groups, *sides = (v[~gone[other]] for v in (groups, *sides))
    order = np.argsort(groups, kind="stable")
    groups, sides = groups[order], [v[order] for v in sides]
    cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(groups)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            hits[groups[a]] += most_pairs(sides[0][a:b].tolist(), sides[1][a:b].tolist())
    return hits


def match_boxes(expected: DataFrame, found: DataFrame, threshold: float = 0.5) -> DataFrame:
    """img, true_positives, false_positives, false_negatives: the most pairs of boxes (img, box, x, y, w, h) that overlap enough, each box in one.

    Only pairs of overlapping boxes are gathered, a row an image, and many images are matched at once.
    """
    a, b = expected.alias("a"), found.alias("b")
    meet = "a.img = b.img AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h"
    inter = F.expr("(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))")
    pairs = a.join(b, F.expr(meet)).where(inter >= F.lit(threshold) * (F.expr("a.w * a.h + b.w * b.h") - inter)).select("a.img", F.col("a.box").alias("target"), F.col("b.box").alias("source"))
    gathered = pairs.groupBy("img").agg(F.collect_list(F.struct("source", "target")).alias("pairs"))

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("pairs")
            groups = lists.value_parent_indices().to_numpy().astype(np.int64)
            sources, targets = (v.dictionary_encode("encode").indices.to_numpy().astype(np.int64) for v in lists.flatten().flatten())
            yield pa.RecordBatch.from_arrays([batch.column("img"), pa.array(most_pairs_each(groups, sources, targets, batch.num_rows))], ["img", "n"])

    kind = expected.schema["img"].dataType.simpleString()
    hits = gathered.mapInArrow(matched, f"img {kind}, n long")
    counted = lambda rows, *n: rows.select("img", *(F.lit(v).cast("long").alias(c) if isinstance(v, int) else F.col(v).alias(c) for v, c in zip(n, "efn", strict=True)))
    sizes = counted(expected, 1, 0, 0).unionAll(counted(found, 0, 1, 0)).unionAll(counted(hits, 0, 0, "n")).groupBy("img").agg(*(F.sum(c).alias(c) for c in "efn"))
    e, f, n = (F.col(c) for c in "efn")
    return sizes.select("img", n.alias("true_positives"), (f - n).alias("false_positives"), (e - n).alias("false_negatives"))


def detection_scores(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 over all images; null where nothing is to be divided by."""
    total = counts.agg(*(F.sum(c).alias(c) for c in ("true_positives", "false_positives", "false_negatives")))
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 9))
    return total.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})
