"""Secret scans: patterns propose, a random forest trained on labelled findings removes false alarms."""

from __future__ import annotations

import json
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterfold.llm.common import text_of

#: Kinds of candidates; the group is the secret itself. Order matters where two start together.
PATTERNS = (
    ("private_key", r"(-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:(?:[\sA-Za-z0-9+/=:,.]|-(?!-))*+-----END [A-Z ]{0,30}PRIVATE KEY-----)?)"),
    ("aws_key", r"(?<![A-Za-z0-9])((?:AKIA|ASIA)[A-Z0-9]{16})(?![A-Za-z0-9])"),
    ("github_token", r"(?<![A-Za-z0-9])(gh[pousr]_[A-Za-z0-9]{36,})"),
    ("web_token", r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]*+)"),
    ("assignment", r"(?i:token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key|credential)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"'<>]{6,}+)"),
    ("long_string", r"(?<![A-Za-z0-9+/_=-])((?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}+)"),
)
_FINDER = re.compile("|".join(f"(?P<{kind}>{p})" for kind, p in PATTERNS))
_GROUP = {kind: _FINDER.groupindex[kind] + 1 for kind, _ in PATTERNS}
_KIND = {kind: i for i, (kind, _) in enumerate(PATTERNS)}
#: Words of code and prose (where no vocabulary is given), of placeholders, and of places where such strings are no secrets.
DICTIONARY = ("access", "account", "admin", "application", "class", "client", "code", "config", "content", "data", "database", "default", "document", "error", "file", "function", "group", "image", "index", "input", "item", "license", "list", "local", "message", "module", "name", "number", "object", "option", "output", "page", "param", "path", "public", "query", "request", "response", "result", "return", "server", "service", "session", "string", "system", "table", "test", "text", "time", "type", "update", "user", "value", "version", "window", "with")
PLACEHOLDERS = ("example", "your", "changeme", "placeholder", "dummy", "sample", "xxxx", "todo", "insert", "redacted", "secret_here", "token_here", "password", "${", "{{", "1234567", "abcdef")
HARMLESS = ("commit", "sha", "md5", "hash", "checksum", "digest", "uuid", "guid", "etag", "revision", "integrity", "build", "image", "blob", "tree")
TELLING = ("token", "secret", "password", "passwd", "key", "auth", "credential", "bearer", "login", "pwd")
TEST_PATHS = ("test", "example", "sample", "mock", "fixture", "doc")
NEAR, SHORTEST = 32, 4
#: At most so many labelled findings are read for training.
SAMPLE = 50_000
FEATURES = ("length", "entropy", "class_changes", "upper", "lower", "digits", "others", "hexadecimal", "vowels", "repeats", "dictionary", "placeholder", "test_path", "telling_before", "harmless_before", "after_is_word", "kind")
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")


@cache
def words_of(vocabulary: str | None) -> tuple[frozenset[str], dict[str, list[int]]]:
    """Words of SHORTEST letters and more that a value may be made of, and for each beginning of a word its lengths, the longest first.

    They are DICTIONARY, or the whole words of letters in a tokenizers file besides.
    """
    words = frozenset(DICTIONARY)
    if vocabulary is not None:
        with open(vocabulary, encoding="utf-8") as f:
            known = json.load(f)["model"]["vocab"]
        whole = (x.removesuffix("</w>") for x in known if x.endswith("</w>"))
        words |= frozenset(x for x in whole if len(x) >= SHORTEST and x.isascii() and x.isalpha())
    sizes: dict[str, set[int]] = {}
    for word in words:
        sizes.setdefault(word[:SHORTEST], set()).add(len(word))
    return words, {begin: sorted(n, reverse=True) for begin, n in sizes.items()}


def covered(low: str, vocabulary: str | None) -> int:
    """Characters that the longest words from each place on cover, without overlaps."""
    words, sizes = words_of(vocabulary)
    at = total = 0
    while at < len(low):
        found = next((n for n in sizes.get(low[at : at + SHORTEST], ()) if low[at : at + n] in words), 0)
        total += found
        at += found or 1
    return total


def features(kind: str, value: str, before: str, after: str, path: str, vocabulary: str | None = None) -> list[float]:
    n, low = max(1, len(value)), value.lower()
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    classes = ["u" if c.isupper() else "l" if c.islower() else "d" if c.isdigit() else "o" for c in value]
    near = before.lower()
    return [
        float(min(n, 200)), entropy, sum(map(str.__ne__, classes, classes[1:])) / n, classes.count("u") / n, classes.count("l") / n, classes.count("d") / n, classes.count("o") / n,
        float(bool(re.fullmatch(r"[0-9a-fA-F]+", value))), sum(c in "aeiou" for c in low) / n, sum(map(str.__eq__, value, value[1:])) / n, covered(low, vocabulary) / n,
        float(any(p in low for p in PLACEHOLDERS) or bool(_UUID.fullmatch(value))), float(any(p in path.lower() for p in TEST_PATHS)), float(any(w in near for w in TELLING)), float(any(w in near for w in HARMLESS)),
        float(after[:1].isalpha()), float(_KIND[kind]),
    ]


def candidates(text: str, path: str, vocabulary: str | None = None) -> Iterator[tuple[str, int, int, list[float]]]:
    """kind, start, end, features of each proposed span, leftmost first, without overlaps."""
    for m in _FINDER.finditer(text):
        kind = m.lastgroup
        begin, end = m.span(_GROUP[kind]) if m.end(_GROUP[kind]) > m.start(_GROUP[kind]) else m.span()
        yield kind, begin, end, features(kind, text[begin:end], text[max(0, begin - NEAR) : begin], text[end : end + NEAR], path, vocabulary)


def labelled_findings(n: int = 3000, seed: int = 11) -> list[tuple[str, str, bool]]:
    """(text, path, is secret) of made-up findings, half of them false alarms: the default training set.

    A reviewed set of a user's own findings takes its place by the parameter of train_forest.
    """
    draw, out = random.Random(seed), []
    word = lambda: "".join(draw.choice(("an", "re", "ti", "on", "es", "st", "or", "ka", "mi", "lo")) for _ in range(draw.randint(1, 4)))
    chars = lambda k, of: "".join(draw.choices(of, k=k))
    alnum, hexa = string.ascii_letters + string.digits, "0123456789abcdef"
    for i in range(n):
        secret = i % 2 == 0
        if secret:
            value = draw.choice((lambda: chars(40, hexa), lambda: chars(draw.randint(24, 64), hexa), lambda: chars(draw.randint(20, 60), alnum), lambda: chars(draw.randint(20, 60), alnum + "+/"), lambda: chars(draw.randint(10, 18), alnum + "!#%&*")))()
            lead = draw.choice(('token = "', 'secret: "', "password=", "api_key = '", "access_key: ", "Authorization token: "))
            if draw.random() < 0.2:
                lead, value = "", draw.choice(("AKIA" + chars(16, string.ascii_uppercase + string.digits), "ghp_" + chars(36, alnum), "eyJ" + chars(30, alnum) + "." + chars(60, alnum) + "." + chars(43, alnum)))
        else:
            lead, value = draw.choice((
                lambda: ("commit ", chars(40, hexa)), lambda: ("sha256: ", chars(64, hexa)), lambda: ("md5 ", chars(32, hexa)), lambda: ("uuid = ", "-".join(chars(k, hexa) for k in (8, 4, 4, 4, 12))),
                lambda: ('token = "', draw.choice(PLACEHOLDERS) + "_" + word()), lambda: ("password: ", "xxxxxxxx" + "x" * draw.randint(0, 9)), lambda: ("secret = ", "${" + word().upper() + "_KEY}"),
                lambda: ("", "_".join(draw.choice(DICTIONARY) for _ in range(4)) + str(draw.randint(1, 99))), lambda: ("token: ", word() + word()), lambda: ("", chars(draw.randint(20, 30), string.digits)), lambda: ("key = ", "a" * draw.randint(20, 30) + "1"),
                lambda: ("password = ", draw.choice(DICTIONARY) + draw.choice(DICTIONARY)),
            ))()
        text = f'{word()} {word()} {lead}{value}{draw.choice((chr(34), "", "."))} {word()} {word()}'
        out.append((text, draw.choice(("src/app.py", "src3", "tests/data.py", "config/prod.yml", "web")), secret))
    return out


def _proposed(docs: DataFrame, vocabulary: str | None) -> DataFrame:
    """doc_id, kind, start, end, x (features) of each candidate in docs (doc_id, text, path); ids go around pandas."""

    def proposed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, *c) for n, (text, where) in enumerate(zip(batch["text"].to_pylist(), batch["path"].to_pylist(), strict=True)) for c in candidates(text, where, vocabulary)]
            n, kinds, starts, ends, x = zip(*rows, strict=True) if rows else ((),) * 5
            longs = [pa.array(v, pa.int64()) for v in (n, starts, ends)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(longs[0]), pa.array(kinds, pa.string()), *longs[1:], pa.array(x, pa.list_(pa.float64()))], ["doc_id", "kind", "start", "end", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(proposed, f"doc_id {kind}, kind string, start long, end long, x array<double>")


def train_forest(spark: SparkSession, findings: DataFrame | list[tuple[str, str, bool]] | None = None, trees: int = 20, depth: int = 7, seed: int = 5, vocabulary: str | None = None, sample: int = SAMPLE) -> RandomForestClassificationModel:
    """A random forest from labelled findings (text, path, is_secret): the first candidate of each text has its label.

    findings is a table of reviewed findings or a list of such rows; made-up ones are the default.
    Rows without a label or a candidate are passed over. At most sample rows are read, the first by
    a hash. The dictionary is that of vocabulary, which scan_secrets has to be given too.
    """
    if not isinstance(findings, DataFrame):
        findings = spark.createDataFrame(labelled_findings() if findings is None else findings, "text string, path string, is_secret boolean")
    known = findings.where(F.col("is_secret").isNotNull()).select(text_of().alias("text"), text_of("path").alias("path"), "is_secret")
    known = known.orderBy(F.xxhash64("text", "path", "is_secret"), "text", "path", "is_secret").limit(sample)
    labelled = known.select(F.struct("text", "path", "is_secret").alias("doc_id"), "text", "path")
    first = _proposed(labelled, vocabulary).groupBy("doc_id").agg(F.min(F.struct("start", "x")).alias("first"))
    data = first.select(F.col("first.x").alias("x"), F.col("doc_id.is_secret").cast("double").alias("label")).coalesce(1).sortWithinPartitions("x", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=32, subsamplingRate=0.8).fit(data.select(array_to_vector("x").alias("features"), "label"))


def scan_secrets(docs: DataFrame, model: RandomForestClassificationModel, path: str = "source", accept: float = 0.5, vocabulary: str | None = None) -> DataFrame:
    """One row per candidate in docs (doc_id, text, a path column): doc_id, kind, start, end, score, is_secret.

    Offsets count code points, ends are exclusive; strings, assigned values and private keys are
    whole, however long. score is the forest's share for a secret. A null text counts as empty, a
    null path as an empty one; null ids and ids of any size stay as they are; documents without
    candidates give no rows, so an empty table gives none; rows that repeat are answered alike;
    other columns are ignored. One pass, no shuffle.
    """
    found = _proposed(docs.select("doc_id", text_of().alias("text"), text_of(path).alias("path")), vocabulary)
    judged = model.transform(found.withColumn("features", array_to_vector("x"))).withColumn("score", F.element_at(vector_to_array("probability"), 2))
    return judged.select("doc_id", "kind", "start", "end", "score", (F.col("score") >= accept).alias("is_secret"))
