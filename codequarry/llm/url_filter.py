"""URL verdicts: host and path rules first, boosted trees on lexical features else.

Features: lengths, depth, digit and hyphen ratios, entropy, numbers of parameters and
labels, and how often labelled urls of the same suffix (the last label, the last two)
and with the same host words were blocked. The trees learn from labelled urls: those
that carry a label column, or, where a table has none as here, urls that are labelled by
what they are made of: each sampled url is clean unless a host word is on a seed list, and
altered copies of clean ones, with the shapes of junk urls (long hyphenated hosts, runs of
digits and random letters, deep paths, many parameters), block. Half of the listed words
are replaced by others in the copies that are learnt from, so that a listed word explains
only part of the labels, and lexical shape must explain the rest. At most SAMPLE_ROWS urls
of the table are learnt from.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm.boosting import Trees, fit
from codequarry.llm.common import bounded_sample, gives_back, table

SAMPLE_ROWS = 8_000
#: Rules of the contract: (host and path prefix, verdict).
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
SEED_WORDS = {"spam", "casino", "pills", "bets", "bet", "cheap", "ads", "track", "tracker", "win", "farm", "free", "loans", "viagra", "porn", "xxx", "poker", "replica", "phish"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = re.compile(r"[a-z0-9]+")


def host_of(url: Column) -> Column:
    """After the first ://, up to / ? # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


class Lexical:
    """Numbers of a url; keeps the block rates of suffixes and host words it was fitted on."""

    def __init__(self):
        self.rates: dict[str, float] = {}

    @staticmethod
    def _parts(url: str) -> tuple[str, str, str]:
        rest = url.partition("://")[2]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0].lower()
        return host, rest[len(host) :].partition("#")[0].partition("?")[0], rest.partition("#")[0].partition("?")[2]

    @staticmethod
    def _keys(host: str) -> tuple[str, str, list[str]]:
        labels = host.split(".")
        return "1" + labels[-1], "2" + ".".join(labels[-2:]), ["w" + w for w in _WORDS.findall(".".join(labels[:-2]) or host)]

    def learn(self, urls: list[str], blocked: np.ndarray) -> None:
        seen: Counter = Counter()
        bad: Counter = Counter()
        for u, b in zip(urls, blocked, strict=True):
            last, two, words = self._keys(self._parts(u)[0])
            for k in {last, two, *words}:
                seen[k] += 1
                bad[k] += int(b)
        share = float(np.mean(blocked)) if len(urls) else 0.0
        self.rates = {"": share} | {k: (bad[k] + 8 * share) / (n + 8) for k, n in seen.items()}  # a rare key tells little

    def row(self, url: str) -> list[float]:
        host, path, query = self._parts(url)
        last, two, words = self._keys(host)
        n = max(1, len(url))
        counts = np.array(list(Counter(host).values()), float) / max(1, len(host))
        rate = self.rates.get
        base = rate("", 0.0)
        return [
            len(url), len(host), len(path), path.count("/"), sum(c.isdigit() for c in url) / n, sum(c.isdigit() for c in path) / max(1, len(path)), host.count("-"), host.count("."),
            float(-(counts * np.log2(counts)).sum()) if host else 0.0, query.count("="), max((len(w) for w in _WORDS.findall(host)), default=0),
            sum(c.isdigit() for c in host), path.count("-") + path.count("_"), len(query), max((len(w) for w in _WORDS.findall(path.lower())), default=0),
            rate(last, base), rate(two, base), max((rate(w, base) for w in words), default=base),
        ]

    def matrix(self, urls: list[str]) -> np.ndarray:
        return np.array([self.row(u) for u in urls], float).reshape(len(urls), 18)


def listed(url: str) -> int:
    """1 if a host word is on the seed list."""
    return int(not SEED_WORDS.isdisjoint(_WORDS.findall(Lexical._parts(url)[0])))


def altered(url: str, rng: np.random.Generator) -> str:
    """A junk url of a clean one's scheme and suffix."""
    host, path, query = Lexical._parts(url)
    labels = host.split(".")
    letters, digits = list("abcdefghijklmnopqrstuvwxyz"), list("0123456789")
    some = lambda n, of: "".join(rng.choice(of, n))
    syllables = lambda: "".join(some(1, list("bcdfghklmnprstvwz")) + some(1, list("aeiou")) for _ in range(int(rng.integers(2, 4))))
    kind = rng.integers(4)
    name = "-".join(syllables() for _ in range(int(rng.integers(2, 6)))) if kind < 2 else some(int(rng.integers(10, 24)), letters + digits) if kind == 2 else syllables() + some(int(rng.integers(3, 8)), digits)
    at = max(0, len(labels) - 3)
    host = ".".join([*labels[:at], name, *labels[at + 1 :]]) if len(labels) > 2 else ".".join([name, *labels])
    if rng.random() < 0.4:
        path = "/" + "/".join(some(int(rng.integers(4, 12)), letters + digits) for _ in range(int(rng.integers(3, 9))))
    if rng.random() < 0.4:
        query = "&".join(f"{some(2, letters)}={some(6, letters + digits)}" for _ in range(int(rng.integers(3, 9))))
    return f"{url.partition('://')[0]}://{host}{path}" + (f"?{query}" if query else "")


def unlisted(url: str, rng: np.random.Generator) -> str:
    """url with each listed word of its host replaced by a word of like length."""
    head, sep, rest = url.partition("://")
    host = Lexical._parts(url)[0]
    put = _WORDS.sub(lambda m: "".join(rng.choice(list("aeioubdklmnrst"), len(m[0]))) if m[0] in SEED_WORDS else m[0], host)
    return f"{head}{sep}{put}{rest[len(host):]}"


def made_labels(urls: list[str]) -> tuple[list[str], np.ndarray]:
    """urls with altered copies, and their labels; the same urls give the same copies."""
    names, y = [], []
    for u in urls:
        rng, bad = np.random.default_rng(zlib.crc32(u.encode())), listed(u)
        names.append(unlisted(u, rng) if bad and rng.random() < 0.5 else u)
        y.append(bad)
        if "://" in u and not bad and rng.random() < 0.3:
            names.append(altered(u, rng))
            y.append(1)
    return names, np.array(y, float)


def learn(urls: DataFrame, url_col: str = "url", label_col: str | None = None, bound: int = SAMPLE_ROWS) -> tuple[Lexical, Trees]:
    """Trees from labelled urls (label 1: block); labels are made where label_col is None.

    Null urls teach nothing, a url labelled twice counts as its higher label, and a null
    label leaves its url out.
    """
    rows = urls.where(F.col(url_col).isNotNull()).select(F.col(url_col).alias("url"), (F.col(label_col) if label_col else F.lit(0)).cast("int").alias("label"))
    rows = rows.where("label is not null").groupBy("url").agg(F.max("label").alias("label"))
    found = sorted(bounded_sample(rows, F.col("url"), bound).collect())
    names, y = [r["url"] for r in found], np.array([r["label"] for r in found], float)
    if label_col is None:
        names, y = made_labels(names)
    lexical = Lexical()
    # rates come from one half and trees from the other, so that rates aren't trusted blindly
    half = np.array([zlib.crc32(u.encode()) % 2 for u in names], bool) if names else np.zeros(0, bool)
    lexical.learn([u for u, h in zip(names, half, strict=True) if h], y[half])
    return lexical, fit(lexical.matrix([u for u, h in zip(names, half, strict=True) if not h]), y[~half], rounds=40, depth=4)


def judge(urls: DataFrame, model: tuple[Lexical, Trees], keep: list[str], url_col: str = "url", rules=RULES) -> DataFrame:
    """keep, host, path, rule, verdict and score (the trees' chance of block).

    A null url or one without :// has no host, no rule and the trees' verdict on nothing.
    """

    def scores(batches: Iterator) -> Iterator:
        import pyarrow as pa

        lexical, trees = model
        for b in batches:
            x = lexical.matrix([u or "" for u in b.column(b.num_columns - 1).to_pylist()])
            got = 1 / (1 + np.exp(-trees.margin(x)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got)], names=[*b.schema.names[:-1], "score"])

    url = F.col(url_col)
    rows = urls.select(*keep, host_of(url).alias("host"), path_of(url).alias("path"), url.alias("_url"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).select(*keep, "host", "path", "rule", "_url")
    out = rows.mapInArrow(gives_back(scores), rows.drop("_url").schema.add("score", "double"))
    own = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    ruled = F.create_map(*[F.lit(x) for r in rules for x in r])[F.col("rule")]
    return out.select(*keep, "host", "path", "rule", F.when(F.col("rule").isNotNull(), ruled).otherwise(own).alias("verdict"), "score")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, learn(pages), ["page_id"])
