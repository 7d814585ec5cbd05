"""Toxicity by a weighted finite-state pattern grammar, scored by clause.

Five small transducers read a clause's words side by side: target (someone is spoken of
or to), insult (words of the lexicon, with weights), threat (a will, a harm, a target),
negation (damps the three words after it) and reported speech (damps the rest of the
clause). Their product is one automaton over word classes; each step multiplies or adds
weight. A clause's score is what its path gathers; isolated words outside a matched
clause give nothing. A logistic curve over a document's clause scores gives its score.

The insult lexicon holds words and word beginnings with their log odds, learnt from
labelled documents; so are the curve's few numbers. The grammar is fixed.
Learning reads a sample of labelled rows, of a bound that is a parameter.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm.common import bounded_sample, held_out, small_batches, stash, table

# The grammar's closed word classes.
TARGETS = "you your yours u he she they them him her his their this that these those who du ihr dein euch sie er tu toi ton vous votre il elle ils usted ustedes tú ellos ella él".split()
NEGATIONS = "not no never nobody none without isn't wasn't aren't don't nicht kein keine nie pas jamais aucun nunca ningún sin".split()
REPORTS = "said says say saying wrote writes called claims claimed quoted quote told reported reports sagte schrieb dit écrit dijo escribió".split()
WILLS = "will would shall gonna going should must werde werden wird vais va vamos voy".split()
HARMS = "kill hurt beat shoot stab burn destroy hang punch murder attack töten schlagen tuer frapper matar golpear".split()
OTHER, TARGET, NEGATION, REPORT, WILL, HARM, INSULT = range(7)
CLASSES = {w: c for c, ws in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (WILL, WILLS), (HARM, HARMS)) for w in ws}
TARGET_BONUS, NEGATED, REPORTED, THREAT_WEIGHT = 1.25, 0.6, 0.75, 3.0

# Learning.
SAMPLE_ROWS = 8_000
PREFIXES = range(4, 9)
LEAST_DOCS, LEAST_ODDS, LEAST_SURE = 5, 1.5, 6.0

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE_END = re.compile(r"[.!?;:\n]")


def _compose() -> dict[tuple, tuple]:
    """The product of the five transducers: (state, class) -> (state, add, factor).

    A state is (target seen, words still negated, reported, threat steps).
    """
    steps = {}
    for target, negated, reported, threat in product((0, 1), range(4), (0, 1), range(3)):
        for c in range(7):
            factor = (TARGET_BONUS if target else 1.0) * (NEGATED if negated else 1.0) * (REPORTED if reported else 1.0)
            add = 0.0
            next_threat = 1 if c == WILL else 2 if c == HARM and threat == 1 else threat
            if threat == 2 and c == TARGET:
                add, next_threat = THREAT_WEIGHT, 0
            state = (int(target or c == TARGET), 3 if c == NEGATION else max(0, negated - 1), int(reported or c == REPORT), next_threat)
            steps[(target, negated, reported, threat), c] = (state, add, factor)
    return steps


STEPS, START = _compose(), (0, 0, 0, 0)


@dataclass
class Grammar:
    words: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, ...] = (-3.0, 1.0, 0.5, 0.5)

    def insult(self, word: str) -> float:
        found = self.words.get(word, 0.0)
        for n in PREFIXES:
            if n < len(word):
                found = max(found, self.beginnings.get(word[:n], 0.0))
        return found

    def clause(self, words: list[str]) -> float:
        """The weight that a clause's path gathers."""
        state, total = START, 0.0
        for w in words:
            weight = self.insult(w)
            c = INSULT if weight else CLASSES.get(w, OTHER)
            state, add, factor = STEPS[state, c]
            total += factor * (add + weight)
        return total


class Scanner:
    """Finds the clauses that hold an insult or a harm, by one pass over the text."""

    def __init__(self, grammar: Grammar):
        import ahocorasick

        self.grammar, self.anchors = grammar, ahocorasick.Automaton()
        for kind, keys in (("word", {*grammar.words, *HARMS}), ("beginning", grammar.beginnings)):
            for k in keys:
                if self.anchors.get(k, None) != "beginning":
                    self.anchors.add_word(k, kind)
        for k in list(self.anchors.keys()):
            self.anchors.add_word(k, (len(k), self.anchors.get(k) == "word"))
        self.any = len(self.anchors) > 0
        if self.any:
            self.anchors.make_automaton()

    def features(self, text: str) -> tuple[float, float, float]:
        """The heaviest clause, and the logarithms of all clauses' weight, whole and for the length."""
        if not self.any or not text:
            return 0.0, 0.0, 0.0
        low = text.lower()
        most = total = 0.0
        upto = -1
        for end, (size, whole) in self.anchors.iter(low):
            start = end - size + 1
            if start < upto or start and low[start - 1].isalpha() or whole and end + 1 < len(low) and low[end + 1].isalpha():
                continue
            first = max(low.rfind(c, max(upto, 0), start) for c in ".!?;:\n") + 1 or max(upto, 0)
            close = _CLAUSE_END.search(low, end)
            upto = close.start() if close else len(low)
            weight = self.grammar.clause(_WORD.findall(low, first, upto))
            most, total = max(most, weight), total + weight
        return most, math.log1p(total), math.log1p(2_000 * total / (len(low) + 200))

    def score(self, text: str) -> float:
        z = self.grammar.curve[0] + sum(w * x for w, x in zip(self.grammar.curve[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _patterns(text: str) -> set[str]:
    """The words of a text, and their beginnings marked by a star."""
    words = {w for w in _WORD.findall(text.lower()) if len(w) > 2}
    return words | {w[:n] + "*" for w in words for n in PREFIXES if n < len(w)}


def _lexicon(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> tuple[dict, dict]:
    """Words and beginnings that stand out in toxic documents, the surest first.

    A form that a kept beginning covers is kept only where it says clearly more.
    """
    rated = []
    for pattern, t, c in counts:
        odds = float(np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1)))
        expected = (t + c) * toxic / max(1, toxic + clean)
        sure = (t - expected) / max(expected, 1e-9) ** 0.5
        if t >= LEAST_DOCS and odds >= LEAST_ODDS and sure >= LEAST_SURE:
            rated.append((sure, pattern, odds))
    rated.sort(key=lambda x: (-x[0], -len(x[1]), x[1]))
    words: dict[str, float] = {}
    beginnings: dict[str, float] = {}
    for _, pattern, odds in rated:
        stem = pattern.rstrip("*")
        covered = max((beginnings.get(stem[:n], 0.0) for n in PREFIXES if n <= len(stem)), default=0.0)
        if covered + 0.5 > odds or pattern.endswith("*") and any(b.startswith(stem) for b in beginnings):
            continue
        (beginnings if pattern.endswith("*") else words)[stem] = odds
    return words, beginnings


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression of the labels on the clause features, by Newton's method."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 0.05 * np.eye(len(w))
        w += np.clip(np.linalg.solve(h, a.T @ (y - p) - 0.05 * w), -2, 2)
    return tuple(float(v) for v in w)


def learn(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> Grammar:
    """A grammar from labels (doc_id, toxic), held-out rows left out.

    At most about ``bound`` labelled rows are read, so the labels are broadcast to docs.
    A doc_id labelled twice counts as toxic if any label says so; null labels are dropped.
    Texts count once for the lexicon, however many copies the sample has of them; a copy is
    toxic if any is. The lexicon has no bound but that of the sample.
    """
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = bounded_sample(known, F.col("doc_id"), bound)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id").select("text", "toxic")
    rows = stash(rows.groupBy("text").agg(F.max("toxic").alias("toxic")), "labelled")

    def count(batches: Iterator) -> Iterator:
        import pandas as pd

        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for pdf in batches:
            for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
                seen[int(toxic > 0)].update(_patterns(text))
                seen[int(toxic > 0)][""] += 1
        both = [(p, n, seen[0][p]) for p, n in seen[1].items()] + [(p, 0, n) for p, n in seen[0].items() if p not in seen[1]]
        yield pd.DataFrame(both, columns=["pattern", "toxic", "clean"])

    counts = rows.mapInPandas(count, "pattern string, toxic long, clean long").groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    found = counts.where(F.expr(f"pattern = '' or toxic >= {LEAST_DOCS} and clean <= 3 * toxic")).orderBy(F.desc("toxic"), "pattern").collect()
    totals = next(((r["toxic"], r["clean"]) for r in found if r["pattern"] == ""), (0, 0))
    grammar = Grammar(*_lexicon([(r["pattern"], r["toxic"], r["clean"]) for r in found if r["pattern"]], *totals))

    def features(batches: Iterator) -> Iterator:
        import pandas as pd

        scan = Scanner(grammar)
        for pdf in batches:
            got = [scan.features(t) for t in pdf["text"]]
            yield pd.DataFrame(got, columns=["a", "b", "c"]).assign(y=pdf["toxic"].gt(0).astype(int).to_numpy())

    points = rows.mapInPandas(features, "a double, b double, c double, y int").toPandas()
    if points["y"].nunique() == 2:
        points = points.sort_values(["a", "b", "c", "y"])
        grammar.curve = _curve(points[["a", "b", "c"]].to_numpy(float), points["y"].to_numpy(float))
    return grammar


def score_of(docs: DataFrame, grammar: Grammar, text_col: str = "text") -> Column:
    """A column of docs: a score from 0 to 1 for each whole text.

    Null and empty texts have the lowest score. Only the text goes to Python, and only the
    score comes back.
    """
    import pandas as pd

    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scan = Scanner(grammar)
        for batch in texts:
            yield pd.Series([scan.score(t or "") for t in batch])

    return scores(F.col(text_col))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    grammar = learn(docs, table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", score_of(docs, grammar).alias("score"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
