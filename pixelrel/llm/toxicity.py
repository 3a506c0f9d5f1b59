"""Toxicity by class-conditional Kneser-Ney word-pair models over one shared backoff."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import chain
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, stage, table

DISCOUNT = 0.75
THRESHOLD = 0.7
#: An expression is modelled per class only where it is this many times commoner in toxic text ...
EXCESS = 3.0
#: ... by a likelihood-ratio test: words at p = 0.01, pairs at p = 0.01 over all pairs tested together.
WORD_TEST, PAIR_TEST = 6.63, 0.01
#: Features (a number and two keys) are broadcast up to this many rows, else joined by shuffle.
BROADCAST_ROWS = 2_000_000
START, ANY = 0, -1
WORD = re.compile(r"[^\W_]+")
KINDS = ["n00", "n01", "n10", "n11"]  # texts by fold and class
PAIRS = "prev long, word long, " + ", ".join(f"{k} long" for k in KINDS)
SEEN = "prev long, word long, kinds int, " + ", ".join(f"{k} long" for k in KINDS)
#: Folds a model learns from; "a" scores the rows of fold 1 and "b" those of fold 0 for the calibration.
VARIANTS = {"a": "0", "b": "1", "all": "01"}


class _Hashes(dict):
    """64-bit hashes of words, remembered between batches up to a bound."""

    def __missing__(self, word: str) -> int:
        import xxhash

        self[word] = found = xxhash.xxh64_intdigest(word)
        return found

    def trim(self, bound: int = 1 << 17) -> None:
        if len(self) > bound:
            self.clear()


def _tokens(texts, hashes: _Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, of the words before them, and the number of words of each text."""
    words = [WORD.findall(t.lower()) if t else [] for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter(map(hashes.__getitem__, chain.from_iterable(words)), np.uint64, int(sizes.sum())).view(np.int64)
    prev = np.empty_like(flat)
    prev[1:] = flat[:-1]
    prev[(np.cumsum(sizes) - sizes)[sizes > 0]] = START
    return flat, prev, sizes


def _portions(pdf: pd.DataFrame, chars: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """Rows in order, in portions of about ``chars`` characters: memory follows that, not the batch."""
    upto = pdf["text"].str.len().fillna(0).cumsum().to_numpy()
    for _, part in pdf.groupby(upto // chars, sort=True):
        yield part


def _count_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs (prev, word) of a portion of texts with the number of its texts that hold them, by fold and class."""
    hashes = _Hashes()
    for pdf in batches:
        for part in _portions(pdf):
            hashes.trim()
            word, prev, sizes = _tokens(part["text"], hashes)
            ids, local = np.unique(np.concatenate([word, prev]), return_inverse=True)
            w, v = local[:len(word)], local[len(word):]
            pair, owner = v * len(ids) + w, np.repeat(np.arange(len(part)), sizes)
            order = np.argsort(pair, kind="stable")
            pair, owner = pair[order], owner[order]
            new = np.ones(len(pair), bool)
            new[1:] = pair[1:] != pair[:-1]
            once = new.copy()
            once[1:] |= owner[1:] != owner[:-1]
            kind = (part["fold"].to_numpy() * 2 + part["toxic"].to_numpy())[owner]
            group = np.cumsum(new) - 1
            counts = {k: np.bincount(group[once & (kind == i)], minlength=int(new.sum())) for i, k in enumerate(KINDS)}
            first = pair[new]
            yield pd.DataFrame({"prev": ids[first // max(len(ids), 1)], "word": ids[first % max(len(ids), 1)], **counts})


def _see_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs (prev, word) of a portion of texts with a bit for each of ``KINDS`` that holds them; last, a row without words that has the sums of their counts."""
    sums = dict.fromkeys(KINDS, 0)
    for pdf in _count_pairs(batches):
        sums = {k: n + int(pdf[k].sum()) for k, n in sums.items()}
        kinds = ((pdf[KINDS].to_numpy() > 0) @ (1 << np.arange(len(KINDS)))).astype(np.int32)
        yield pd.DataFrame({"prev": pdf["prev"], "word": pdf["word"], "kinds": kinds, **dict.fromkeys(KINDS)})
    yield pd.DataFrame({"prev": [None], "word": [None], "kinds": [0], **{k: [n] for k, n in sums.items()}})


def _predecessors(rows: DataFrame) -> DataFrame:
    """Per word and variant the distinct words before it in toxic (t), ordinary (o) and all (s) texts; a row without a word has the sums of ``KINDS``.

    All words are counted, so rows follow the input, whatever later tests ask for.
    """
    sums = [F.sum(k).alias(k) for k in KINDS]
    pairs = rows.mapInPandas(_see_pairs, SEEN).groupBy("prev", "word").agg(F.bit_or("kinds").alias("kinds"), *sums)
    mask = lambda folds, classes: sum(1 << KINDS.index(f"n{f}{c}") for f in folds for c in classes)
    counts = [F.count_if(F.col("kinds").bitwiseAND(mask(f, c)) > 0).alias(f"{n}_{v}") for v, f in VARIANTS.items() for n, c in (("t", "1"), ("o", "0"), ("s", "01"))]
    return pairs.groupBy("word").agg(*counts, *sums)


def _of(folds: str, toxic: str) -> Column:
    """Sum of the text counts of those folds and classes."""
    return sum((F.col(f"n{f}{c}") for f in folds for c in toxic), F.lit(0))


def _raised(share):
    """The toxic share of an expression ``EXCESS`` times commoner in toxic text than one of toxic share ``share``."""
    return EXCESS * share / (EXCESS * share + 1 - share)


def _evidence(t: Column, o: Column, share) -> Column:
    """Likelihood-ratio statistic of t toxic and o ordinary counts against ``share``; 0 where they do not exceed it."""
    share = share if isinstance(share, Column) else F.lit(float(share))
    n = t + o
    part = lambda k, q: F.when(k > 0, k * F.log(k / (n * q))).otherwise(0.0)
    return F.when(t > n * share, 2 * (part(t, share) + part(o, 1 - share))).otherwise(0.0)


@dataclass
class Model:
    """Log-likelihood ratio per word: ``base`` plus the values of the features (prev, word, value) it matches.

    A feature holds for a word (prev ANY), after a word (word ANY), or for a pair. ``weight`` maps the mean ratio to a score.
    """

    features: DataFrame | None = None
    base: float = 0.0
    weight: tuple[float, float] = (0.0, -3.0)
    rows: int = 0
    words: DataFrame | None = None
    totals: dict = field(default_factory=dict)


def _totals(words: DataFrame) -> dict[str, dict[str, float]]:
    """Per variant: distinct pairs of toxic, ordinary and all texts, distinct words, and texts counted per class."""
    made = []
    for v, folds in VARIANTS.items():
        made += [F.sum(f"{n}_{v}").alias(f"{v}_{n}") for n in "tos"] + [F.count_if(F.col(f"s_{v}") > 0).alias(f"{v}_v")]
        made += [F.sum(_of(folds, c)).alias(f"{v}_n{c}") for c in "01"]
    row = words.agg(*made).first()
    return {v: {k: float(row[f"{v}_{k}"] or 0) for k in ("t", "o", "s", "v", "n0", "n1")} for v in VARIANTS}


def fit(labelled: DataFrame) -> Model:
    """Fit both models on ``labelled`` (text, toxic), every row counted by Spark.

    Both classes are interpolated Kneser-Ney models of word pairs with a discount under 1: P(w|v) is the discounted share of
    the pair among pairs after v, plus the weight freed there times P(w), itself the discounted share of w among the class's
    distinct pairs (continuation count) plus the freed weight times the continuation probability over both classes together.
    Expressions whose class counts do not differ by test (``EXCESS``, ``WORD_TEST``, ``PAIR_TEST``) are pruned: their weight
    goes to the shared backoff in both classes, so they say as much in one as in the other, seen or unseen. Each distribution still sums to 1.
    A pair counts once per text, a word once per distinct predecessor, so neither repeated lines nor copied texts weigh like
    many texts. Null and empty texts add nothing; with rows of one class only, scores are constant.

    Distinct predecessors are counted for every word, texts only for what could pass the test: toxic pairs, the rarer class, come first. Two models of one half of
    the rows each score the other half, from which a logistic calibration is fitted: halves by hash of the text, so exact copies stay together.
    """
    rows = labelled.where("text is not null").select("text", "toxic", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("fold"))
    pairs = rows.mapInPandas(_count_pairs, PAIRS)
    words = stage(_predecessors(rows), "predecessors")
    total = _totals(words)
    model = Model(weight=(0.0, 3.0 if total["all"]["n1"] and not total["all"]["n0"] else -3.0), totals=total)
    if not (total["all"]["n1"] and total["all"]["n0"]):
        return model
    live = {v: folds for v, folds in VARIANTS.items() if total[v]["n0"] and total[v]["n1"]}
    sums = [F.sum(k).alias(k) for k in KINDS]
    toxic = stage(rows.where("toxic = 1").mapInPandas(_count_pairs, PAIRS).groupBy("prev", "word").agg(*sums), "toxic_pairs")
    text_share = {v: total[v]["n1"] / (total[v]["n0"] + total[v]["n1"]) for v in live}
    pair_share = {v: total[v]["t"] / (total[v]["t"] + total[v]["o"]) for v in live}

    # Words and pairs that pass the test even were no ordinary text to hold them are counted in texts of both classes, and so are the words that such pairs begin with.
    least = {v: WORD_TEST / (2 * log(1 / _raised(pair_share[v]))) for v in live}
    hopeful = words.where("word is not null").where(" or ".join(f"t_{v} >= {least[v]}" for v in live)).select("word", F.lit(True).alias("is_word"))
    strict = {v: 2 * log(max(total[v]["s"], 1) / PAIR_TEST) for v in live}
    at_least = min(strict[v] / (2 * log(1 / _raised(text_share[v]))) for v in live)
    some = toxic.where(_of("01", "1") >= at_least).select("prev", "word", F.lit(True).alias("is_pair"))
    before = some.select("prev", F.lit(True).alias("is_context")).distinct()
    marked = pairs
    for marks, on in ((hopeful, ["word"]), (some, ["prev", "word"]), (before, ["prev"])):
        marked = marked.join(broadcast_if_small(marks, BROADCAST_ROWS), on, "left")
    key = lambda mark, prev, word: F.when(F.col(mark), F.struct(prev.alias("prev"), word.alias("word")))
    prev, word, any_ = F.col("prev"), F.col("word"), F.lit(ANY).cast("long")
    keys = F.array_compact(F.array(key("is_word", any_, word), key("is_pair", prev, word), key("is_context", prev, any_)))
    spread = stage(marked.select(F.explode(keys).alias("key"), *KINDS).groupBy("key").agg(*sums).select("key.*", *KINDS), "spread")
    telling = {v: _evidence(_of(f, "1"), _of(f, "0"), _raised(text_share[v])) >= WORD_TEST for v, f in live.items()}
    shares = spread.where(F.col("prev") == ANY).select("word", *[F.when(c, _of(live[v], "1") / _of(live[v], "01")).alias(f"q_{v}") for v, c in telling.items()])
    shares = stage(shares.where(" or ".join(f"q_{v} is not null" for v in live)), "shares")

    # Pairs must pass it beyond what both of their words tell.
    some = spread.where((F.col("prev") != ANY) & (F.col("word") != ANY))
    for c in ("word", "prev"):
        some = some.join(broadcast_if_small(shares.select(F.col("word").alias(c), *[F.col(f"q_{v}").alias(f"{c}_{v}") for v in live]), BROADCAST_ROWS), c, "left")
    known = {v: F.greatest(F.coalesce(f"word_{v}", F.lit(0.0)), F.coalesce(f"prev_{v}", F.lit(0.0)), F.lit(text_share[v])) for v in live}
    passed = [(_evidence(_of(f, "1"), _of(f, "0"), F.least(_raised(known[v]), F.lit(1 - 1e-9))) >= strict[v]).alias(f"ok_{v}") for v, f in live.items()]
    some = stage(some.select("prev", "word", *KINDS, *passed).where(" or ".join(f"ok_{v}" for v in live)), "kept_pairs")
    contexts = None if some.isEmpty() else spread.where(F.col("word") == ANY)

    wanted = shares.select("word").union(some.select("word")).distinct()
    words = stage(words.join(broadcast_if_small(wanted, BROADCAST_ROWS), "word").join(shares, "word", "left"), "words")
    models = {v: _model(v, words, contexts, some if contexts is not None else None, total[v], pair_share[v]) for v in live}

    held = [(_contrast(rows.where(f"fold = {fold}"), models[v]), v) for v, fold in (("b", 0), ("a", 1)) if v in models]
    if held:
        scored = held[0][0] if len(held) == 1 else held[0][0].unionByName(held[1][0])
        bins = scored.groupBy(F.greatest(F.least(F.floor(F.col("_x") * 1000), F.lit(9999)), F.lit(-9999)).alias("bin"), "toxic").count().toPandas()
        weight = _logistic((bins["bin"].to_numpy(float) + 0.5) / 1000, bins["toxic"].to_numpy(), bins["count"].to_numpy())
    else:
        weight = (1.0, 0.0)
    return replace(models["all"], weight=weight, totals=total)


def _model(v: str, words: DataFrame, contexts: DataFrame | None, some: DataFrame | None, total: dict, share: float) -> Model:
    """The features of variant ``v`` from exact counts of the words and pairs that may be kept."""
    t, o, s, folds = F.col(f"t_{v}"), F.col(f"o_{v}"), F.col(f"s_{v}"), VARIANTS[v]
    kept = F.col(f"q_{v}").isNotNull() & (_evidence(t, o, _raised(share)) >= WORD_TEST)
    shared = (F.greatest(s - DISCOUNT, F.lit(0.0)) + DISCOUNT * total["v"] / (total["v"] + 1)) / total["s"]
    own = [F.when(kept, F.greatest(n - DISCOUNT, F.lit(0.0)) / total[k]).otherwise(0.0) for n, k in ((t, "t"), (o, "o"))]
    w = words.select("word", kept.alias("kept"), shared.alias("shared"), own[0].alias("own_t"), own[1].alias("own_o"))
    sums = w.agg(F.coalesce(F.sum("own_t"), F.lit(0.0)), F.coalesce(F.sum("own_o"), F.lit(0.0))).first()
    free_t, free_o = (max(1 - x, 1e-6) for x in sums)
    w = w.select("word", "kept", (F.col("own_t") + free_t * F.col("shared")).alias("p_t"), (F.col("own_o") + free_o * F.col("shared")).alias("p_o"))
    base = log(free_t / free_o)
    features = w.where("kept").select(F.lit(ANY).cast("long").alias("prev"), "word", (F.log(F.col("p_t") / F.col("p_o")) - base).alias("value"))
    if some is not None:
        n = some.where(f"ok_{v}").select("prev", "word", *[F.greatest(_of(folds, c) - DISCOUNT, F.lit(0.0)).alias(f"cut_{c}") for c in "10"])
        freed = n.groupBy("prev").agg(F.sum("cut_1").alias("all_1"), F.sum("cut_0").alias("all_0"))
        c = contexts.select("prev", *[F.greatest(_of(folds, c), F.lit(1)).alias(f"c_{c}") for c in "10"]).join(freed, "prev")
        c = stage(c.withColumns({"l_1": 1 - F.col("all_1") / F.col("c_1"), "l_0": 1 - F.col("all_0") / F.col("c_0")}), "backoff")
        after = c.select("prev", F.lit(ANY).cast("long").alias("word"), F.log(F.col("l_1") / F.col("l_0")).alias("value"))
        full = n.join(c, "prev").join(w, "word")
        ratio = F.log((F.col("cut_1") / F.col("c_1") + F.col("l_1") * F.col("p_t")) / (F.col("cut_0") / F.col("c_0") + F.col("l_0") * F.col("p_o")))
        both = full.select("prev", "word", (ratio - F.log(F.col("p_t") / F.col("p_o")) - F.log(F.col("l_1") / F.col("l_0"))).alias("value"))
        features = features.unionByName(after).unionByName(both)
    features = stage(features, "features")
    return Model(features, base, rows=features.count(), words=w)


class _Lookup:
    """The features as sorted arrays: summed values over the words of each text."""

    def __init__(self, features: pd.DataFrame, base: float):
        self.base, self.parts = base, []
        for kind in ("word", "prev", "pair"):
            is_word, is_prev = features["prev"] == ANY, features["word"] == ANY
            part = features[{"word": is_word, "prev": is_prev, "pair": ~is_word & ~is_prev}[kind]]
            if len(part):
                keys = self._keys(kind, part["word"].to_numpy(np.int64), part["prev"].to_numpy(np.int64))
                order = np.argsort(keys)
                self.parts.append((kind, keys[order], part["value"].to_numpy()[order]))

    @staticmethod
    def _keys(kind: str, word: np.ndarray, prev: np.ndarray) -> np.ndarray:
        if kind == "pair":
            return (prev.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ word.view(np.uint64)).view(np.int64)
        return word if kind == "word" else prev

    def __call__(self, texts, hashes: _Hashes) -> np.ndarray:
        word, prev, sizes = _tokens(texts, hashes)
        value = np.zeros(len(word))
        for kind, keys, values in self.parts:
            mine = self._keys(kind, word, prev)
            at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            value += np.where(keys[at] == mine, values[at], 0.0)
        sums = np.bincount(np.repeat(np.arange(len(sizes)), sizes), value, len(sizes))
        return self.base + sums / np.maximum(sizes, 1)


def _emit_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per row its word, context and pair features with their counts and the share of one word."""
    hashes = _Hashes()
    for pdf in batches:
        for part in _portions(pdf, 500_000):
            hashes.trim()
            word, prev, sizes = _tokens(part["text"], hashes)
            row, one = np.repeat(part["_id"].to_numpy(), sizes), np.repeat(1 / np.maximum(sizes, 1), sizes)
            any_ = np.full(len(word), ANY)
            frame = pd.DataFrame({"_id": np.tile(row, 3), "prev": np.concatenate([any_, prev, prev]), "word": np.concatenate([word, any_, word]), "n": np.tile(one, 3)})
            yield frame.groupby(["_id", "prev", "word"], as_index=False)["n"].sum()


def _contrast(docs: DataFrame, model: Model, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with ``_x``, the mean log-likelihood ratio of their words (``model.base`` without words)."""
    if model.features is None:
        return docs.withColumn("_x", F.lit(0.0))
    if model.rows <= bound:
        held = docs.sparkSession.sparkContext.broadcast(_Lookup(model.features.toPandas(), model.base))

        @F.pandas_udf("double")
        def contrast(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            hashes = _Hashes()
            for texts in batches:
                found = [np.zeros(0)]
                for part in _portions(texts.to_frame("text")):
                    found.append(held.value(part["text"], hashes))
                    hashes.trim()
                yield pd.Series(np.concatenate(found), dtype=float)

        return docs.withColumn("_x", contrast("text"))
    # Features too many to broadcast meet the texts' own by shuffle; sums return to the rows by number.
    numbered = stage(docs.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    own = numbered.select("_id", "text").mapInPandas(_emit_features, "_id long, prev long, word long, n double")
    sums = own.join(model.features, ["prev", "word"]).groupBy("_id").agg(F.sum(F.col("n") * F.col("value")).alias("_sum"))
    return numbered.join(sums, "_id", "left").withColumn("_x", model.base + F.coalesce("_sum", F.lit(0.0))).drop("_id", "_sum")


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Weighted two-parameter logistic regression by Newton steps with a small ridge on the slope."""
    if not len(x) or len(set(y)) < 2:
        return (0.0, -3.0 if not len(x) or not y.any() else 3.0)
    mean = np.average(x, weights=n)
    sd = np.sqrt(np.average((x - mean) ** 2, weights=n)) or 1.0
    z, w = np.stack([(x - mean) / sd, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (n * (y - p)) - np.array([1e-2, 0]) * w
        hess = (z * (n * p * (1 - p))[:, None]).T @ z + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        w += step
        if np.abs(step).max() < 1e-9:
            break
    slope = max(w[0] / sd, 0.0)
    return float(slope), float(w[1] - slope * mean)


def score(docs: DataFrame, model: Model, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``THRESHOLD`` on, ties included).

    Null, empty and wordless texts get the score of a text without telling words. Whole texts are read, in portions; repeated rows score
    alike. Columns of those names already there are replaced, others (none may be named _x or _id) stay. One narrow pass without a shuffle while the features
    number ``bound`` at most.
    """
    a, b = model.weight
    logit = F.greatest(F.least(a * F.col("_x") + b, F.lit(30.0)), F.lit(-30.0))
    out = _contrast(docs.drop("score", "predicted"), model, bound).withColumn("score", 1 / (1 + F.exp(-logit))).drop("_x")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the labelled rows that are not held out; null labels and ids train nothing.

    Labels (a number and a mark each) are broadcast up to ``BROADCAST_ROWS`` rows, so that texts stay where they are.
    """
    marks = labels.where(~held_out() & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    rows = docs.where(~held_out()).select("doc_id", "text")
    if marks.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(marks), "doc_id").select("text", "toxic")
    # Beyond that bound texts move to their labels: once, as the fit reads the rows several times.
    return stage(rows.join(marks, "doc_id").select("text", "toxic"), "training")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(training_rows(docs, table(spark, sf_dir, "labels")))
    return score(docs.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "score", "predicted")
