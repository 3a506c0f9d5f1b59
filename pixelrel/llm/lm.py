"""Language-model scores from three-word counts in a sharded n-gram trie of Elias-Fano levels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table
from .eliasfano import EliasFano, mapped

#: Weight of the next shorter context, in words: p(w | context) = (count + weight * p(w | shorter)) / (context's count + weight).
#: Chosen on a fifth of the training rows at sf0.1, learning from the rest.
WEIGHT2, WEIGHT3 = 3000.0, 5.0
#: Texts a task counts at a time, in characters; words and n-grams a shard holds, about.
PORTION, SHARD_WORDS, SHARD_GRAMS = 8_000_000, 2_000_000, 1_000_000
#: Probabilities are held as 12-bit steps of log10 from -20 up, 0 standing for none: half a step is 0.0024.
CODES, LOWEST = 4096, -20.0
STEP = -LOWEST / (CODES - 2)
#: Bits of a pair's hash within its shard. A shard keeps its size as the corpus grows, so two of its million pairs share them as rarely then: one in a million.
PAIR_BITS = 40
#: Bits of a word's fingerprint after a pair: an unseen word is taken for one of n followers with a chance of n / 2^24, and gains that one's small share then.
MARK_BITS = 24
U = np.uint64
END, START, NONE = U(1), U(2), 0
CHUNKS = "chunk long, doc_id array<long>, held array<boolean>, sizes array<int>, words binary, tokens binary, n_words long, n_tokens long, n_train long, n_docs long"
ANSWER = "chunk long, kind int, shard long, payload binary"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays side by side, their bytes by place so that high zero bytes vanish in compression."""
    import zstandard

    body = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() if len(a) else b"" for a in arrays)
    head = np.array([len(arrays), *[x for a in arrays for x in (a.itemsize, len(a))]], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + body)


def _unpack(payload: bytes) -> list[np.ndarray]:
    import zstandard

    body = zstandard.ZstdDecompressor().decompress(payload)
    n = int(np.frombuffer(body, np.int64, 1)[0])
    head, at, out = np.frombuffer(body, np.int64, 2 * n, 8).tolist(), 8 + 16 * n, []
    for size, count in zip(head[::2], head[1::2]):
        planes = np.frombuffer(body, np.uint8, size * count, at).reshape(size, count)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"u{size}"))
        at += size * count
    return out


def _steps(rising: np.ndarray) -> np.ndarray:
    """A sorted array as the steps between its values, which are small."""
    return np.diff(rising, prepend=U(0))


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the place of each of ``x`` among them. Merging, as ``x`` is made of sorted runs."""
    order = np.argsort(x, kind="stable")
    dealt = x[order]
    new = np.ones(len(x), bool)
    new[1:] = dealt[1:] != dealt[:-1]
    of = np.empty(len(x), np.int64)
    of[order] = np.cumsum(new) - 1
    return dealt[new], of


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def _code(p: np.ndarray) -> np.ndarray:
    """Steps of log10 of ``p``, at most 1; 0 where p is 0."""
    with np.errstate(divide="ignore"):
        at = np.rint((np.log10(p) - LOWEST) / STEP) + 1
    return np.where(p > 0, np.clip(at, 1, CODES - 1), 0).astype(np.uint16)


_VALUES = np.concatenate([[0.0], 10 ** (LOWEST + STEP * np.arange(CODES - 1))])


class _Index(dict):
    """A number for each word, in the order they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def words_of(text: str | None) -> list[bytes]:
    """Words between white space, A to Z in lower case: on UTF-8 bytes both touch ASCII alone."""
    return text.encode().lower().split() if text else []


def _tokenize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each portion of texts: its documents, the hashes of its words and all tokens as places among them."""
    import xxhash

    chunk = TaskContext.get().partitionId() << 32
    for pdf in batches:
        upto = pdf["text"].str.len().fillna(0).cumsum().to_numpy()
        for _, part in pdf.groupby(upto // PORTION, sort=True):
            index, found, sizes = _Index(), [], []
            for text in part["text"]:
                ids = list(map(index.__getitem__, words_of(text)))
                found.append(np.array(ids, np.uint32))
                sizes.append(len(ids) + 1)
            # The end of a text is a word of its own. Words are numbered by falling frequency, so that most tokens are small numbers.
            end, hashes = len(index), np.append(np.fromiter(map(xxhash.xxh64_intdigest, index), U, len(index)), END)
            tokens = np.concatenate([x for ids in found for x in (ids, [end])]).astype(np.int64)
            order = np.argsort(-np.bincount(tokens, minlength=len(hashes)), kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            tokens = place[tokens]
            sizes, held = np.array(sizes), part["held"].to_numpy()
            yield pd.DataFrame({
                "chunk": [chunk], "doc_id": [part["doc_id"].astype(object).where(part["doc_id"].notna(), None).tolist()], "held": [held.tolist()], "sizes": [sizes.tolist()], "words": [_pack(hashes[order])],
                "tokens": [_pack(tokens)], "n_words": [len(order)], "n_tokens": [len(tokens)], "n_train": [int(sizes[~held].sum())], "n_docs": [int((~held).sum())],
            })
            chunk += 1


class _Portion:
    """Words and three-word grams of one row of ``_tokenize``, the same whenever they are taken.

    A pair of neighbouring words is a hash, which also tells its shard; the word after it a fingerprint within that pair.
    """

    def __init__(self, row, shards: int):
        self.words, = _unpack(row["words"])
        tokens, = _unpack(row["tokens"])
        self.tokens, self.sizes, self.held = tokens.astype(np.int64), np.asarray(row["sizes"], np.int64), np.asarray(row["held"], bool)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.train, self.shards = np.repeat(~self.held, self.sizes), shards

    def word_blocks(self, shards: int) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, its words' places by their hash)."""
        order = np.argsort(self.words)
        shard = (self.words[order] % U(shards)).astype(np.int64)
        dealt = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[dealt], prepend=-1))
        for at in np.split(order[dealt], cuts[1:]):
            yield int(self.words[at[0]] % U(shards)), at

    def grams(self) -> None:
        """Distinct pairs as shard and hash in one number, so sorted by shard; distinct grams by (pair, fingerprint), so too; and the gram at each token."""
        left, right = _mix(self.words), _mix(self.words ^ U(0x2545F4914F6CDD1D))
        prev = np.empty(len(self.tokens), U)
        prev[1:] = left[self.tokens[:-1]]
        prev[self.first] = _mix(np.array([START]))[0]
        pair = _mix(prev + self.words[self.tokens])
        del prev
        self.pairs, of = np.unique((pair % U(self.shards)) << U(PAIR_BITS) | pair >> U(64 - PAIR_BITS), return_inverse=True)
        del pair
        keys = of.astype(U) << U(32)
        del of
        keys[:-1] |= np.maximum(right >> U(64 - MARK_BITS), U(1))[self.tokens[1:]]
        ends = self.first + self.sizes - 1
        keys[ends] = keys[ends] >> U(32) << U(32) | U(NONE)
        keys, self.of = np.unique(keys, return_inverse=True)
        self.pair_of, self.mark = (keys >> U(32)).astype(np.int64), (keys & U(0xFFFFFFFF)).astype(np.uint32)
        shard = (self.pairs >> U(PAIR_BITS)).astype(np.int64)
        cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        at = np.searchsorted(self.pair_of, cuts)
        #: (shard, its first and last pair, its first and last gram)
        self.blocks = list(zip(shard[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(shard)], at.tolist(), [*at[1:].tolist(), len(keys)]))


def _send_words(shards: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                p, out = _Portion(row, shards), []
                counts = np.bincount(p.tokens[p.train], minlength=len(p.words)).astype(np.uint32)
                for shard, at in p.word_blocks(shards):
                    out.append((row["chunk"], 0, shard, _pack(_steps(p.words[at]), counts[at])))
                yield pd.DataFrame(out, columns=["chunk", "kind", "shard", "payload"])

    return run


def _count_words(pdf: pd.DataFrame) -> pd.DataFrame:
    """Counts of a shard's words, for every portion that asks; the row of chunk -1 has the number of distinct words learnt."""
    asked = [(np.cumsum(w), c) for w, c in map(_unpack, pdf["payload"])]
    words, of = _distinct(np.concatenate([w for w, _ in asked]))
    counts = np.bincount(of, np.concatenate([c for _, c in asked]), len(words)).astype(np.uint64)
    answers = np.split(counts[of], np.cumsum([len(w) for w, _ in asked])[:-1])
    known = [(-1, 0, int(np.count_nonzero(counts)), b"")]
    return pd.DataFrame([*zip(pdf["chunk"], pdf["kind"], pdf["shard"], map(_pack, answers)), *known], columns=["chunk", "kind", "shard", "payload"])


def _send_grams(shards: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                p, out = _Portion(row, shards), []
                p.grams()
                counts = np.bincount(p.of, p.train, len(p.pair_of)).astype(np.uint32)
                for shard, lo, hi, first, last in p.blocks:
                    n = np.bincount(p.pair_of[first:last] - lo, minlength=hi - lo).astype(np.uint32)
                    out.append((row["chunk"], 1, shard, _pack(_steps(p.pairs[lo:hi] & U((1 << PAIR_BITS) - 1)), n, p.mark[first:last], counts[first:last])))
                yield pd.DataFrame(out, columns=["chunk", "kind", "shard", "payload"])

    return run


class Trie:
    """Pairs of words and the words that follow them, with quantised probabilities, each level an Elias-Fano sequence in mapped memory.

    ``pairs`` holds the shard's pairs by their hash, ``starts`` where the followers of each begin, ``after`` the followers' fingerprints, each
    raised by its pair's place so that the whole level rises: a follower is found relative to its context.
    """

    def __init__(self, pairs: np.ndarray, after: np.ndarray, of: np.ndarray, counts: np.ndarray, total: int, universe: int, weight: float = WEIGHT3):
        """``pairs`` sorted; ``after`` and ``counts`` by (``of``, after), ``of`` being the pair's place; ``total`` is the number of words learnt."""
        n = np.bincount(of, counts, len(pairs))
        self.pairs, self.starts = EliasFano(pairs, universe), EliasFano(np.r_[0, np.cumsum(np.bincount(of, minlength=len(pairs)))], len(after) + 1)
        self.after = EliasFano(of.astype(U) << U(MARK_BITS) | after, max(len(pairs), 1) << MARK_BITS)
        self.pair_code = mapped(_code(n / max(total, 1)))
        self.after_code = mapped(_code(counts / (n[of] + weight)))

    def query(self, pairs: np.ndarray, of: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of ``pairs`` (joint probability) and of each word ``after`` the pair at place ``of`` (smoothed share of its context); 0 where unseen."""
        node = self.pairs.find(pairs)
        code = np.zeros(len(pairs), np.uint16)
        code[node >= 0] = self.pair_code[node[node >= 0]]
        out = np.zeros(len(after), np.uint16)
        at = np.flatnonzero(node[of] >= 0)
        context = node[of[at]]
        want = context.astype(U) << U(MARK_BITS) | after[at]
        found = self.after.successor(want)
        # The successor counts only within the context's own stretch and where it is the word itself.
        same = found < self.starts.get(context + 1).astype(np.int64)
        same[same] = self.after.get(found[same]) == want[same]
        out[at[same]] = self.after_code[found[same]]
        return code, out


def _answer_grams(total: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = [_unpack(x) for x in pdf["payload"]]
        sizes = np.array([len(a[0]) for a in asked])
        pairs, of = _distinct(np.concatenate([np.cumsum(a[0]) for a in asked]))
        gram_pair = np.repeat(of, np.concatenate([a[1] for a in asked]).astype(np.int64))
        keys, gram = _distinct(gram_pair.astype(U) << U(32) | np.concatenate([a[2] for a in asked]))
        counts = np.bincount(gram, np.concatenate([a[3] for a in asked]), len(keys))
        after, node = keys & U(0xFFFFFFFF), (keys >> U(32)).astype(np.int64)
        seen = counts > 0
        place = np.cumsum(np.bincount(node[seen], minlength=len(pairs)) > 0) - 1
        live = np.bincount(node[seen], minlength=len(pairs)) > 0
        trie = Trie(pairs[live], after[seen], place[node[seen]], counts[seen], total, 1 << PAIR_BITS)
        # Each distinct gram is looked up once, then handed to all who ask.
        code, after_code = trie.query(pairs, node, after)
        ends = np.cumsum([len(a[2]) for a in asked])[:-1]
        answers = zip(np.split(code[of], np.cumsum(sizes)[:-1]), np.split(after_code[gram], ends))
        return pd.DataFrame({"chunk": pdf["chunk"], "kind": pdf["kind"], "shard": pdf["shard"], "payload": [_pack(a, b) for a, b in answers]})

    return run


def _combine(word_shards: int, shards: int, total: int, known: int, docs: int, weights: tuple[float, float]):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0]
        p = _Portion(row, shards)
        p.grams()
        answers = {(k, s): x for k, s, x in zip(right["kind"], right["shard"], right["payload"])}
        counts = np.empty(len(p.words))
        for shard, at in p.word_blocks(word_shards):
            counts[at], = _unpack(answers[0, shard])
        pair_code, after_code = np.zeros(len(p.pairs), np.uint16), np.zeros(len(p.pair_of), np.uint16)
        for shard, lo, hi, first, last in p.blocks:
            pair_code[lo:hi], after_code[first:last] = _unpack(answers[1, shard])
        own = counts[p.tokens]
        single = (own + 0.5) / (total + 0.5 * (known + 1))
        before = np.empty_like(own)
        before[1:] = own[:-1]
        before[p.first] = docs
        of = p.pair_of[p.of]
        joint = _VALUES[pair_code[of]] * total
        prob = (joint + weights[0] * single) / (before + weights[0])
        # The gram at a place tells of the word after it: a text's first word has no two words before it.
        inner = np.ones(len(own), bool)
        inner[p.first] = False
        at = np.flatnonzero(inner)
        prob[at] = _VALUES[after_code[p.of[at - 1]]] + weights[1] / (joint[at - 1] + weights[1]) * prob[at]
        sums = lambda x: np.add.reduceat(x, p.first)
        return pd.DataFrame({
            "doc_id": pd.array(row["doc_id"], "Int64"), "held_out": p.held, "n_tokens": p.sizes, "n_known": sums((own > 0).astype(np.int64)), "train_tokens": total,
            "base_score": sums(np.log10(single)), "score": sums(np.log10(np.minimum(prob, 1.0))),
        })

    return run


def lm_scores(docs: DataFrame, held: Column, weights: tuple[float, float] = (WEIGHT2, WEIGHT3)) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Rows where ``held`` holds are scored, not learnt.

    Words are counted with their one and two words before; a word's probability rests on the longest context, each context lending ``weights`` words to the
    next shorter one, down to counts plus a half over all words and one unknown: each distribution sums to 1 but for the rounding of stored probabilities (0.0024 in log10).

    The trie is sharded by pairs of words over the cluster, so that no machine holds it whole and a common word spreads over shards. Portions of texts send each shard
    their distinct words (or grams) with counts, compressed; a shard sums them, builds its levels, looks each up and sends back codes, which the portion's texts put together. Shards
    follow the corpus: one for a million tokens. Words are known by 64-bit hashes (two of V share one with a chance of V * V / 2^65), pairs by
    their shard and 40 bits, the words after a pair by 24 bits.

    Null and empty texts have one token, the end. Repeated rows count and score each for itself. Null ids stay and are held out as ``held`` says (null: learnt); ids are cast to
    long; other columns are ignored. Without training rows each token is the unknown word, of probability 1. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held, F.lit(False)).alias("held"))
    chunks = stage(rows.mapInPandas(_tokenize, CHUNKS), "tokens")
    n_words, n_tokens, total, n_docs = (x or 0 for x in chunks.agg(*[F.sum(c) for c in ("n_words", "n_tokens", "n_train", "n_docs")]).first())
    word_shards, shards = (max(1, -(-n // most)) for n, most in ((n_words, SHARD_WORDS), (n_tokens, SHARD_GRAMS)))
    shards = min(shards, 1 << (64 - PAIR_BITS))
    counted = chunks.mapInPandas(_send_words(word_shards), ANSWER).groupBy("shard").applyInPandas(_count_words, ANSWER)
    counted = stage(counted, "words")
    known = counted.where("chunk < 0").agg(F.sum("shard")).first()[0] or 0
    grams = chunks.mapInPandas(_send_grams(shards), ANSWER).groupBy("shard").applyInPandas(_answer_grams(total), ANSWER)
    answers = counted.where("chunk >= 0").unionByName(grams).groupBy("chunk")
    scored = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    asking = chunks.select("chunk", "doc_id", "held", "sizes", "words", "tokens").groupBy("chunk")
    return asking.cogroup(answers).applyInPandas(_combine(word_shards, shards, total, known, n_docs, weights), scored)


def fold(doc_id: Column, folds: int) -> Column:
    """CRC-32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_scores(docs, fold(F.col("doc_id"), 5) == 1)
