"""Alignment of two tokenizers' tokens over the same bytes, with corpus-wide counts of linked pairs."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, forest, stage, table

#: Pair counts are broadcast up to this many pairs (some 100 MB), else joined by shuffle.
BROADCAST_PAIRS = 2_000_000
#: Distinct pairs a task sums before it hands them on.
HELD_PAIRS = 1_000_000
#: A run of blanks and line feeds with the characters up to the next one: no token of either tokenizer crosses from one into the next.
SEGMENT = re.compile(r"[ \n]+[^ \n]*")
#: Fixed value: how a byte-level tokenizer parts a text before its merges.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters whose kind all versions of Unicode agree on.
COMMON = re.compile(r"[\x00-\u024F]*")
#: Where blanks and line feeds stand alone between characters, segments are found by splitting.
RUNS = re.compile(r"^[ \n]|[ \n][ \n]|[ \n]\Z")
#: Other white space makes runs that a cut before a blank may divide; such texts are encoded whole.
OTHER_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f\x85]")
ALIGNED = "doc_id {id}, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>"


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: visible Latin-1 characters stand for themselves, other bytes for the characters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def link_tokens(a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (i, j) of tokens whose byte ranges overlap, in order, and the component of every token of A, then of B, named by its first token of A.

    Both sides cover the same bytes. Two ranges overlap in one stretch between neighbouring ends of either side, so these stretches are the links; union-find
    over the bipartite graph of the links gives the components.
    """
    a_end, b_end = np.cumsum(a_len), np.cumsum(b_len)
    ends = np.union1d(a_end, b_end)
    i, j = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
    return i, j, forest(i, len(a_len) + j, len(a_len) + len(b_len))


class Aligner:
    """Aligned segments of texts; segments met before are remembered up to a bound."""

    def __init__(self, a_path: str, b_path: str, bound: int = 500_000):
        import regex
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        byte = byte_of_char()
        special = {i: t.content for i, t in self.a.get_added_tokens_decoder().items()}
        self.a_bytes = {i: p.encode() if i in special else bytes(byte[c] for c in p) for p, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # Cutting is safe where no piece holds a line feed, nor a blank after another character.
        self.cuttable = not any("\n" in p or "▁" in p.lstrip("▁") for p in pieces)
        self.a_len, self.b_len = np.zeros(max(self.a_bytes) + 1, np.int64), np.array([len(x) for x in self.b_bytes])
        self.a_len[list(self.a_bytes)] = [len(x) for x in self.a_bytes.values()]
        #: Ids behind ",", ";" (A) and ",", "|" (B): a token that goes on with a group, or begins one or its second side.
        self.said = np.array([f"{sign}{i}" for sign in ",;,|" for i in range(1 << 16)], object)
        if max(self.a_bytes) > 0xFFFF or len(pieces) > 0x10000:
            raise ValueError("ids of both tokenizers fit 16 bits")
        self.findall, self.parts = regex.compile(PARTS).findall if _merges_parts(a_path) else None, {}
        self.char = {b: c for c, b in byte.items()}
        self.blank = pieces.index("▁") if "▁" in pieces else -1
        self.bound, self.seen, self.before = bound, {}, {}

    def _aligned(self, segments: list[str], a_ids: list[list[int]], b_ids: list[list[int]]) -> list[tuple | None]:
        """(tokens of A, of B, groups, their text, linked pairs as 32-bit numbers) of each segment; None where the bytes differ.

        Segments whose bytes both sides cover are aligned as one text: a segment's end is an end of both sides, so no link or component leaves it.
        """
        good, want = [], []
        for k, (segment, a, b) in enumerate(zip(segments, a_ids, b_ids)):
            own = segment.encode()
            if b"".join([self.a_bytes[i] for i in a]) == own and b"".join([self.b_bytes[i] for i in b]) == own:
                good.append(k)
                want.append(len(own))
        out: list[tuple | None] = [None] * len(segments)
        if not good:
            return out
        a, b = (np.fromiter(chain.from_iterable([ids[k] for k in good]), np.int64) for ids in (a_ids, b_ids))
        n_a, n_b = (np.array([len(ids[k]) for k in good]) for ids in (a_ids, b_ids))
        i, j, root = link_tokens(self.a_len[a], self.b_len[b])
        pairs = (a[i] << 16 | b[j]).astype(np.uint32).tobytes()
        # Tokens of a group stand together: those of A, then those of B, each behind the sign that parts it from the one before.
        opens = np.r_[root[:len(a)] == np.arange(len(a)), np.r_[True, np.diff(root[len(a):]) != 0]]
        side = np.r_[np.zeros(len(a), np.int64), np.ones(len(b), np.int64)]
        order = np.argsort(2 * root + side, kind="stable")
        signs = self.said[(2 * side + opens)[order] << 16 | np.r_[a, b][order]].tolist()
        a_to, both_to = np.cumsum(n_a), np.cumsum(n_a + n_b)
        link_to = np.searchsorted(i, a_to)
        groups = np.diff(np.r_[0, np.cumsum(opens[:len(a)])[a_to - 1]])
        lo = at = 0
        for k, x, y, g, to, link in zip(good, n_a.tolist(), n_b.tolist(), groups.tolist(), both_to.tolist(), (4 * link_to).tolist()):
            out[k] = (x, y, g, "".join(signs[lo:to])[1:], pairs[at:link])
            lo, at = to, link
        return out

    def _whole(self, text: str) -> tuple | None:
        return self._aligned([" " + text], [self.a.encode(" " + text, add_special_tokens=False).ids], [self.b.encode(text)])[0]

    def _learn(self, keys: list[str]) -> None:
        """Segments not met yet, all at once. A segment's first blank is the one that B adds; before a line feed the blank added is a token of its own and goes."""
        segments = [k if k[0] in " \n" else " " + k for k in keys]
        plain = [self.findall is not None and COMMON.fullmatch(k) is not None for k in keys]
        rest = iter(self.a.encode_batch_fast([s for s, x in zip(segments, plain) if not x], add_special_tokens=False))
        b_ids = self.b.encode([k[1:] if k[0] == " " else k for k in keys], num_threads=1)
        a_ids = [self._parts(segment) if x else next(rest).ids for segment, x in zip(segments, plain)]
        b_ids = [[self.blank] if key == " " else b[1:] if key[0] == "\n" and b[:1] == [self.blank] else b for key, b in zip(keys, b_ids)]
        self.seen.update(zip(keys, self._aligned(segments, a_ids, b_ids)))
        if len(self.parts) > self.bound // 4:
            self.parts.clear()

    def _parts(self, segment: str) -> list[int]:
        parts = self.findall(segment)
        return self._part(parts[0]) if len(parts) == 1 else [i for part in parts for i in self._part(part)]

    def _part(self, part: str) -> list[int]:
        """Tokens of a part of A's: its merges alone."""
        found = self.parts.get(part)
        if found is None:
            chars = part.encode().decode("latin-1").translate(self.char)
            self.parts[part] = found = [t.id for t in self.a.model.tokenize(chars)]
        return found

    def _keys(self, text: str) -> list[str]:
        """Segments of a blank and ``text``; where a segment starts with a single blank, without it."""
        if not RUNS.search(text):
            return text.replace("\n", " \n").split(" ")
        return [s[1:] if s[0] == " " and s[1:2] not in ("", " ", "\n") else s for s in SEGMENT.findall(" " + text)]

    def __call__(self, texts: list[str]) -> Iterator[tuple | None]:
        """Per text (n_a, n_b, n_groups, groups, pairs), or None without tokens."""
        cut = [self._keys(t) if t and self.cuttable and not OTHER_SPACE.search(t) else None for t in texts]
        seen, before = self.seen, self.before
        new = {k for c in cut if c for k in c if k not in seen}
        for k in [k for k in new if k in before]:
            seen[k] = before[k]
            new.discard(k)
        self._learn(list(new))
        for text, keys in zip(texts, cut):
            found = [seen[k] for k in keys] if keys else [None]
            if None in found:
                yield self._whole(text) if text else None
                continue
            n_a, n_b, n_groups, said, pairs = zip(*found)
            yield sum(n_a), sum(n_b), sum(n_groups), ";".join(said), b"".join(pairs)
        if len(seen) > self.bound // 2:
            self.seen, self.before = {}, seen


def _merges_parts(path: str) -> bool:
    """Whether the tokenizer of this file parts texts by ``PARTS`` and merges bytes inside a part, without more before or after."""
    with open(path, encoding="utf-8") as file:
        plan = json.load(file)
    level, model = plan["pre_tokenizer"] or {}, plan["model"]
    return (level.get("type") == "ByteLevel" and level["use_regex"] and not level["add_prefix_space"] and model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
            and plan["normalizer"] is None and plan["post_processor"] is None and not plan["truncation"] and not plan["padding"])


@lru_cache(maxsize=1)
def _aligner(a_path: str, b_path: str) -> Aligner:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Aligner(a_path, b_path)


def _portions(pdf: pd.DataFrame, chars: int = 500_000) -> Iterator[pd.DataFrame]:
    """Rows in order, about ``chars`` characters at a time."""
    upto = pdf["text"].str.len().fillna(0).cumsum().to_numpy()
    for _, part in pdf.groupby(upto // chars, sort=True):
        yield part


def _align(a_path: str, b_path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        align = _aligner(a_path, b_path)
        for pdf in batches:
            for part in _portions(pdf):
                out = []
                for found in align([t if isinstance(t, str) else "" for t in part["text"]]):
                    if found is None:
                        out.append((0, 0, 0, 0, "", [], []))
                        continue
                    n_a, n_b, n_groups, said, links = found
                    links = np.frombuffer(links, np.uint32)
                    keys, times = np.unique(links, return_counts=True)
                    out.append((n_a, n_b, n_groups, len(links), hashlib.sha256(said.encode()).hexdigest(), keys.view(np.int32), times.astype(np.int32)))
                frame = pd.DataFrame(out, columns=["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
                yield pd.concat([part[["doc_id", "row"]].reset_index(drop=True), frame], axis=1)

    return run


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents that hold each pair, summed within the task up to ``HELD_PAIRS`` pairs at a time."""
    keys, counts = np.empty(0, np.int32), np.empty(0, np.int64)
    for pdf in batches:
        for at in range(0, len(pdf), 512):
            new, n = np.unique(np.concatenate([np.empty(0, np.int32), *pdf["pairs"].iloc[at:at + 512]]), return_counts=True)
            keys, back = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, n]), len(keys)).astype(np.int64)
            if len(keys) > HELD_PAIRS:
                yield pd.DataFrame({"pair": keys, "n": counts})
                keys, counts = np.empty(0, np.int32), np.empty(0, np.int64)
    yield pd.DataFrame({"pair": keys, "n": counts})


def align(docs: DataFrame, tokenizers: tuple[str, str] | None = None, bound: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Tokenizer A reads a blank and the text, B the text, before which it sets a blank itself. Tokens are linked where their bytes overlap; connected
    components of that graph are the groups, the smallest stretches that both sides cut at their ends. Documents that hold a pair are
    counted per task, then summed by a shuffle of pairs; ``n_best`` and ``count_sum`` join those counts to every document's own pairs: by broadcast
    up to ``bound`` pairs, else by shuffle with pairs that most documents hold broadcast.

    Null and empty texts, and those whose token bytes are not a blank and the text (such as texts with U+2581), have no tokens: zeros and an empty hash. Very long texts
    are aligned whole, repeated rows each for itself and counted each; null ids stay; other columns are ignored; an empty table gives an empty result.
    """
    a_path, b_path = tokenizers or default_tokenizers()
    schema = ALIGNED.format(id=docs.schema["doc_id"].dataType.simpleString())
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    aligned = stage(rows.mapInPandas(_align(a_path, b_path), schema), "aligned")
    counts = aligned.select("pairs").mapInPandas(_count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = stage(counts.withColumn("a", F.shiftrightunsigned("pair", 16)), "pairs")
    # One row per id of A at most: a few tens of thousands, as many as its vocabulary has.
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    known = stage(counts.join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "known")
    held = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    if known.limit(bound + 1).count() <= bound:
        linked = held.join(F.broadcast(known), "pair")
    else:
        linked = attach(held, known, "pair", "n", known.agg(F.sum("n")).first()[0])
    times = F.col("times").cast("long")
    sums = linked.groupBy("row").agg(F.sum(F.when(F.col("best"), times).otherwise(0)).alias("n_best"), F.sum(times * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return aligned.drop("pairs", "times").join(sums, "row", "left").select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
