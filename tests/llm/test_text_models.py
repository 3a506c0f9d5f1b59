"""Language-model scores, tokenizer alignment and the trie of conversations against brute force, with the cases that tables may hold."""

import hashlib
import math
import random
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelrel.llm import alignment, lm, trie
from pixelrel.llm.eliasfano import EliasFano

DOCS = "doc_id long, text string, row string, chunk int, held string, pair int"
ODD = [
    None, "", " ", "\n", "one two three", "one two three", "ONE\ttwo\x0bthree\r\nÄÖ É", "a\n\n\nb  c \n d ", "tab\tx  y", "a▁b", "<|endoftext|> </s> <s> <0x41>", "日本語 é　z 𝄞",
    "word " * 4000, "x" * 700 + " " + "y" * 300, "don't  it's 12 345\n\n", "\x85odd\x1cspaces\xa0here", "null\0byte",
]


def documents(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "r", 1, "h", None) for i, t in zip(ids or range(len(texts)), texts)], DOCS).repartition(3)


@pytest.mark.parametrize("n, universe", [(0, 10), (1, 1), (1, 2**64), (5, 5), (1000, 900), (3000, 2**63), (400, 2**40)])
def test_elias_fano_is_exact(n, universe):
    rng = np.random.default_rng(n)
    top = min(universe, 2**63)
    values = np.sort(rng.integers(0, top, n, dtype=np.uint64))
    held = EliasFano(values, universe)
    asked = np.concatenate([values, values + np.uint64(1), rng.integers(0, top, 300, dtype=np.uint64)])
    assert (held.get(np.arange(n)) == values).all()
    assert (held.successor(asked) == np.searchsorted(values, asked)).all()
    assert ((held.find(asked) >= 0) == np.isin(asked, values)).all()


def brute_scores(rows, held):
    words = [((t or "").encode().lower().split() + [None], h) for (_, t), h in zip(rows, held)]
    one, two, three = Counter(), Counter(), Counter()
    for w, h in words:
        if not h:
            one.update(w)
            two.update(zip([0, *w], w))
            three.update(zip([0, *w], w, w[1:]))
    n, v, d = sum(one.values()), len(one), sum(not h for h in held)
    for w, _ in words:
        before, base, score = [0, *w], 0.0, 0.0
        for k, x in enumerate(w):
            p = (one[x] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            p = (two[before[k], x] + lm.WEIGHT2 * p) / ((one[w[k - 1]] if k else d) + lm.WEIGHT2)
            if k:
                p = (three[before[k - 1], w[k - 1], x] + lm.WEIGHT3 * p) / (two[before[k - 1], w[k - 1]] + lm.WEIGHT3)
            score += math.log10(p)
        yield len(w), sum(one[x] > 0 for x in w), n, base, score


def test_scores_are_those_of_plain_counts(spark, monkeypatch):
    rng = random.Random(1)
    texts = ODD + [" ".join(rng.choice("the of a in red blue sky".split()) for _ in range(rng.randint(1, 60))) for _ in range(80)]
    ids = [*range(len(texts) - 1), None]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i in ids]
    for words, grams, portion in ((2_000_000, 1_000_000, 8_000_000), (10, 40, 500)):
        monkeypatch.setattr(lm, "SHARD_WORDS", words), monkeypatch.setattr(lm, "SHARD_GRAMS", grams), monkeypatch.setattr(lm, "PORTION", portion)
        got = lm.lm_scores(documents(spark, texts, ids), lm.fold(F.col("doc_id"), 5) == 1).collect()
        assert len(got) == len(texts)
        found = {r["doc_id"]: r for r in got}
        for i, h, (n_tokens, n_known, total, base, score) in zip(ids, held, brute_scores(list(zip(ids, texts)), held)):
            r = found[i]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, n_tokens, n_known, total)
            assert abs(r["base_score"] - base) < 1e-9 * n_tokens and abs(r["score"] - score) < 0.005 * n_tokens


def test_scores_without_training_rows_or_rows(spark):
    got = lm.lm_scores(documents(spark, ["a b", None]), F.lit(True)).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got) == [(1, 0, 0, 0.0, 0.0), (3, 0, 0, 0.0, 0.0)]
    assert lm.lm_scores(documents(spark, ["a"]).where("false"), F.lit(False)).count() == 0


def test_probabilities_after_a_context_sum_to_one():
    pairs, of = np.array([5, 9, 70], np.uint64), np.array([0, 0, 1, 1, 1, 2])
    after, counts = np.array([3, 8, 1, 4, 9, 2], np.uint64), np.array([4, 1, 2, 2, 6, 1])
    held = lm.Trie(pairs, after, of, counts, 16, 100, 5.0)
    code, follow = held.query(np.array([5, 9, 33], np.uint64), np.array([0, 0, 0, 1, 2]), np.array([3, 8, 9, 9, 3], np.uint64))
    assert np.allclose(lm._VALUES[code], [5 / 16, 10 / 16, 0], rtol=6e-3)
    assert np.allclose(lm._VALUES[follow], [4 / 10, 1 / 10, 0, 6 / 15, 0], rtol=6e-3)
    # What the context's own followers leave is the weight of the shorter context.
    assert abs(lm._VALUES[follow[:2]].sum() + 5 / (5 + 5) - 1) < 1e-2


def brute_alignment(texts):
    own = alignment.Aligner(*alignment.default_tokenizers())
    spread = lambda parts: list(zip(np.cumsum([0, *map(len, parts)])[:-1].tolist(), np.cumsum(list(map(len, parts))).tolist()))
    out, count = [], Counter()
    for t in texts:
        a = own.a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = own.b.encode(t) if t else []
        if not t or any(b"".join(p) != (" " + t).encode() for p in ([own.a_bytes[i] for i in a], [own.b_bytes[i] for i in b])):
            out.append(None)
            continue
        ar, br = spread([own.a_bytes[i] for i in a]), spread([own.b_bytes[i] for i in b])
        starts, ends = [x[0] for x in br], [x[1] for x in br]
        links = Counter((a[i], b[j]) for i, (lo, hi) in enumerate(ar) for j in range(bisect_right(ends, lo), bisect_left(starts, hi)))
        cuts, said, i, j = sorted({x[1] for x in ar} & {x[1] for x in br}), [], 0, 0
        for cut in cuts:
            i2, j2 = i, j
            while i2 < len(ar) and ar[i2][1] <= cut:
                i2 += 1
            while j2 < len(br) and br[j2][1] <= cut:
                j2 += 1
            said.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            i, j = i2, j2
        count.update(links.keys())
        out.append((len(a), len(b), len(cuts), links, hashlib.sha256(";".join(said).encode()).hexdigest()))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    for found in out:
        if found is None:
            yield (0, 0, 0, 0, 0, 0, "")
        else:
            n_a, n_b, groups, links, sha = found
            yield (n_a, n_b, groups, sum(links.values()), sum(n for p, n in links.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in links.items()), sha)


@pytest.mark.parametrize("bound", [2_000_000, 3])
def test_alignment_is_that_of_all_overlaps(spark, bound):
    texts = ODD + ["Anorstion therethe ingly,, (und) überhaupt " * k for k in (1, 2, 2)]
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.align(documents(spark, texts), bound=bound).collect()}
    for i, want in enumerate(brute_alignment(texts)):
        assert got[i] == want, texts[i]
    assert got[ODD.index("a▁b")] == (0, 0, 0, 0, 0, 0, "") and alignment.align(documents(spark, ["x"]).where("false")).count() == 0


def test_segments_align_as_whole_texts():
    own, rng = alignment.Aligner(*alignment.default_tokenizers(), bound=40), random.Random(3)
    texts = ["".join(rng.choice([" ", "  ", "\n", "the", "'s", "Ünd", "1", ",.", "\t", "é", "ing"]) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    for at in range(0, 400, 50):
        assert list(own(texts[at:at + 50])) == [own._whole(t) for t in texts[at:at + 50]]


def brute_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            sha = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns[c].append((turn is not None, turn or 0, sha, (role, text)))
    turns = {c: [t[3] for t in sorted(v, key=lambda t: t[:3])] for c, v in turns.items()}
    full = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = tuple(turns.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:])
    members = defaultdict(list)
    for c, seq in full.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(full[c]) == len(p))
        yield (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest())


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "n", 1, None) for r in rows], "conv_id long, turn long, role string, text string, n string, depth int, digest binary").repartition(3)


def order(rows):
    return sorted(rows, key=str)


def test_trie_of_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 4)
    rng, rows = random.Random(5), []
    for c in [*range(0, 60), 100, 107, 230, 231, 340, -1, -105, -200]:
        for turn in range(rng.randint(1, 9)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["hi", "yes", "é𝄞"])))
    rows += [(3, None, None, None), (3, None, "", ""), (3, 1, "user", "hi"), (3, 1, "user", "hi"), (4, 2, "us", "erhi"), (None, 0, "user", "nobody's")]
    # One conversation holds most turns, and many copies are equal.
    rows += [(5, 100 + k, "user", str(k % 3)) for k in range(300)] + [(c, 0, "user", "same") for c in range(1000, 1080)]
    got = trie.prefix_trie(conversations(spark, rows)).collect()
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert order(tuple(r[c] for c in names) for r in got) == order(brute_trie(rows))


def test_trie_of_few_or_no_conversations(spark):
    rows = [(100, 0, "user", "a")]
    assert order(map(tuple, trie.prefix_trie(conversations(spark, rows)).collect())) == order(brute_trie(rows))
    # A conversation may be left without turns: its block has no first conversation, and its own turns are fewer than those taken.
    lone = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 1)
    got = trie.prefix_trie(conversations(spark, [(lone, 0, "user", "a")])).collect()
    assert [(r["depth"], r["n_convs"], r["n_leaves"], r["saved_tokens"]) for r in got] == [(0, 1, 1, 0)]
    assert trie.prefix_trie(conversations(spark, rows).where("false")).count() == 0
