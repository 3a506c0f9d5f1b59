"""Links of vectors and of tool calls against brute force, where ties and uneven shapes matter."""

import json
import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from pixelrel.llm import chat, embeddings


def brute_links(vectors, threshold=0.95):
    n, parent = [0] * len(vectors), list(range(len(vectors)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(vectors):
        for j in range(i):
            b = vectors[j]
            if len(a) == len(b) and np.linalg.norm(a) and np.linalg.norm(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                n[i] += 1
                n[j] += 1
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(i, n[i], find(i)) for i in range(len(vectors))]


def narrow_pairs(count, lead=16, dim=64, seed=0):
    """Pairs a little above the threshold, nearly all of whose weight lies in the leading components."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(count):
        a = rng.normal(size=lead)
        a /= np.linalg.norm(a)
        b = rng.normal(size=lead)
        b -= a * (a @ b)
        b /= np.linalg.norm(b)
        c = rng.uniform(0.95 + 1e-8, 0.95 + 2e-5)
        tail = rng.normal(size=dim - lead)
        tail *= rng.uniform(1e-5, 3e-3) / np.linalg.norm(tail)
        for lead_part in (a, c * a + np.sqrt(1 - c * c) * b):
            out.append(np.concatenate([lead_part, tail]))
    return np.array(out)


@pytest.mark.parametrize("turned", [False, True])
def test_steps_lose_no_pair_whose_weight_leads(turned):
    x = narrow_pairs(1500)
    axes = np.linalg.qr(np.random.default_rng(1).normal(size=(64, 64)))[0] if turned else None
    x = x @ axes.T if turned else x
    left, right = (pd.DataFrame({"embedding": list(part)}) for part in (x[::2], x[1::2]))
    found = {(i, j) for p, q in embeddings._compare(left, right, False, axes, 0.95) for i, j in zip(p.tolist(), q.tolist())}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(unit[::2] @ unit[1::2].T >= 0.95 + 1e-12))}
    assert want <= found and len(want) >= 1500


def test_vectors_with_negated_tails(spark):
    x = narrow_pairs(120, seed=4)
    x = np.concatenate([x, x * np.where(np.arange(64) < 16, 1, -1)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), tile=150).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute_links(x)


def test_any_vector_lengths(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "AXES_SAMPLE", 5)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 8))
    x = [base[i % 30] + 0.1 * rng.normal(size=8) for i in range(200)] + [np.array([1.0, 2, 3]), np.array([1.0, 2, 3.1]), np.array([5.0]), np.array([2.0]), np.array([-2.0]), np.zeros(3)] + [rng.normal(size=1100)] * 2
    for tile in (8192, 20):
        got = embeddings.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3), tile=tile).collect()
        assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute_links(x)


def brute_tools(rows):
    """Figures of every message from its whole conversation."""
    calls_of = defaultdict(list)
    for c, turn, _, text in rows:
        for call in chat.parse(text)["calls"]:
            calls_of[c, call["id"]].append((turn is None, turn or 0, call["deps"]))
    first = {k: min(v) for k, v in calls_of.items() if k[0] is not None}
    level = {}
    while True:
        more = {k: max((level[k[0], d] + 1 for d in deps), default=0) for k, (*_, deps) in first.items() if k not in level and all((k[0], d) in level for d in deps)}
        if not more:
            break
        level |= more
    last = defaultdict(lambda: None)
    for c, turn, _, text in rows:
        answer = chat.parse(text)["result_id"]
        if answer is not None and turn is not None:
            last[c, answer] = max(turn, last[c, answer] if last[c, answer] is not None else turn)
    for c, turn, role, text in rows:
        p = chat.parse(text)
        ids = sorted({x["id"] for x in p["calls"] if (c, x["id"]) in first}, key=lambda i: (level.get((c, i), 2**62), i))
        answered = sum(turn is not None and last[c, i] is not None and last[c, i] > turn for i in ids)
        levels = [level[c, i] for i in ids if (c, i) in level]
        link, own = None, max(levels, default=None)
        if p["result_id"] is not None:
            made = first.get((c, p["result_id"]))
            link = "orphan" if made is None or made[0] else "linked" if turn is not None and made[1] < turn else "early"
            own = own if own is not None else level.get((c, p["result_id"]))
        yield (c, turn, len(p["calls"]), answered, p["unlinkable"], link, own, ",".join(ids))


def test_tool_links_of_random_conversations(spark):
    rng, rows = random.Random(7), []
    call = lambda: {"id": rng.choice("abcdefg"), "name": "search", "arguments": {"query": "x"}, "depends_on": rng.sample("abcdefgz", rng.choice([0, 0, 1, 2]))}
    for c in [*range(25), None]:
        for _ in range(rng.randint(1, 12)):
            turn = rng.choice([0, 1, 1, 2, 3, 4, None] if c is not None and c % 5 == 0 else [0, 1, 1, 2, 2, 3, 4])
            kind = rng.random()
            if kind < 0.45:
                text = json.dumps({"tool_calls": [call() for _ in range(rng.randint(1, 3))] + ([{"name": "search"}] if kind < 0.05 else [])})
            elif kind < 0.8:
                text = json.dumps({"tool_call_id": rng.choice("abcdefgh"), "content": "y"})
            else:
                text = rng.choice(["plain", "", None, "{broken"])
            rows.append((c, turn, "assistant", text))
    rows += rows[:10]
    # Two messages of one turn with a call each.
    rows += [(99, 0, "assistant", json.dumps({"tool_calls": [{"id": i, "name": "search", "arguments": {"query": "x"}}]})) for i in "ab"] + [(99, 1, "tool", json.dumps({"tool_call_id": "a"}))]
    frame = spark.createDataFrame([(*r, 1, "n") for r in rows], "conv_id long, turn long, role string, text string, message_no int, level string").repartition(4)
    got = chat.link_tools(frame).collect()
    names = ["conv_id", "turn", "n_calls", "n_answered", "n_unlinkable", "link", "level", "call_order"]
    assert sorted(str(tuple(r[c] for c in names)) for r in got) == sorted(map(str, brute_tools(rows)))
    assert sorted((r["n_answered"], r["call_order"]) for r in got if r["conv_id"] == 99 and r["n_calls"]) == [(0, "b"), (1, "a")]


def test_filters_of_few_rows_in_many_blocks_stay_small():
    from pixelrel.llm import dedup

    rng = np.random.default_rng(3)
    fps = np.concatenate([rng.integers(-2**63, 2**63, 3000), np.zeros(500, np.int64)])
    made = pd.concat(dedup._builder(10)([pd.DataFrame({"fp": fps})]))
    # A dozen bytes a slot and some for each block, not a map of 512 bytes for each.
    assert sum(len(o) for o in made["occupied"]) <= 2 * 3001
    again = pd.concat(dedup._builder(10)([pd.DataFrame({"fp": fps[:1000]})]))
    counts = {}
    for _, block in pd.concat([made, again]).groupby("block"):
        row = dedup._merge(block).iloc[0]
        top = (row["block"] << dedup.QUOTIENT_BITS) | dedup._quotients(row["occupied"], row["run_ends"], len(row["counts"]))
        for t, r, n in zip(top.tolist(), row["remainders"].tolist(), row["counts"].tolist()):
            counts[t << 42 | r] = n
    want, n = np.unique(np.concatenate([fps, fps[:1000]]).astype(np.int64).view(np.uint64), return_counts=True)
    assert counts == dict(zip(want.tolist(), n.tolist()))


def test_revisits_at_timestamps_and_ties(spark):
    from pyspark.sql import functions as F

    from pixelrel.llm import warc

    rng, recs = random.Random(2), []
    for i in range(400):
        recs.append((i, rng.choice(["response", "revisit"]), rng.choice(["http://hot.example/"] * 5 + ["http://b.example/x"]), rng.choice([1, 1, 1, 2, 5, None]), None, None, None))
    frame = spark.createDataFrame(recs, "record_id long, kind string, url string, at long, etag string, last_modified string, headers map<string,string>")
    want = {}
    for i, kind, url, at, *_ in recs:
        if kind == "revisit":
            before = [(a, j) for j, k, u, a, *_ in recs if k == "response" and u == url and a is not None and at is not None and (a, j) < (at, i)]
            want[i] = max(before)[1] if before else None
    for one in (frame, frame.withColumn("at", F.timestamp_seconds("at"))):
        for slices in (None, 3):
            assert {r["record_id"]: r["resolved_id"] for r in warc.resolve_revisits(one, slices).collect()} == want


@pytest.mark.parametrize("key_rows", [5, 20_000])
def test_fingerprints_under_one_key_in_tiles(spark, monkeypatch, key_rows):
    from pyspark.sql import functions as F

    from pixelrel.llm import simhash

    rng = random.Random(11)
    prints = [rng.getrandbits(64) & ~0xFFFFFF for _ in range(4)]
    # Many prints a few low bits apart share their upper segments, and so a key.
    fps = sorted({p ^ sum(1 << b for b in rng.sample(range(14), rng.randint(0, 9))) for p in prints for _ in range(40)})
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, shingle: docs.select("doc_id", F.col("text").cast("long").alias("fp")))
    signed = [p - (1 << 64) if p >> 63 else p for p in fps]
    frame = spark.createDataFrame([(i, str(p)) for i, p in enumerate(signed)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(frame, key_rows=key_rows).collect()}
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, p in enumerate(fps):
        for j in range(i):
            if (p ^ fps[j]).bit_count() <= 4:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in range(len(fps))}
