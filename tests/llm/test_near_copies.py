"""Near copies: what a large group of similar texts sends on, and that no candidate pair is lost."""

import numpy as np
import pandas as pd

from pixelrel.llm import simhash

BITS, LEAST = 14, 0.8


def test_groups_below_similarity_send_no_row_a_pair(spark, monkeypatch):
    """500 texts of pairwise similarity 0.70 to 0.79 agree in their sketches but do not link: no table of the stage has a row a pair."""
    rng = np.random.default_rng(2)
    words = [f"w{x}" for x in rng.integers(0, 5000, 400)]
    rows = []
    for i in range(500):
        mine = list(words)
        for at in rng.choice(80, 7, replace=False) * 5 + 2:
            mine[at] = f"own{i}_{at}"
        rows.append((i, " ".join(mine)))
    sizes, kept = {}, simhash.stage

    def counted(df, name):
        out = kept(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(simhash, "stage", counted)
    out = simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string"), shingle=5, bits=BITS, verify=LEAST)
    alike = [simhash.similarity(rows[i][1], rows[j][1], 5) for i, j in zip(range(100), range(100, 200))]
    assert max(alike) < LEAST
    assert out.where("doc_id = component_id").count() == 500
    assert max(sizes.values()) < 40 * 500, sizes


def test_blocks_hold_every_candidate_pair_once():
    """The pairs that blocks find are those with a common key by brute force, also across tiles and batches, each in one block."""
    rng = np.random.default_rng(3)
    n = 500
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    fps = np.array([base[i % 3] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 6, dtype=np.uint64)) for i in range(n)])
    sizes, roots = rng.integers(90, 160, n), rng.integers(0, n, n)
    sketches = rng.integers(0, 256, (3, 64), dtype=np.uint8)[np.arange(n) % 3]
    sketches = np.where(rng.random((n, 64)) < 0.2, rng.integers(0, 256, (n, 64), dtype=np.uint8), sketches)
    minis = sketches[:, :8].copy().view("<i8")[:, 0]
    rows = pd.DataFrame({"fp": fps.view(np.int64), "size": sizes, "node": np.arange(n), "root": roots, "mini": minis})
    minima, floor = 3, 38
    keyed = pd.concat(simhash._emit_segment_keys(LEAST)([rows])).sort_values(["key", "fp", "node"])
    cut = [keyed[at:at + 777] for at in range(0, len(keyed), 777)]
    places = pd.concat(simhash._members(BITS, minima, LEAST)(cut))
    assert list(places.columns) == list(simhash.PLACE)
    # Places that come twice change nothing.
    places = pd.concat([places, places[::7]])
    values = pd.DataFrame({"node": np.arange(n), "fp": fps.view(np.int64), "size": sizes, "sketch": [s.tobytes() for s in sketches]})
    held = places.merge(values, on="node").sort_values(["key", "tile_a", "tile_b"])
    got = []
    for block in simhash._blocks(held[at:at + 555] for at in range(0, len(held), 555)):
        i, j = simhash._open_pairs(block, BITS, minima, LEAST, floor)
        got += zip(np.minimum(block["node"][i], block["node"][j]).tolist(), np.maximum(block["node"][i], block["node"][j]).tolist())
    keys = [set(k[k >= 0].tolist()) for k in simhash.segment_keys(fps, sizes, LEAST)]
    want = set()
    for i in range(n):
        for j in range(i + 1, n):
            same = sketches[i] == sketches[j]
            if roots[i] != roots[j] and int(fps[i] ^ fps[j]).bit_count() <= BITS and same[:8].sum() >= minima and same.sum() >= floor and keys[i] & keys[j]:
                want.add((i, j))
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000


def test_rows_of_a_key_meet_few_tiles(monkeypatch):
    """However many rows a key has, each is sent to KEY_TILES blocks at most, and blocks of many tiles find the pairs that one block finds."""
    rng = np.random.default_rng(4)
    for n in (100, 3_000, 12_000):
        tiles = simhash._tiles(np.repeat(np.int64(20 << 14), n), LEAST)
        assert tiles.max() < simhash.KEY_TILES, (n, tiles.max())
    n, minima, floor = 400, 3, 38
    fps = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (n, 3), dtype=np.uint64), axis=1)
    sketches = np.where(rng.random((n, 64)) < 0.15, rng.integers(0, 256, (n, 64), dtype=np.uint8), np.uint8(7))
    rows = pd.DataFrame({"fp": fps.view(np.int64), "size": rng.integers(90, 160, n), "node": np.arange(n), "root": np.arange(n), "mini": sketches[:, :8].copy().view("<i8")[:, 0]})
    values = pd.DataFrame({"node": rows["node"], "fp": rows["fp"], "size": rows["size"], "sketch": [x.tobytes() for x in sketches]})
    keyed = pd.concat(simhash._emit_segment_keys(LEAST)([rows])).sort_values(["key", "fp", "node"])
    found, sent = {}, {}
    for size in (16, 512):
        monkeypatch.setattr(simhash, "BLOCK_ROWS", size)
        places = pd.concat(simhash._members(BITS, minima, LEAST)([keyed])).drop_duplicates()
        sent[size] = len(places)
        held = places.merge(values, on="node").sort_values(["key", "tile_a", "tile_b"])
        pairs = [(block["node"][i], block["node"][j]) for block in simhash._blocks([held]) for i, j in simhash._open_parts(block, BITS, minima, LEAST, floor)]
        low, high = (np.concatenate([f(a, b) for a, b in pairs]) for f in (np.minimum, np.maximum))
        found[size] = sorted(zip(low.tolist(), high.tolist()))
    assert found[16] == found[512] and len(set(found[16])) == len(found[16]) > 10_000
    assert sent[512] < sent[16] / 2
