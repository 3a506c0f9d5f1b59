"""Near-duplicates by SimHash fingerprints, found through Golay-code fuzzy keys."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, broadcast_if_small, components, forest, stage, table

SHINGLE = 4
BITS_APART = 4
#: Generator polynomial of the binary [23, 12, 7] Golay code.
GOLAY = 0b101011100011
#: Where the three segments of a fingerprint start, and their widths.
SEGMENTS = [(0, 23), (23, 23), (46, 18)]


def _digests(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of the text's shingles of ``shingle`` words, in order; a shorter text is one shingle, none without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, "<u8")
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return np.array([digest(b" ".join(words), 42)], "<u8")
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    s, e = starts[:n - shingle + 1].tolist(), ends[shingle - 1:].tolist()
    return np.fromiter((digest(joined[i:j], 42) for i, j in zip(s, e)), "<u8", len(s))


def _majority(digests: np.ndarray) -> int:
    if not len(digests):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(digests), 65536):
        ones += np.unpackbits(digests[at:at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(((2 * ones > len(digests)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the text's shingles; 0 without words. Null counts as empty, repeats count each time."""
    return _majority(_digests(text, shingle))


def _set(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(_digests(text, shingle))


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def similarity(a: str | None, b: str | None, shingle: int) -> float:
    """Jaccard similarity of the sets of shingles; 1 for two texts without words."""
    return _jaccard(_set(a, shingle), _set(b, shingle))


def sketch(digests: np.ndarray) -> bytes:
    """64 one-byte minima of hashes of a set of digests: as many agree as the sets are similar, in the mean."""
    if not len(digests):
        return bytes(64)
    salt = np.random.default_rng(64).integers(0, 2**63, (2, 64), dtype=np.uint64)
    low = np.full(64, 2**64 - 1, np.uint64)
    for at in range(0, len(digests), 4096):
        np.minimum(low, ((digests[at:at + 4096, None] ^ salt[0]) * (2 * salt[1] + np.uint64(1))).min(0), out=low)
    return ((low * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes()


def _syndromes(words: np.ndarray) -> np.ndarray:
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where((rest >> bit) & 1, rest ^ (GOLAY << (bit - 11)), rest)
    return rest


@lru_cache(1)
def _golay_shifts() -> np.ndarray:
    """Per syndrome (2048) six error patterns leading to the codewords that are a word's keys.

    The code is perfect: one codeword lies within 3 bits of any word. A word 3 bits away from it also has five codewords at 4
    bits; other words repeat their only key. Words up to 2 bits apart then share a key.
    """
    from itertools import combinations

    table = np.zeros((2048, 6), np.int64)
    far: dict[int, list[int]] = {}
    for weight in (0, 1, 2, 3, 4):
        patterns = np.array([sum(1 << b for b in c) for c in combinations(range(23), weight)], np.int64)
        for pattern, syndrome in zip(patterns.tolist(), _syndromes(patterns).tolist()):
            if weight == 3:
                far[syndrome] = [pattern]
            elif weight < 3:
                table[syndrome] = pattern
            elif syndrome in far:
                far[syndrome].append(pattern)
    for syndrome, patterns in far.items():
        table[syndrome] = patterns
    return table


def fuzzy_keys(fps: np.ndarray) -> np.ndarray:
    """[n, 3, 36] keys of uint64 fingerprints (-1 where a key would repeat).

    At most 4 differing bits over 3 segments leave two segments with at most 2 between them, so each pair of segments gives the pairs of
    their codeword indices as keys, and linked fingerprints share one.
    """
    shifts = _golay_shifts()
    index, once = [], []
    for start, width in SEGMENTS:
        part = ((fps >> np.uint64(start)) & np.uint64((1 << width) - 1)).astype(np.int64)
        errors = shifts[_syndromes(part)]
        index.append((part[:, None] ^ errors) >> 11)
        once.append(np.concatenate([np.ones((len(fps), 1), bool), errors[:, 1:] != errors[:, :1]], axis=1))
    out = np.full((len(fps), 3, 36), -1, np.int64)
    for p, (i, j) in enumerate([(0, 1), (0, 2), (1, 2)]):
        key = (p << 24) | (index[i][:, :, None] << 12) | index[j][:, None, :]
        good = once[i][:, :, None] & once[j][:, None, :]
        out[:, p] = np.where(good, key, -1).reshape(len(fps), 36)
    return out


def _emit_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), 4096):
            fps = pdf["fp"].to_numpy()[at:at + 4096].astype(np.int64)
            keys = fuzzy_keys(fps.view(np.uint64)).reshape(len(fps), -1)
            good = keys >= 0
            yield pd.DataFrame({"key": keys[good].astype(np.int32), "fp": np.repeat(fps, good.sum(1))})


def _links(keys: np.ndarray, fps: np.ndarray, bits: int = BITS_APART) -> pd.DataFrame:
    """Spanning links of the pairs within ``bits`` bits that share a key; rows sorted by key. Output is linear in rows."""
    u64, live, us, vs, lag = fps.view(np.uint64), np.arange(len(keys)), [], [], 1
    nodes, where = np.unique(fps, return_inverse=True)
    held = 0
    while len(live):
        live = live[live + lag < len(keys)]
        live = live[keys[live] == keys[live + lag]]
        hit = live[np.bitwise_count(u64[live] ^ u64[live + lag]) <= bits]
        us.append(where[hit])
        vs.append(where[hit + lag])
        held += len(hit)
        if held > 2_000_000:
            u, v = np.concatenate(us), np.concatenate(vs)
            label = forest(u, v, len(nodes))
            us, vs = [np.arange(len(nodes))], [label]
            held = 0
        lag += 1
    if not us:
        return pd.DataFrame({"a": nodes[:0], "b": nodes[:0]})
    label = forest(np.concatenate(us), np.concatenate(vs), len(nodes))
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return pd.DataFrame({"a": nodes[moved], "b": nodes[label[moved]]})


def _match(bits: int):
    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows arrive sorted by key; a key's rows may straddle batches, so the last key waits for the next batch."""
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for pdf in batches:
            keys = np.concatenate([keys, pdf["key"].to_numpy().astype(np.int64)])
            fps = np.concatenate([fps, pdf["fp"].to_numpy().astype(np.int64)])
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if cut > 100_000:
                yield _links(keys[:cut], fps[:cut], bits)
                keys, fps = keys[cut:], fps[cut:]
        if len(keys):
            yield _links(keys, fps, bits)

    return match


def segment_words(fps: np.ndarray) -> np.ndarray:
    """[n, 18] codeword indices of the segments, each with the number of its segment above it (-1 where one would repeat)."""
    shifts = _golay_shifts()
    parts = []
    for p, (start, width) in enumerate(SEGMENTS):
        part = ((fps >> np.uint64(start)) & np.uint64((1 << width) - 1)).astype(np.int64)
        errors = shifts[_syndromes(part)]
        once = np.concatenate([np.ones((len(fps), 1), bool), errors[:, 1:] != errors[:, :1]], axis=1)
        parts.append(np.where(once, (p << 12) | ((part[:, None] ^ errors) >> 11), -1))
    return np.concatenate(parts, axis=1)


def size_band(sizes: np.ndarray, least: float) -> np.ndarray:
    """Classes of sizes: sets as similar as ``least`` lie in one or in two neighbouring ones."""
    return np.floor(np.log(np.maximum(sizes, 1)) / (np.log(1 / least) + 1e-9)).astype(np.int64)


def segment_keys(fps: np.ndarray, sizes: np.ndarray, least: float) -> np.ndarray:
    """[n, 2, 18] keys of fingerprints of ``sizes`` shingles: one segment's codeword index and a size class (-1 where a key would repeat).

    Of 8 differing bits over 3 segments one has 2 at most, so fingerprints up to 8 bits apart share a segment's
    codeword, and many further apart do. Sets as similar as ``least`` differ in size by 1 / ``least`` at most: in one class or two neighbouring ones.
    """
    segment, band = segment_words(fps), size_band(sizes, least)
    return np.stack([np.where(segment < 0, -1, ((band + up)[:, None] << 14) | segment) for up in (0, 1)], axis=1)


def first_common(words: np.ndarray, i: np.ndarray, j: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Whether ``word``, which rows i and j of ``words`` (see ``segment_words``) share, is the least that they share."""
    good = np.ones(len(i), bool)
    for at in range(0, len(i), 65536):
        cut = slice(at, at + 65536)
        for p in range(0, words.shape[1], 6):
            x, y = words[i[cut], p:p + 6, None], words[j[cut], None, p:p + 6]
            good[cut] &= ~((x == y) & (x >= 0) & (x < word[cut, None, None])).any((1, 2))
    return good


def _emit_segment_keys(least: float):
    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                part = pdf[at:at + 4096]
                keys = segment_keys(part["fp"].to_numpy().astype(np.int64).view(np.uint64), part["size"].to_numpy(), least)
                upper = np.broadcast_to(np.array([False, True])[:, None], keys.shape)
                good = keys >= 0
                n = good.sum((1, 2))
                yield pd.DataFrame({"key": keys[good], "upper": upper[good], **{c: np.repeat(part[c].to_numpy(), n) for c in ("fp", "node", "root", "mini")}})

    return emit


#: Words of the texts a block of candidate pairs may hold on each side; within that it has ``BLOCK_ROWS`` rows, more where else a key had more than ``KEY_TILES`` tiles.
BLOCK_WORDS, BLOCK_ROWS, KEY_TILES = 1 << 20, 512, 8


def _by_key(found, columns: tuple[str, ...]):
    """``found`` over runs of whole keys: rows arrive sorted by key, and a key's rows may straddle batches."""

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [np.zeros(0, np.int64)] * len(columns)
        for pdf in batches:
            held = [np.concatenate([h, pdf[c].to_numpy().astype(np.int64)]) for h, c in zip(held, columns)]
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if cut > 100_000:
                yield from found(*[h[:cut] for h in held])
                held = [h[cut:] for h in held]
        if len(held[0]):
            yield from found(*held)

    return match


def _tiles(keys: np.ndarray, least: float) -> np.ndarray:
    """Tiles that each key's rows are cut into: a row meets at most ``KEY_TILES`` of them, unless their texts would outgrow ``BLOCK_WORDS``."""
    first = np.searchsorted(keys, keys)
    rows = np.searchsorted(keys, keys, "right") - first
    words = (1 / least) ** ((keys >> 14) + 1.0)
    size = np.clip(-(-rows // KEY_TILES), BLOCK_ROWS, np.maximum(BLOCK_WORDS // np.maximum(words, 64), 1)).astype(np.int64)
    return (np.arange(len(keys)) - first) // size


def _agree(minis: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return ((minis[i] ^ minis[j]).view(np.uint8).reshape(-1, 8) == 0).sum(1)


def _neighbours(bits: int, minima: int, least: float):
    """Pairs of neighbours in the order of fingerprints under a key, at most ``bits`` apart and agreeing in ``minima`` of the eight bytes of ``mini``: no more than rows.

    ``tile_a`` and ``tile_b`` name the tiles of the pair.
    """

    def pairs(keys: np.ndarray, fps: np.ndarray, ids: np.ndarray, minis: np.ndarray) -> Iterator[pd.DataFrame]:
        u64, tile, at = fps.view(np.uint64), _tiles(keys, least), np.flatnonzero(keys[1:] == keys[:-1])
        at = at[np.bitwise_count(u64[at] ^ u64[at + 1]) <= bits]
        at = at[_agree(minis, at, at + 1) >= minima]
        low, high = np.minimum(ids[at], ids[at + 1]), np.maximum(ids[at], ids[at + 1])
        yield pd.DataFrame({"a": low, "b": high, "key": keys[at], "tile_a": tile[at], "tile_b": tile[at + 1]}).drop_duplicates(["a", "b"])

    return _by_key(pairs, ("key", "fp", "node", "mini"))


#: A row's place in a block of candidate pairs: the block is a key and two of its tiles, ``side`` is 1 in the second of two different ones.
PLACE = ("key", "tile_a", "tile_b", "side", "node", "root")
PLACES = ", ".join(f"{c} long" for c in PLACE)


def _members(bits: int, minima: int, least: float):
    """Places of the rows that have candidate pairs in a block: pairs of different roots with a common key, at most ``bits`` apart and agreeing in ``minima`` bytes of ``mini``.

    A pair belongs to its least common key alone. Pairs are not sent on, as a block finds its own again (``_open_pairs``): a tile pair sends as many
    rows as it has, not as many as its pairs. A place may come twice.
    """

    def places(keys: np.ndarray, fps: np.ndarray, ids: np.ndarray, roots: np.ndarray, minis: np.ndarray, upper: np.ndarray) -> Iterator[pd.DataFrame]:
        u64, words, tile = fps.view(np.uint64), segment_words(fps.view(np.uint64)).astype(np.int16), _tiles(keys, least)
        live, lag, held, many, span = np.arange(len(keys)), 1, [], 0, int(tile.max()) + 1

        def out(codes: np.ndarray) -> pd.DataFrame:
            at, other = codes // span, codes % span
            own = tile[at]
            return pd.DataFrame({"key": keys[at], "tile_a": np.minimum(own, other), "tile_b": np.maximum(own, other), "side": (own > other).astype(np.int64), "node": ids[at], "root": roots[at]})

        while len(live):
            live = live[live + lag < len(keys)]
            live = live[keys[live] == keys[live + lag]]
            # Two rows of the class below meet under that class.
            hit = live[(roots[live] != roots[live + lag]) & (upper[live] + upper[live + lag] < 2) & (np.bitwise_count(u64[live] ^ u64[live + lag]) <= bits)]
            hit = hit[_agree(minis, hit, hit + lag) >= minima]
            hit = hit[first_common(words, hit, hit + lag, keys[hit] & 0x3FFF)]
            held += [hit * span + tile[hit + lag], (hit + lag) * span + tile[hit]]
            many += 2 * len(hit)
            lag += 1
            if many > 1_000_000:
                held = [np.unique(np.concatenate(held))]
                many = len(held[0])
                if many > 500_000:
                    yield out(held[0])
                    held, many = [], 0
        if held:
            yield out(np.unique(np.concatenate(held)))

    return _by_key(places, ("key", "fp", "node", "root", "mini", "upper"))


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of each block, every node once; rows arrive sorted by block."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        at, cols = pdf[["key", "tile_a", "tile_b"]].to_numpy(), {c: pdf[c].to_numpy() for c in pdf.columns}
        starts = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]).any(1)]))
        for i, j in zip(starts[:-1], starts[1:]):
            yield _once({c: v[i:j] for c, v in cols.items()})
        rest = pdf[starts[-1]:]
    if rest is not None:
        yield _once({c: rest[c].to_numpy() for c in rest.columns})


def _once(block: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    first = np.unique(block["node"], return_index=True)[1]
    return block if len(first) == len(block["node"]) else {c: v[first] for c, v in block.items()}


def _open_parts(block: dict[str, np.ndarray], bits: int, minima: int, least: float, floor: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The candidate pairs of a block (see ``_members``) whose sketches agree in ``floor`` bytes at least, some rows' at a time."""
    key, side, alone = int(block["key"][0]), block["side"], block["tile_a"][0] == block["tile_b"][0]
    left, right = (np.arange(len(side)),) * 2 if alone else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    u64, root = block["fp"].astype(np.int64).view(np.uint64), block["root"]
    upper, words = size_band(block["size"], least) < key >> 14, segment_words(u64)
    bytes_ = np.frombuffer(b"".join(block["sketch"]), np.uint8).reshape(-1, 64)
    step = max(1, 65_536 // max(len(right), 1))
    for at in range(0, len(left), step):
        a, b = left[at:at + step, None], right[None, at + 1 if alone else 0:]
        good = (np.bitwise_count(u64[a] ^ u64[b]) <= bits) & (root[a] != root[b]) & ~(upper[a] & upper[b])
        i, j = np.nonzero(good & (a < b) if alone else good)
        i, j = a[i, 0], b[0, j]
        same = bytes_[i] == bytes_[j]
        good = (same[:, :8].sum(1) >= minima) & (same.sum(1) >= floor)
        i, j = i[good], j[good]
        good = first_common(words, i, j, np.full(len(i), key & 0x3FFF))
        if good.any():
            yield i[good], j[good]


def _open_pairs(block: dict[str, np.ndarray], *tests) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of ``_open_parts``."""
    none = np.zeros(0, np.int64)
    i, j = zip((none, none), *_open_parts(block, *tests))
    return np.concatenate(i), np.concatenate(j)


def _still_open(*tests):
    """Places that have a pair whose sketches agree."""

    def still_open(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [pd.DataFrame(columns=PLACE, dtype=np.int64)]
        for block in _blocks(batches):
            some = np.zeros(len(block["node"]), bool)
            for pair in _open_parts(block, *tests):
                some[np.concatenate(pair)] = True
            at = np.flatnonzero(some)
            held.append({c: block[c][at] for c in PLACE})
            if len(held) > 10_000:
                yield pd.DataFrame({c: np.concatenate([h[c] for h in held]) for c in PLACE})
                held = held[:1]
        yield pd.DataFrame({c: np.concatenate([h[c] for h in held]) for c in PLACE})

    return still_open


def _spanning(shingle: int, bits: int, minima: int, least: float, floor: int):
    """Links that span what the similar texts of each block connect: every open pair is compared unless earlier links of its block connect it."""

    def spanning(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        test, found = _Texts(shingle, least), []
        for block in _blocks(batches):
            up, sets = list(range(len(block["node"]))), {}

            def top(x: int) -> int:
                while up[x] != x:
                    up[x] = x = up[up[x]]
                return x

            parts = _open_parts(block, bits, minima, least, floor)
            for i, j in chain.from_iterable(zip(i.tolist(), j.tolist()) for i, j in parts):
                if top(i) != top(j):
                    for x in (i, j):
                        if x not in sets:
                            sets[x] = test.prepare(block["text"][x])
                    if test(sets[i], sets[j]):
                        found.append((block["node"][i], block["node"][j]))
                        up[top(i)] = top(j)
            if len(found) > 100_000:
                yield pd.DataFrame(found, columns=["a", "b"])
                found = []
        yield pd.DataFrame(found, columns=["a", "b"])

    return spanning


def _in_blocks(pairs: DataFrame, values: DataFrame, test, joined: bool) -> DataFrame:
    """Those of ``pairs`` (a, b, block) whose ``values`` (node, value) pass ``test(value, value)``.

    A value travels once to each block that needs it, not once per pair. ``test`` gets values prepared by
    ``test.prepare``. With ``joined`` pairs that earlier ones of their block connect are left out, as links would gain nothing.
    """
    member = pairs.select("block", F.explode(F.array("a", "b")).alias("node")).distinct()
    member = values.join(broadcast_if_small(member, 2_000_000), "node")
    rows = member.select("block", F.col("node").alias("a"), F.lit(-1).cast("long").alias("b"), "value")
    rows = rows.union(pairs.select("block", "a", "b", F.lit(None).cast(values.schema["value"].dataType)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A block's values, with -1 for b, come before its pairs."""
        here, at, up = None, {}, {}

        def top(x: int) -> int:
            while up.get(x, x) != x:
                x = up[x]
            return x

        for pdf in batches:
            found = []
            for block, a, b, value in zip(*(pdf[c].tolist() for c in ("block", "a", "b", "value"))):
                if block != here:
                    here, at, up = block, {}, {}
                if b < 0:
                    at[a] = test.prepare(value)
                elif not (joined and top(a) == top(b)) and test(at[a], at[b]):
                    found.append((a, b, block))
                    if joined:
                        up[top(a)] = top(b)
            yield pd.DataFrame(found, columns=["a", "b", "block"])

    ordered = rows.repartition("block").sortWithinPartitions("block", "b", "a")
    return ordered.mapInPandas(run, "a long, b long, block long")


class _Sketches:
    """Two sketches agree in ``floor`` bytes at least."""

    def __init__(self, floor: int):
        self.floor = floor

    def prepare(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, np.uint8)

    def __call__(self, x: np.ndarray, y: np.ndarray) -> bool:
        return np.count_nonzero(x == y) >= self.floor


class _Texts:
    """The shingles of two texts are as similar as ``least``."""

    def __init__(self, shingle: int, least: float):
        self.shingle, self.least = shingle, least

    def prepare(self, value: str | None) -> np.ndarray:
        return _set(value, self.shingle)

    def __call__(self, x: np.ndarray, y: np.ndarray) -> bool:
        return _jaccard(x, y) >= self.least


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row, whole texts."""

    @F.pandas_udf("long")
    def simhash(text: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in text], np.uint64).view(np.int64))

    return docs.select("doc_id", simhash("text").alias("fp"))


#: Fingerprints under one key that a task compares; a key with more is cut into tiles of so many.
KEY_ROWS = 20_000
#: Keys are counted together in so many groups first, one by one only in groups of more than ``KEY_ROWS``.
KEY_GROUPS = 1 << 18


def _dealt(keyed: DataFrame, key_rows: int) -> DataFrame:
    """(key, fp) with keys of more than ``key_rows`` rows dealt out: their rows are cut into tiles by hash, and each pair of tiles becomes a key of its own that holds the rows of both."""
    plain, group = keyed.select(F.col("key").cast("long").alias("key"), "fp"), F.pmod("key", F.lit(KEY_GROUPS)).alias("group")
    groups = stage(keyed.select(group).groupBy("group").count().where(F.col("count") > key_rows).select("group"), "groups")
    if groups.isEmpty():
        return plain
    suspect = keyed.select("key", group).join(broadcast_if_small(groups, KEY_GROUPS), "group", "left_semi")
    large = stage(suspect.groupBy("key").count().where(F.col("count") > key_rows), "large")
    if large.isEmpty():
        return plain
    held = broadcast_if_small(large, 2_000_000)
    few = keyed.join(held.select("key"), "key", "left_anti").select(F.col("key").cast("long").alias("key"), "fp")
    tiled = keyed.join(held, "key").withColumn("tiles", F.ceil(F.col("count") / key_rows).cast("int")).withColumn("t", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    both = tiled.select("key", "fp", "t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("o")).where("t <> o")
    return few.unionByName(both.select(F.xxhash64("key", F.least("t", "o"), F.greatest("t", "o")).alias("key"), "fp"))


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS_APART, verify: float | None = None, key_rows: int = KEY_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id (smallest doc_id reachable over links of at most ``bits`` bits).

    With ``verify`` a link also needs that Jaccard similarity of the texts' shingles (see ``_verified``); without it ``bits`` is 4 at most.

    Equal fingerprints are one node, so groups of copies cost one row per partition. Nodes send their fuzzy
    keys, are compared per key (keys of more than ``key_rows`` in pairs of tiles), and each task emits only a spanning forest of its links; distributed star
    contraction joins these up. Null doc_ids are the component's id only where all its ids are null; empty tables give empty
    results; rows without words share fingerprint zero and link.
    """
    if verify is not None:
        return _verified(docs, shingle, bits, verify)
    if bits > BITS_APART:
        raise ValueError("without verification the keys reach 4 bits")
    fp = stage(fingerprints(docs, shingle), "fp")
    nodes = stage(fp.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "nodes")
    total = nodes.agg(F.sum("n")).first()[0] or 1
    keyed = nodes.select("fp").mapInPandas(_emit_keys, "key int, fp long")
    links = stage(_dealt(keyed, key_rows).repartition("key").sortWithinPartitions("key").mapInPandas(_match(bits), "a long, b long"), "links")
    roots = components(links)
    tagged = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    smallest = tagged.groupBy("root").agg(F.min("low").alias("component_id"))
    final = stage(tagged.join(smallest, "root").select("fp", "component_id", "n"), "components")
    return attach(fp, final, "fp", "n", total).select("doc_id", "fp", "component_id")


def _verified(docs: DataFrame, shingle: int, bits: int, least: float) -> DataFrame:
    """Components over links of texts at most ``bits`` bits apart whose shingles are as similar as ``least``.

    Texts of equal words are one node. The first pass compares neighbours in the order of fingerprints under each key, which joins large
    groups of copies by about as many comparisons as they have members; the second compares every candidate pair
    that these links leave apart. So each candidate pair is either compared or already in one component. Texts
    meet only where the pair's sketches agree in three quarters of what ``least`` lets expect (at 0.8 sharp, one pair in 16,000 falls below, of others fewer). Eight of their
    bytes travel with the keys: where fewer than three (at 0.8) agree, no pair is sent; of pairs at 0.8 sharp one in 800 is lost there, of others fewer.
    """
    minima = max(int(8 * least + 1e-9) - 3, 0)
    floor = int(64 * least * 3 / 4)

    @F.pandas_udf("fp long, words long, size int, sketch binary, mini long")
    def profile(text: pd.Series) -> pd.DataFrame:
        import xxhash

        def one(t):
            d = _digests(t, shingle)
            distinct = np.unique(d)
            words = b" ".join((t or "").encode("utf-8", "surrogatepass").lower().split())
            made = sketch(distinct)
            return np.uint64(_majority(d)).astype(np.int64), np.uint64(xxhash.xxh64_intdigest(words)).astype(np.int64), len(distinct), made, int.from_bytes(made[:8], "little", signed=True)

        return pd.DataFrame([one(t) for t in text], columns=["fp", "words", "size", "sketch", "mini"])

    rows = docs.withColumn("_p", profile("text")).select("doc_id", "text", "_p.*", F.monotonically_increasing_id().alias("row"))
    rows = stage(rows, "profiles")
    nodes = rows.groupBy("words").agg(F.min("row").alias("node"), *[F.first(c).alias(c) for c in ("fp", "size", "sketch", "mini")], F.min("doc_id").alias("low"), F.count("*").alias("n"))
    nodes = stage(nodes, "nodes")
    total = nodes.agg(F.sum("n")).first()[0] or 1

    def keyed(rooted: DataFrame) -> DataFrame:
        return rooted.mapInPandas(_emit_segment_keys(least), "key long, upper boolean, fp long, node long, root long, mini long").repartition("key").sortWithinPartitions("key", "fp", "node")

    def near() -> DataFrame:
        """Links of neighbours."""
        found = keyed(nodes.select("fp", "size", "node", "mini", F.col("node").alias("root"))).mapInPandas(_neighbours(bits, minima, least), "a long, b long, key long, tile_a long, tile_b long")
        # Each pair belongs to its least key, so the pairs of a group of copies share few blocks.
        pairs = found.groupBy("a", "b").agg(F.min(F.struct("key", "tile_a", "tile_b")).alias("at")).select("a", "b", F.xxhash64("at.key", "at.tile_a", "at.tile_b").alias("block"))
        pairs = stage(_in_blocks(stage(pairs, "candidates"), nodes.select("node", F.col("sketch").alias("value")), _Sketches(floor), False), "pairs")
        texts = rows.select(F.col("row").alias("node"), F.col("text").alias("value"))
        return stage(_in_blocks(pairs, texts, _Texts(shingle, least), True).select("a", "b"), "links")

    def apart(rooted: DataFrame) -> DataFrame:
        """Links of all candidate pairs of different roots."""

        def blocks(places: DataFrame, values: DataFrame) -> DataFrame:
            # A value travels once to each block that needs it.
            here = values.join(broadcast_if_small(places, 2_000_000), "node")
            return here.repartition("key", "tile_a", "tile_b").sortWithinPartitions("key", "tile_a", "tile_b")

        places = stage(keyed(rooted).mapInPandas(_members(bits, minima, least), PLACES), "members")
        held = blocks(places, nodes.select("node", "fp", "size", "sketch"))
        places = stage(held.mapInPandas(_still_open(bits, minima, least, floor), PLACES), "open")
        held = blocks(places, rows.select(F.col("row").alias("node"), "fp", "size", "sketch", "text"))
        return stage(held.mapInPandas(_spanning(shingle, bits, minima, least, floor), "a long, b long"), "links")

    links = near()
    roots = components(links)
    rooted = nodes.join(roots, "node", "left").select("fp", "size", "node", "mini", F.coalesce("root", "node").alias("root"))
    roots = components(links.union(apart(stage(rooted, "rooted"))))
    tagged = nodes.join(roots, "node", "left").select("words", "low", "n", F.coalesce("root", "node").alias("root"))
    smallest = tagged.groupBy("root").agg(F.min("low").alias("component_id"))
    final = stage(tagged.join(smallest, "root").select("words", "component_id", "n"), "components")
    return attach(rows.select("doc_id", "fp", "words"), final, "words", "n", total).select("doc_id", "fp", "component_id")


def op9_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
