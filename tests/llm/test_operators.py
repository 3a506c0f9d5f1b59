"""Small fixtures with nulls, empty and long texts, ties, repeats and extra columns, against brute force."""

import hashlib
import re

import numpy as np
import pandas as pd
import pytest

from pixelrel.llm import chat, dedup, embeddings, mixing, packing, secrets, sharding, simhash, toxicity, warc

SCHEMA = "doc_id long, text string, source string, score double, kept string"
ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta", "s", 0.1, "x"), (2, "Alpha beta gamma delta epsilon zeta", "s", 0.2, "y"),
    (3, None, "s", 0.3, None), (4, "", None, 0.4, None), (5, "É" * 3 + " token: abc_123.4 AKIA" + "B" * 16 + " " + "A1" * 20 + "== https://host.example", "t", None, "z"),
    (6, "long word " * 6000, "t", 1.0, "z"), (6, "long word " * 6000, "t", 1.0, "z"), (7, "deadbeef" * 4 + " passwd=ab", "t", 1.0, "z"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_shards_are_contiguous_and_gapless(docs, empty):
    out = sharding.shard_by_bytes(docs, 3).toPandas().sort_values(["shard", "slot"])
    assert out["size"].tolist() == [len((t or "").encode()) + 1 for _, t, *_ in ROWS]
    assert out["doc_id"].is_monotonic_increasing
    assert all(g["slot"].tolist() == list(range(len(g))) for _, g in out.groupby("shard"))
    assert sharding.shard_by_bytes(empty).count() == 0


def test_secret_spans(docs, empty):
    out = secrets.find_secrets(docs).toPandas()
    found = out[out.doc_id == 5].iloc[0]
    text = ROWS[4][1]
    spans = {k: [text[s["s"]:s["e"]] for s in found[k]] for k in ("assign", "access", "hex", "weak", "endpoint")}
    assert spans == {"assign": ["token: abc_123.4"], "access": ["AKIA" + "B" * 16], "hex": [], "weak": ["A1" * 20 + "=="], "endpoint": ["https://host.example"]}
    assert len(out[out.doc_id == 7].iloc[0]["hex"]) == 1 and len(out[out.doc_id == 7].iloc[0]["assign"]) == 0
    assert secrets.find_secrets(empty).count() == 0


def test_exact_groups(docs, empty):
    out = dedup.exact_groups(docs).toPandas().set_index("doc_id")
    assert out.loc[1, "keep_id"] == 2 and out.loc[3, "keep_id"] == 4 and out.loc[4, "group_size"] == 2
    assert out.loc[6, "kept"].tolist() == [True, True] and out.loc[7, "group_size"] == 1
    assert out.loc[3, "text_sha256"] == hashlib.sha256(b"").hexdigest()
    assert dedup.exact_groups(empty).count() == 0


def test_counted_fingerprints_survive_partitions(spark):
    fps = spark.createDataFrame([(i % 7 - 3,) for i in range(50)] + [(2**63 - 1,)], "fp long").repartition(5)
    assert sorted(map(tuple, dedup.repeated_fingerprints(fps).collect())) == [(i - 3, 8 if i == 0 else 7) for i in range(7)]


def test_best_fit_is_full_and_tight():
    lengths = np.random.default_rng(1).integers(1, 4097, 3000)
    bins, offsets = packing.best_fit_decreasing(lengths, 4096)
    open_, order = [], np.argsort(-lengths, kind="stable")
    for n in lengths[order]:
        fits = [i for i, room in enumerate(open_) if room >= n]
        if fits:
            open_[min(fits, key=lambda i: open_[i])] -= n
        else:
            open_.append(4096 - n)
    assert len(set(bins)) == len(open_)
    assert all(lengths[bins == b].sum() <= 4096 for b in set(bins))


def test_pieces_cover_documents(docs, empty):
    out = packing.pack(packing.cut_pieces(docs), per_group=4).toPandas()
    assert set(out.doc_id) == {1, 2, 3, 4, 5, 6, 7} and (out.groupby("sequence_id").length.sum() <= 4096).all()
    assert (out[out.doc_id == 3].length == 1).all()
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
    assert packing.pack(packing.cut_pieces(empty)).count() == 0


def test_replication_means_and_extremes(spark, docs, empty):
    assert mixing.poisson_window(0) == (0, [1.0]) and abs(mixing.poisson_window(3.0)[1][0] - np.exp(-3)) < 1e-12
    low, cdf = mixing.poisson_window(1e8)
    assert len(cdf) < 300_000 and low > 9e7 and abs(low + np.searchsorted(cdf, 0.5) - 1e8) < 3
    many = spark.range(20000).selectExpr("id as doc_id", "'t' as text", "if(id % 4 = 0, 'a', 'b') as source")
    got = {r["source"]: r["count"] for r in mixing.replicate(many).groupBy("source").count().collect()}
    assert abs(got["a"] - 10000) < 400 and abs(got["b"] - 10000) < 400
    assert set(mixing.replicate(docs, {"s": 1.0}).toPandas()["source"]) <= {"s"}
    assert mixing.replicate(empty).count() == 0


def fingerprint(text):
    import xxhash

    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(docs):
    for _, text, *_ in ROWS:
        assert simhash.fingerprint(text) == fingerprint(text)


def test_fuzzy_keys_meet_within_four_bits():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    ka, kb = (simhash.fuzzy_keys(x).reshape(len(a), -1) for x in (a, b))
    assert all((set(x) & set(y)) - {-1} for x, y in zip(ka.tolist(), kb.tolist()))


def test_simhash_components(docs, empty):
    out = simhash.simhash_components(docs).toPandas().set_index("doc_id").component_id
    assert out.loc[2] == 1 and out.loc[4] == 3 and out.loc[7] == 7
    assert simhash.simhash_components(empty).count() == 0


def test_near_vectors_match_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 8))
    vectors = np.concatenate([base, base[:20] + rng.normal(size=(20, 8)) * 0.05, base[:5]])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0, 2.0])]
    out = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), tile=16).toPandas().set_index("vec_id")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.95
    np.fill_diagonal(links, False)
    assert out.n_links.loc[range(85)].tolist() == links.sum(1).tolist()
    reach = np.linalg.matrix_power((links | np.eye(85, dtype=bool)).astype(float), 90) > 0
    assert out.component_id.loc[range(85)].tolist() == reach.argmax(1).tolist()
    assert (out.n_links.loc[[900, 901, 902, 903]] == 0).all()


def test_tool_links(spark):
    call = '{"tool_calls": [{"id": "a", "name": "search", "arguments": {"query": "x"}}, {"id": "b", "name": "search", "arguments": {}, "depends_on": ["a"]}]}'
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", call), (1, 2, "tool", '{"tool_call_id": "a", "content": 1}'), (1, 3, "tool", '{"tool_call_id": "q"}'), (2, 0, None, None)]
    out = chat.link_tools(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).toPandas().set_index(["conv_id", "turn"])
    assert out.loc[(1, 1), ["n_calls", "n_answered", "n_invalid", "level"]].tolist() == [2, 1, 1, 1]
    assert out.loc[(1, 2), "link"] == "linked" and out.loc[(1, 3), "link"] == "orphan"
    assert out.loc[(2, 0), "message"] == '{"content":"","role":""}'


def test_revisits(spark):
    none = {"x": "1"}
    rows = [(1, "response", "HTTP://A.example:80/p?b=2&a=1", 10, "e", None, {"etag": "e", "server": "s"}), (2, "revisit", "http://a.example/p?a=1&b=2#f", 20, "e", None, {"Expires": "0", "server": "t"}),
            (3, "revisit", "http://a.example/p?a=1&b=2", 5, "e", None, none), (4, "revisit", "http://a.example/p?a=1&b=2", 30, "other", None, none), (5, "revisit", None, 30, "e", None, None)]
    out = warc.resolve_revisits(spark.createDataFrame(rows, "record_id long, kind string, url string, at long, etag string, last_modified string, headers map<string,string>")).toPandas().set_index("record_id")
    assert out.status.to_dict() == {2: "resolved", 3: "missing", 4: "mismatch", 5: "missing"}
    assert out.loc[2, "headers"] == {"etag": "e", "server": "s", "expires": "0"}


def test_toxicity_learns_and_survives_odd_rows(spark, docs):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(200)]
    texts = [(" ".join(rng.choice(words, 60)) + (" vile brute" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(400)]
    rows = spark.createDataFrame([*texts, (None, 0), ("", 1)], "text string, toxic int")
    model = toxicity.fit(rows)
    got = toxicity.score(rows.where("length(text) > 0"), model).toPandas()
    assert got.score[got.toxic == 1].min() >= toxicity.THRESHOLD > got.score[got.toxic == 0].max()
    out = toxicity.score(docs, model).toPandas()
    assert len(out) == len(ROWS) and out.score.between(0, 1).all() and out.kept.tolist() == [r[4] for r in ROWS]
    # The join path beyond the broadcast bound gives the same scores.
    joined = toxicity.score(docs, model, bound=-1).toPandas()
    pd.testing.assert_frame_equal(*[f.sort_values(["doc_id", "source", "kept", "text"])[["doc_id", "score", "predicted"]].reset_index(drop=True) for f in (out, joined)])
    blank = toxicity.fit(spark.createDataFrame([], "text string, toxic int"))
    assert toxicity.score(docs, blank).toPandas().score.between(0, 1).all()
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_word_models_are_kneser_ney(spark):
    """Kept words, their probabilities and the freed weight equal a brute-force count; both distributions sum to 1."""
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.permutation([*rng.choice(words, 30), *(["vile", "brute"] if i % 4 == 0 else [])])) for i in range(300)]
    toxic = [int(i % 4 == 0) for i in range(300)]
    model = toxicity.fit(spark.createDataFrame(list(zip(texts, toxic)), "text string, toxic int"))
    before = [{}, {}]
    for text, y in zip(texts, toxic):
        w = text.split()
        for a, b in zip(["", *w], w):
            before[y].setdefault(b, set()).add(a)
    n = [{w: len(v) for w, v in side.items()} for side in before]
    both = {w: len(before[0].get(w, set()) | before[1].get(w, set())) for w in {*n[0], *n[1]}}
    total = model.totals["all"]
    assert abs(total["t"] / sum(n[1].values()) - 1) < 0.02 and abs(total["s"] / sum(both.values()) - 1) < 0.02 and abs(total["v"] / len(both) - 1) < 0.02
    got = {r["word"]: r for r in model.words.collect()}
    hashes = toxicity._Hashes()
    signed = lambda w: int(np.uint64(hashes[w]).astype(np.int64))
    kept = {w for w in both if signed(w) in got and got[signed(w)]["kept"]}
    assert kept == {"vile", "brute"}
    d, shared = toxicity.DISCOUNT, lambda w: (both[w] - toxicity.DISCOUNT + toxicity.DISCOUNT * total["v"] / (total["v"] + 1)) / total["s"]
    own = [{w: max(side.get(w, 0) - d, 0) / total[k] for w in kept} for side, k in ((n[1], "t"), (n[0], "o"))]
    for w in kept:
        for i, c in enumerate(("p_t", "p_o")):
            assert abs(got[signed(w)][c] - (own[i][w] + (1 - sum(own[i].values())) * shared(w))) < 1e-12
    for side in own:
        whole = sum(side.values()) + (1 - sum(side.values())) * (sum(map(shared, both)) + d * total["v"] / (total["v"] + 1) / total["s"])
        assert abs(whole - 1) < 0.02


def test_word_ids_make_text_ids():
    """Ids put together from words equal those of whole texts, on awkward strings and on given documents."""
    import pandas as pd
    from tokenizers import Tokenizer

    from pixelrel.llm import packing

    path = packing.default_tokenizer()
    texts = ["", " ", "\n\n a", "é ́x", "Á\ņb", "ẛ̣ ̣", "it's 'LL 12a", "a b c\x1cd\x85e\tf\r\ng", "ΣΑΣ ΣΑΣ.", "가 ᆨ", "<|startoftext|> <|endoftext|>x <|endoftext|>",
             "x<|endoftext|>\ny", "x" * 5000, "\U0001f600 \U0001f468‍\U0001f469 q", "ﬁ Å Ａ", "İI ı\n"]
    texts += pd.read_parquet("/root/testdata/sf0.01/documents.parquet")["text"].fillna("").tolist()
    whole = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    encode = packing.Encoder(path, bound=1000)
    assert [np.frombuffer(ids, "<u4").tolist() for at in range(0, len(texts), 50) for ids in encode(texts[at:at + 50])] == whole


def test_pipeline_near_copies_are_verified(spark):
    """Texts of 5-word similarity 0.8 or more lose all but one; those below stay, however few bits lie between them."""
    import corpus_pipeline

    rng = np.random.default_rng(5)

    def sets(t):
        w = t.lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))}

    rows = []
    for g in range(60):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        rows.append((2 * g, " ".join(words)))
        for at in rng.choice(200, g % 8, replace=False):
            words[at] = "changed"
        rows.append((2 * g + 1, " ".join(words)))
    alike = [len(sets(a) & sets(b)) / len(sets(a) | sets(b)) for (_, a), (_, b) in zip(rows[::2], rows[1::2])]
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert kept >= {2 * g for g in range(60)} | {2 * g + 1 for g in range(60) if alike[g] < 0.8}
    close = [g for g in range(60) if alike[g] >= 0.8]
    assert sum(2 * g + 1 not in kept for g in close) >= 0.9 * len(close)


def test_shards_keep_equal_texts_together(spark):
    rows = [(i, f"text {i % 70} " + "x" * (i % 70 * 5)) for i in range(210)] + [(None, None), (300, "")]
    out = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 4).toPandas().sort_values(["shard", "slot"])
    assert len(out) == len(rows) and pd.isna(out.doc_id.iloc[0]) and out.doc_id.iloc[1] == 300
    assert (out.groupby("text_crc32").shard.nunique() > 1).sum() <= 3
    crc = out.text_crc32.to_numpy()
    assert (crc[1:] != crc[:-1]).sum() + 1 == len(set(crc))
