"""The registered queries on a small set of tables, against brute force."""

import hashlib
import json
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from pixelrel.llm import chat, dedup, mixing, packing, queries, secrets, simhash, warc

LONG = " ".join(f"word{i % 997}" for i in range(9000))
AKIA = "AKIA" + "ABCDEFGH01234567"
TEXTS = [
    "one two three four five six", "one two three four five six", None, "", "A b\tC d\x0be", "password = hunter22 and token: ab", LONG, LONG + " tail",
    f"{AKIA} then https://end.example/x and {'Zz9/' * 10} far", "see https://alone.example only", "deadbeef" * 4, "É ü 日本 token='secret_1' " + "0123456789abcdef" * 2,
    "sk " + "Q" * 44 + " at http://h.example " + "x " * 400 + AKIA + "Z", "passwd:abc api_key=\"k-1_2.3/4+5=\" API-KEY=zzzzzz apikey: 'qqqqqq'",
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    docs = pd.DataFrame({"doc_id": range(len(TEXTS)), "text": TEXTS, "lang": "en", "source": ["a", "b", None, "a", "b"] * 2 + ["c"] * (len(TEXTS) - 10), "n_chars": 0})
    docs = pd.concat([docs, docs[docs.doc_id == 5]])
    docs["kept"], docs["hash"], docs["size"], docs["assign"] = "x", 1, 2, None
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, hash int, size int, assign string"
    spark.createDataFrame(docs.astype(object).where(docs.notna(), None).values.tolist(), schema).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def run(name, spark, folder):
    return queries.QUERIES[name](spark, folder).toPandas()


def rows():
    return list(enumerate(TEXTS)) + [(5, TEXTS[5])]


def test_op2_shards(spark, tables):
    out = run("op2_sharding", spark, tables).sort_values(["shard", "slot"])
    sizes = {i: len((t or "").encode()) + 1 for i, t in rows()}
    assert sorted(out.doc_id) == sorted(i for i, _ in rows()) and (out["size"] == out.doc_id.map(sizes)).all()
    assert (out.text_crc32 == out.doc_id.map({i: zlib.crc32((t or "").encode()) for i, t in rows()})).all()
    # Groups of equal texts in the order of their smallest id, cut where the middle byte of a row passes an equal target.
    low = {}
    for i, t in rows():
        low[t or ""] = min(low.get(t or "", i), i)
    order = sorted(rows(), key=lambda r: (low[r[1] or ""], r[0]))
    total, at, want, slots = sum(sizes[i] for i, _ in order), 0, [], defaultdict(int)
    for i, _ in order:
        shard = min((2 * at + sizes[i]) * 16 // (2 * total), 15)
        want.append((i, shard, slots[shard]))
        slots[shard] += 1
        at += sizes[i]
    assert sorted(want) == sorted(zip(out.doc_id, out.shard, out.slot)) and set(out.law) == {"bytes"} and out.grown_shard.isna().all()


def base_spans(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def all_spans(text, scope=secrets.SCOPE):
    base = base_spans(text)
    weak = [(m.start(), 4, m.end()) for m in re.finditer(secrets.WEAK, text)]
    weak = [w for w in weak if not any(b[0] < w[2] and b[2] > w[0] for b in base)]
    ends = [(m.start(), 3, m.end()) for m in re.finditer(secrets.ENDPOINT, text)]
    near = lambda x, others: any(o[0] <= x[2] + scope and o[2] >= x[0] - scope for o in others)
    access = [b for b in base if b[1] == 1]
    return sorted(base + [w for w in weak if near(w, access + ends)] + [e for e in ends if near(e, base + weak)])


def render(spans):
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def test_op3_secrets(spark, tables):
    out = run("op3_secret_scan", spark, tables)
    assert len(out) == len(TEXTS) + 1
    for row in out.itertuples():
        text = TEXTS[row.doc_id] or ""
        base = base_spans(text)
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(b[1] == k for b in base) for k in range(3))
        assert row.base_sha256 == hashlib.sha256(render(base).encode()).hexdigest()
        assert row.spans == render(all_spans(text))


def test_op3_many_spans(spark):
    """Thousands of spans in one text: positions across block ends are right."""
    text = " ".join(f"token={'abc' * (2 + i % 3)} https://h{i}.example {'é' * (i % 7)}" for i in range(3000))
    out = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    got = sorted((s["s"], s["k"], s["e"]) for k in secrets.KINDS for s in out[k])
    assert got == all_spans(text)


def test_op4_copies(spark, tables):
    out = run("op4_exact_dedup", spark, tables)
    groups = defaultdict(list)
    for i, t in rows():
        groups[t or ""].append(i)
    for row in out.itertuples():
        mine = groups[TEXTS[row.doc_id] or ""]
        assert (row.keep_id, row.group_size, row.kept) == (max(mine), len(mine), row.doc_id == max(mine))
        assert row.text_sha256 == hashlib.sha256((TEXTS[row.doc_id] or "").encode()).hexdigest()


def test_filters_give_back_their_slots():
    rng = np.random.default_rng(7)
    fps = np.concatenate([rng.integers(-2**63, 2**63, 5000), np.repeat(rng.integers(-2**63, 2**63, 5), 400)])
    parts = [next(dedup._builder(5)(iter([pd.DataFrame({"fp": p})]))) for p in np.array_split(rng.permutation(fps), 3)]
    merged = pd.concat([dedup._merge(g) for _, g in pd.concat(parts).groupby("block")])
    back = {}
    for row in merged.itertuples():
        quotient = dedup._quotients(row.occupied, row.run_ends, len(row.counts))
        assert (np.diff(quotient) >= 0).all()
        for q, r, n in zip(quotient, row.remainders, row.counts):
            back[(((int(row.block) << dedup.QUOTIENT_BITS) | int(q)) << (64 - 5 - dedup.QUOTIENT_BITS)) | int(r)] = int(n)
    values, counts = np.unique(fps.view(np.uint64), return_counts=True)
    assert back == dict(zip(values.tolist(), counts.tolist()))


MESSAGES = [
    (1, 0, "user", "hi"), (1, 1, "assistant", json.dumps({"tool_calls": [{"id": "a", "function": {"name": "search", "arguments": '{"query": "x"}'}}, {"name": "search"}]})),
    (1, 2, "tool", '{"tool_call_id": "a", "content": 1}'), (1, 2, "tool", '{"tool_call_id": "a", "content": 1}'),
    (2, 5, "assistant", json.dumps({"tool_calls": [{"id": "c", "name": "calculator", "arguments": {"expression": 1}, "depends_on": ["b"]}, {"id": "b", "name": "other", "arguments": {}, "depends_on": ["a"]}, {"id": "a", "name": "search", "arguments": {"query": "q"}}]})),
    (2, 4, "tool", '{"tool_call_id": "b"}'), (3, 0, "assistant", '{"tool_calls": [{"id": "x", "name": "search", "depends_on": ["y"]}, {"id": "y", "name": "search", "depends_on": ["x"]}]}'),
    (4, 0, "assistant", '{"tool_calls": [{"id": "\\ud800", "name": "search"}]}'), (4, 1, "tool", '{"tool_call_id": "\\ud800", "v": "\\udfff"}'), (5, 0, "user", '{"tool_call_id": "n", "v": 1e999}'),
    (None, 0, "assistant", '{"tool_calls": [{"id": "z", "name": "search", "arguments": {"query": "w"}}]}'), (None, 1, "tool", '{"tool_call_id": "z"}'), (6, 0, None, None), (7, 0, "user", '{"a": [1'), (8, 0, "user", "long " * 50_000),
]


def test_op5_links(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string, level string, id int"
    spark.createDataFrame([(*m, "x", 1) for m in MESSAGES], schema).write.parquet(f"{tmp_path}/conversations.parquet")
    out = run("op5_chat_tools", spark, str(tmp_path))
    assert len(out) == len(MESSAGES)
    at = {(c if c == c else None, t, r): row for c, t, r, row in zip(out.conv_id, out.turn, out.role, out.itertuples())}
    a = at[1, 1, "assistant"]
    assert (a.n_calls, a.n_answered, a.n_invalid, a.n_unknown, a.n_unlinkable, a.level, a.call_order) == (1, 1, 0, 0, 1, 0, "a")
    assert at[1, 2, "tool"].link == "linked" and at[2, 4, "tool"].link == "early"
    a = at[2, 5, "assistant"]
    assert (a.n_calls, a.n_invalid, a.n_unknown, a.level, a.call_order) == (3, 1, 1, 2, "a,b,c")
    assert pd.isna(at[3, 0, "assistant"].level) and at[3, 0, "assistant"].call_order == "x,y"
    assert at[4, 1, "tool"].link == "linked" and json.loads(at[4, 1, "tool"].message)["content"] == '{"tool_call_id":"\\ud800","v":"\\udfff"}'
    assert pd.isna(at[5, 0, "user"].link) and "Infinity" not in at[5, 0, "user"].message
    assert at[None, 1, "tool"].link == "orphan"
    for conv, turn, role, text in MESSAGES:
        row = at[conv, turn, role]
        if row.n_calls + row.n_unlinkable == 0 and pd.isna(row.link):
            assert row.message == chat.canonical({"role": role or "", "content": text or ""})
    assert chat.link_tools(spark.createDataFrame([], schema)).count() == 0


def test_levels_of_large_conversations(spark):
    """Level by level, as for conversations too large for one task, equals the pass in one task."""
    calls = [(c, f"n{i}", [f"n{j}" for j in (i - 1, i // 2) if 0 <= j < i] + (["gone"] if i == 9 else [])) for c in (1, 2) for i in range(12)]
    frame = spark.createDataFrame(calls, "conv_id long, id string, deps array<string>")
    got = [sorted(map(tuple, chat._levels(frame, bound).collect())) for bound in (1000, 3)]
    assert got[0] == got[1] and len(got[0]) == 18


def test_op6_pieces(spark, tables):
    from tokenizers import Tokenizer

    out = run("op6_best_fit_packing", spark, tables)
    encode = Tokenizer.from_file(packing.default_tokenizer()).encode
    for doc_id, group in out.groupby("doc_id"):
        ids = [*encode(TEXTS[doc_id] or "", add_special_tokens=False).ids, 1]
        want = [(k, s, len(ids[s:s + 4096]), zlib.crc32(np.array(ids[s:s + 4096], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
        assert sorted(zip(group.piece, group.start, group.length, group.ids_crc32)) == sorted(want * (2 if doc_id == 5 else 1))
    lengths = out.length.to_numpy()
    assert out.sequence_id.nunique() == packing.best_fit_decreasing(lengths, 4096)[0].max() + 1
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 4096


def test_op7_counts(spark, tables):
    """Each row's number of copies is the inverse of the Poisson distribution of its source's rate at the row's own number."""
    out = run("op7_source_mixing", spark, tables)
    number = "xxhash64(17, doc_id, coalesce(source, ''), text)"
    given = spark.read.parquet(f"{tables}/documents.parquet").selectExpr("doc_id", "coalesce(source, '') as source", f"shiftrightunsigned({number}, 11) / 9007199254740992D as u").toPandas()
    rate = len(given) / given.source.nunique() / given.groupby("source").doc_id.transform("size")
    want = defaultdict(int)
    for doc_id, u, r in zip(given.doc_id, given.u, rate):
        k, share, term = 0, np.exp(-r), np.exp(-r)
        while share <= u:
            k += 1
            term *= r / k
            share += term
        want[doc_id] += k
    assert out.doc_id.value_counts().to_dict() == {d: n for d, n in want.items() if n}
    again = mixing.replicate(spark.createDataFrame([(i, "t", "rare" if i == 0 else "b") for i in range(300)], "doc_id long, text string, source string"))
    assert 60 < again.where("source = 'rare'").count() < 240


def test_op8_matches_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    want, got = con.execute(warc.SQL).df(), run("op8_warc_revisits", spark, folder)
    assert set(want.columns) == set(got.columns) and got.status.nunique() == 3
    plain = lambda f: sorted(map(str, f[sorted(f.columns)].astype(object).where(f.notna(), None).itertuples(index=False, name=None)))
    assert [r.replace(".0", "") for r in plain(want)] == [r.replace(".0", "") for r in plain(got)]


def test_revisits_by_brute_force(spark):
    """A hot address, equal times, repeated rows, header names in mixed case, extra columns, few slices."""
    rng = np.random.default_rng(8)
    recs = []
    for i in range(400):
        kind = "response" if rng.random() < 0.4 else "revisit"
        recs.append((i, kind, "http://Me:PW@H.example/hot/" if rng.random() < 0.6 else f"http://h.example/{i % 5}", int(rng.integers(0, 60)), rng.choice(["e", "f", None]), None, {"ETag": f"{i}", "Expires": "1"} if kind == "response" else {"expires": "2"}, 1))
    recs += [recs[-1]]
    schema = "record_id long, kind string, url string, at long, etag string, last_modified string, headers map<string,string>, slice int"
    out = warc.resolve_revisits(spark.createDataFrame(recs, schema), slices=7).toPandas()
    by_id = {r[0]: r for r in recs}
    assert len(out) == sum(r[1] == "revisit" for r in recs) and "http://Me:PW@h.example/hot" in set(out.url_key)
    for row in out.itertuples():
        mine = by_id[row.record_id]
        earlier = [r for r in by_id.values() if r[1] == "response" and r[2] == mine[2] and (r[3], r[0]) < (mine[3], mine[0])]
        base = max(earlier, key=lambda r: (r[3], r[0]), default=None)
        assert (None if pd.isna(row.resolved_id) else row.resolved_id) == (base and base[0])
        status = "missing" if base is None else "unchecked" if None in (base[4], mine[4]) else "resolved" if base[4] == mine[4] else "mismatch"
        assert row.status == status
        assert row.headers == ({} if base is None else {"etag": str(base[0]), "expires": "2" if status == "resolved" else "1"})
    assert warc.resolve_revisits(spark.createDataFrame([], schema)).count() == 0


def test_op9_components(spark, tables):
    out = run("op9_simhash_golay", spark, tables)
    prints = {i: simhash.fingerprint(t) for i, t in rows()}
    low = {i: i for i in prints}
    for _ in prints:
        for i in prints:
            low[i] = min(low[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 4)
    assert len(out) == len(TEXTS) + 1
    for row in out.itertuples():
        assert (row.fingerprint, row.component_id) == (f"{prints[row.doc_id]:016x}", low[row.doc_id])


def test_op10_odd_vectors(spark, tmp_path):
    base = [1.0, 2.0, 3.0, 4.0] * 16
    vectors = [(1, base), (2, [2 * x for x in base]), (3, None), (4, [0.0] * 64), (None, base), (5, [float("inf")] * 64), (6, [None] * 64), (7, [1.0, 2.0]), (8, []), (1, base)]
    spark.createDataFrame([(*v, 9) for v in vectors], "vec_id long, embedding array<float>, n_links int").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = run("op10_embedding_dedup", spark, str(tmp_path))
    assert len(out) == len(vectors)
    assert out[out.vec_id == 2].iloc[0][["n_links", "component_id", "kept"]].tolist() == [3, 1, False]
    assert (out[out.vec_id.isin([3, 4, 5, 6, 7, 8])].n_links == 0).all() and out[out.vec_id.isna()].component_id.tolist() == [1]


def test_pipeline_stages(spark, tables, tmp_path):
    """Each stage on its predecessor's rows: clean and short rows stay, copies go, and the last packs what the one before kept."""
    import corpus_pipeline as pipeline

    spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i == 4)) for i in range(len(TEXTS))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = dict(pipeline.STAGES)
    ids = lambda d: sorted(r["doc_id"] for r in d.select("doc_id").collect())
    assert ids(kept["toxicity"](spark, docs, str(tmp_path))) == ids(docs)
    exact = kept["exact_dedup"](spark, docs, str(tmp_path))
    assert ids(exact) == [1, 3, 4, 5, 5, *range(6, len(TEXTS))] and exact.columns == docs.columns
    near = kept["simhash_dedup"](spark, exact, str(tmp_path))
    assert ids(near) == [1, 3, 4, 5, 5, 6, *range(8, len(TEXTS))] and near.columns == docs.columns
    mixed = kept["mixing"](spark, near, str(tmp_path))
    assert set(ids(mixed)) <= set(ids(near)) and mixed.columns == docs.columns
    whole = pipeline.run(spark, str(tmp_path)).toPandas()
    want = sorted(ids(mixed))
    assert sorted(whole[whole.piece == 0].doc_id) == want and (whole.groupby("sequence_id").length.sum() <= packing.CAPACITY).all()
    empty = docs.limit(0)
    assert all(step(spark, empty, str(tmp_path)).count() == 0 for _, step in pipeline.STAGES)


CLASHES = ["_row", "_key", "_x", "_id", "_p", "score", "predicted", "held_out", "kept", "keep_id", "text_sha256", "component_id", "words", "fp", "node", "n", "rate", "copy", "shuffle_key", "_source", "_times", "piece", "start", "grp", "a.b"]


def test_pipeline_keeps_other_columns_whatever_their_names(spark, tables, tmp_path):
    import corpus_pipeline as pipeline
    from pyspark.sql import functions as F

    spark.createDataFrame([(4, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    plain = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text", "source")
    docs = plain.select("*", *[F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias(c) for c in CLASHES])
    docs = docs.unionByName(docs.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    for name, step in pipeline.STAGES[:-1]:
        out = step(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        rows = out.toPandas()
        assert len(rows) and all((rows[c].str.split("-").str[0] == c).all() for c in CLASHES), name
    assert pipeline.pack(spark, docs, str(tmp_path)).count() >= len(TEXTS)
