"""Toxicity counts: totals are exact, and no table of the fit has a row a pair of a word that a test has kept."""

import numpy as np

from pixelrel.llm import toxicity


def test_common_second_words_send_no_row_a_pair(spark, monkeypatch):
    """Words telling after one word alone are counted exactly, though each follows hundreds of others."""
    rng = np.random.default_rng(8)
    common, rare = ["the", "of", "and", "to"], [f"w{i}" for i in range(600)]
    texts, toxic = [], []
    for i in range(1200):
        words = [x for w in rng.choice(rare, 20, replace=False) for x in (w, common[rng.integers(4)])]
        toxic.append(int(i % 4 == 0))
        texts.append(" ".join(words + ([x for c in common for x in ("vile", c)] if toxic[-1] else ["vile"] * (i % 50 == 1))))
    sizes, kept = {}, toxicity.stage

    def noted(df, name):
        out = kept(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(toxicity, "stage", noted)
    model = toxicity.fit(spark.createDataFrame(list(zip(texts, toxic)), "text string, toxic int"))
    pairs = [{p for t, y in zip(texts, toxic) if y in side for p in zip(["", *t.split()], t.split())} for side in ((1,), (0,), (0, 1))]
    vocabulary = {w for _, w in pairs[2]}
    total = model.totals["all"]
    assert [total[k] for k in "tosv"] == [*map(len, pairs), len(vocabulary)]
    hashes = toxicity._Hashes()
    got = {r["word"]: r["p_o"] for r in model.words.collect()}
    counted, given = [], []
    for c in common:
        counted.append(sum(w == c for _, w in pairs[2]))
        given.append(got[int(np.uint64(hashes[c]).astype(np.int64))])
    assert min(counted) > 500
    # Second words rest on the shared backoff alone, so they are to each other as their discounted counts.
    d = toxicity.DISCOUNT
    shared = np.array(counted) - d + d * total["v"] / (total["v"] + 1)
    np.testing.assert_allclose(np.array(given) / given[0], shared / shared[0], rtol=1e-12)
    assert sizes["kept_pairs"] >= 4
    assert max(n for name, n in sizes.items() if name != "toxic_pairs") <= 2 * len(vocabulary), sizes
