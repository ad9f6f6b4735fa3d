"""Operators against brute force, exact round trips, libraries and held-out rows."""

import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docflow.llm import common, components, dpbpe, heapbpe, jaccard, kernels, lines, lm, packing, quality, substring, topk, toxicity

from . import brute

tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string"


@pytest.fixture(autouse=True)
def many_small_pieces(monkeypatch):
    """Small inputs go through several fragments, buckets and batches, as large ones do."""
    monkeypatch.setattr(jaccard, "FRAGMENT_BYTES", 1)
    monkeypatch.setattr(substring, "MINIMIZER_BYTES", 1)
    monkeypatch.setattr(substring, "WINDOW_BYTES", 1)
    monkeypatch.setattr(lm, "BATCH_BYTES", 1)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 1)
    monkeypatch.setattr(topk, "GROUP_BYTES", 1)
    monkeypatch.setattr(common, "ROW_BYTES", 60)


def word(r):
    return "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5)))


def near_copies(r, n, size, edits):
    base = [word(r) for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(size)] = word(r)
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    texts = near_copies(r, 60, 80, 3) + near_copies(r, 30, 40, 3) + near_copies(r, 12, 9, 2)
    shared = " ".join(word(r) for _ in range(50))
    texts += [" ".join(word(r) for _ in range(60)) + " " + shared + " " + " ".join(word(r) for _ in range(60)) for _ in range(25)]
    texts += [" ".join(word(r) for _ in range(r.randint(0, 50))) for _ in range(60)] + [texts[3]] * 20
    r.shuffle(texts)
    return dict(enumerate(texts))


def test_jaccard_components(spark, corpus):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(list(corpus.items()), DOCS)).collect()}
    want = brute.components(corpus)
    assert got == want
    assert max(Counter(c for _, c in want.values()).values()) > 60


def test_jaccard_at_the_threshold(spark):
    # 7 shared of 9 + 9 - 7 = 11 is below 3/4; 6 of 8 is on it
    a, on = "1 2 3 4 5 6 7 8 9 10 11", "1 2 3 4 5 6 7 8 9 10 x"
    cases = {1: a, 2: on, 3: "A b C d e", 4: "a B c D e", 5: "p q", 6: "P\tQ", 7: "p"}
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(list(cases.items()), DOCS)).collect()}
    assert got == {k: c for k, (_, c) in brute.components(cases).items()}
    assert got[2] == 1 and got[4] == 3 and got[6] == 5 and got[7] == 7


def test_groups_get_a_partition_each(spark):
    for n in (1, 7, 64, 211):
        keys = [(int(k), i) for i, k in enumerate(common.group_keys(n))]
        found = spark.createDataFrame(keys, "k int, i int").repartition(n, "k").select("i", F.spark_partition_id().alias("p")).collect()
        assert all(r.i == r.p for r in found)


def test_minimizers_spread_over_the_buckets():
    r = np.random.default_rng(2)
    h, first = r.integers(0, 1 << 63, 60_000).astype(np.uint64), np.arange(0, 60_001, 600)
    grams, _, best = substring.minimizers(h, first, 35, 20)
    at = np.unique(best)
    dealer = substring._Dealer(16)
    rows = np.arange(100)[np.searchsorted(first, at, "right") - 1]
    sizes = [len(x) for batch in [*dealer.add(grams[at], rows, at), *dealer.flush()] for x in batch.column(1).to_pylist()]
    assert len(sizes) == 16 and max(sizes) < 1.5 * sum(sizes) / 16


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(250)] + [(i, i + 1) for i in range(400, 470)]
    root = list(range(500))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_substring(spark, corpus):
    texts = list(corpus.values()) + ["a b " * 40, "x " * 34, "x " * 35, "y " * 36]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert [got[i] for i in range(len(texts))] == brute.repeats(texts)
    assert sum(x[1] for x in got.values()) > 2000


def test_window_hashes_are_of_the_words_alone():
    r = random.Random(1)
    words = np.array([r.randrange(1 << 63) for _ in range(500)], np.uint64)
    for k in (2, 5, 20, 35):
        both = np.concatenate([words[100:200], words[:50], words[100:200]])
        h = kernels.windows(both, k)
        assert (h[: 100 - k + 1] == h[150 : 250 - k + 1]).all()
        assert len(set(kernels.windows(words, k).tolist())) == 500 - k + 1


def walked(tokens, counts, m, root):
    """log10 probability of a text by one walk from left to right over states, arcs and failure arcs."""
    state, total = ("^", "^"), 0.0
    while state and not counts[state]:
        state = state[1:]
    for x in tokens:
        while state and not counts[*state, x]:  # no arc: fail
            total += math.log10(m[len(state)] / (counts[state] + m[len(state)]))
            state = state[1:]
        total += math.log10(probability(state, x, counts, m, root))
        state = (*state, x)[-2:]
        while state and not counts[state]:
            state = state[1:]
    return total


def probability(state, x, counts, m, root):
    if not state:
        return root(x)
    k = len(state)
    return (counts[*state, x] + m[k] * probability(state[1:], x, counts, m, root)) / (counts[state] + m[k]) if counts[state] else probability(state[1:], x, counts, m, root)


def test_lm_scores(spark, corpus):
    docs = {k: v for k, v in corpus.items() if k < 150} | {1000: None, 1001: ""}
    got = {r.doc_id: r for r in lm.score_texts(spark.createDataFrame(list(docs.items()), DOCS)).collect()}
    tokens = {k: [*brute.WORDS((v or "").translate(brute.LOWER)), "$"] for k, v in docs.items()}
    grams = [Counter() for _ in range(3)]
    for k, t in tokens.items():
        if zlib.crc32(str(k).encode()) % 7 != 2:
            long = ["^", "^", *t]
            for i, seen in enumerate(grams):
                seen.update(tuple(long[j - i : j + 1]) for j in range(2, len(long)))
    c = grams[0]
    n, v, ones, twos = c.total(), len(c), sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
    d = ones / (ones + 2 * twos)
    root = lambda x: (c[(x,)] - d) / n if c[(x,)] else d * v / n
    m = {k: lm.fitted(lm.failing_mass(np.array(list(grams[k - 1].values()))), sum(x == 1 for x in grams[k].values())) for k in (1, 2)}
    counts = grams[0] + grams[1] + grams[2] + Counter({("^",): c[("$",)], ("^", "^"): c[("$",)]})
    for k, t in tokens.items():
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(k).encode()) % 7 == 2, len(t), sum(c[(x,)] > 0 for x in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[(x,)] + 1) / (n + v + 1)) for x in t), rel_tol=1e-9)
        assert math.isclose(r.score, walked(t, counts, m, root), rel_tol=1e-6)
    for state in [(), ("^", "^"), *[g for g in [*grams[0], *grams[1]] if g[-1] != "$"][:40]]:  # each state's weights sum to one, the unknown word's among them
        assert math.isclose(sum(probability(state, x, counts, m, root) for (x,) in c) + probability(state, "never seen", counts, m, root), 1, rel_tol=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_backoff_follows_the_counts():
    few, many = np.full(1000, 3), np.full(1000, 300)
    for counts in (few, many):  # states seen alike: the failing mass fitted is that asked for
        m = lm.fitted(lm.failing_mass(counts), counts.sum() * 0.2)
        assert math.isclose(m / (counts[0] - 1 + m), 0.2, rel_tol=0.15)


def fuzz(seed, n, alphabet, specials):
    r = random.Random(seed)
    out = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(n)]
    return [t + r.choice(specials) + t if r.random() < 0.1 else t for t in out]


ALPHABET = "ab cdeé Ñ日本\n\t  <|>😀 #the of in\x00́İ \x1c's'll12\r\nΣ.,ß×÷»▁</s>"
SPECIALS = ["<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "<0x41>"]


def test_token_counts_equal_the_library():
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), heapbpe.counter(path)
    for t in [*fuzz(1, 5000, ALPHABET, SPECIALS), "x" * 5000, "  " * 300 + "a", "ab" * 3000]:
        assert own.count(t) == len(library.encode(t)), repr(t)


def test_codec_equals_the_library():
    path = tokenizers.path("byte_bpe_50k.json")
    library, own = pytest.importorskip("tokenizers").Tokenizer.from_file(path), dpbpe.vocabulary(path)
    for t in [*fuzz(2, 5000, ALPHABET, SPECIALS), "x" * 3000, " " * 300, "ab" * 2000]:
        ids = library.encode(t, add_special_tokens=False).ids
        got = own.encode(t)
        assert got == struct.pack(f"<{len(ids)}I", *ids), repr(t)
        assert own.decode(got) == library.decode(ids, skip_special_tokens=False) == t


def test_word_ids_equal_the_library():
    import pyarrow as pa

    path = tokenizers.path("word_bpe_49k.json")
    library, own = pytest.importorskip("tokenizers").Tokenizer.from_file(path), packing.encoder(path)
    texts = [*fuzz(3, 4000, ALPHABET, SPECIALS), "", "Foo. bar, BAZ.; a.b É. ×. 1. x", "w" * 3000]
    ids, first = own.encode(pa.array(texts))
    for t, a, b in zip(texts, first[:-1], first[1:], strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids[4 * a : 4 * b] == struct.pack(f"<{len(want)}I", *want), repr(t)


def test_packing(spark, corpus):
    docs = spark.createDataFrame([*corpus.items(), (5000, "long " * 3000)], DOCS).repartition(5)
    path = tokenizers.path("word_bpe_49k.json")
    rows = packing.pack_texts(docs, path, size=256, open_windows=4, merge=2).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(path)
    for k, t in [*corpus.items(), (5000, "long " * 3000)]:
        pieces = sorted(by_doc[k], key=lambda r: r.start)
        want = [*library.encode(t, add_special_tokens=False).ids, 2]
        assert b"".join(bytes(r.ids) for r in pieces) == struct.pack(f"<{len(want)}I", *want)
        assert [r.start for r in pieces] == [sum(x.length for x in pieces[:i]) for i in range(len(pieces))]
    for parts in by_seq.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == [sum(x.length for x in parts[:i]) for i in range(len(parts))]
        total = sum(r.length for r in parts)
        assert total <= 256 and total & (total - 1) == 0


def test_packer_is_bounded_and_best_fit():
    done = []
    p = packing.Packer(10, 2, done.append)
    for i, n in enumerate((6, 7, 3)):
        p.add(i, n)
    assert done == [[(1, 0, 7), (2, 0, 3)]]  # best fit: into the window with the least room that holds it
    p.add(3, 9)
    p.add(4, 8)  # none fits and both windows are open: the fullest is filled up
    assert done[-1] == [(3, 0, 9), (4, 0, 1)] and len(p.used) == 2
    left = p.finish()
    assert sum(n for w in [*done, left] for _, _, n in w) == 6 + 7 + 3 + 9 + 8
    assert all(sum(n for _, _, n in w) == 10 for w in done)


def test_quality_policies_and_ablation(spark):
    ok = " ".join(f"word{i}" for i in range(60))
    rows = [(1, ok), (2, "short"), (3, "a b c " * 40), (4, " ".join(f"w{i}%%" for i in range(60))), (5, "x%%")]
    led = quality.ledger(spark.createDataFrame(rows, DOCS)).withColumns({v: quality.verdict(v) for v in quality.POLICIES}).cache()
    assert {r.doc_id: (r.base, r.v1) for r in led.collect()} == {1: (True, True), 2: (False, False), 3: (False, False), 4: (True, False), 5: (False, False)}
    assert {tuple(r) for r in quality.ablation(led).collect()} >= {("few_words", 2, 1), ("repeated_windows", 1, 0), ("many_symbols", 2, 1)}
    assert {r.rule for r in quality.ablation(led, "base").collect()} == {"few_words", "repeated_windows"}


def test_quality_plan_has_no_python_and_no_shuffle(spark, sf_dir):
    plan = quality.ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_boilerplate_by_sites(spark):
    rows = [(i, f"line on {k} sites\n own {i} \n\n", f"s{i % k}") for k in (3, 9, 10, 11, 40) for i in range(1000 * k, 1000 * k + 45)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.kept_text for r in lines.remove_boilerplate(docs).collect()}
    assert [got[r[0]] for r in rows] == brute.boilerplate([(r[1], r[2]) for r in rows], 10)
    assert got[9000].startswith("line on 9") and got[10000].startswith(" own")


def test_search_prunes_and_is_exact():
    r = np.random.default_rng(3)
    centres = r.normal(size=(8, 16)) * 400
    x = (centres[np.repeat(np.arange(8), 400)] + r.normal(size=(3200, 16)) * 20).astype(np.int64)
    ids, queries = np.arange(3200), np.arange(0, 3200, 100)
    score, best, visited = topk.search(x[queries], queries, x, ids, 10)
    for q, s, i in zip(queries, score, best, strict=True):
        all_scores = x @ x[q]
        want = [j for j in np.lexsort((ids, -all_scores)) if j != q][:10]
        assert i.tolist() == want and s.tolist() == all_scores[want].tolist()
    assert visited < len(queries) * (3200 // topk.BLOCK) / 2
    sample = topk.Sample(ids[::4], x[::4])
    assert len(set(sample.home(ids, x, 8).tolist())) == 8
    far = np.flatnonzero(sample.home(ids, x, 8) == sample.home(ids[:1], x[:1], 8)[0])  # a group that holds few queries' neighbours
    floors = sample.floors(queries, x[queries], 10)
    scored = topk.search(x[queries], queries, x[far], ids[far], 10, floor=floors)[2]
    assert (floors <= score[:, 9]).all() and scored < topk.search(x[queries], queries, x[far], ids[far], 10)[2] / 2


def test_toxicity_on_held_out_rows():
    r = random.Random(9)
    import pyarrow as pa

    texts, labels = [], []
    for i in range(1500):
        w = [word(r) for _ in range(80)]
        toxic, junk = i % 6 == 0, i % 7 == 0
        if toxic:
            w.insert(r.randrange(80), r.choice(["vileun", "vilean", "nasty", "rotten"]) + r.choice(["", ".", ","]))
        if junk:
            w = [x + "%%" for x in w]
        texts.append(" ".join(w))
        labels.append((float(junk), float(toxic)))
    doc, feature = toxicity.features(pa.array(texts))
    y = np.array(labels)
    seen = doc < 1000
    models = toxicity.fit_chain(doc[seen], feature[seen], y[:1000])
    assert len(models[1].chain) == 1
    p = toxicity.predict(models, doc[~seen] - 1000, feature[~seen], 500)
    assert ((p > 0.5) == (y[1000:] > 0.5)).mean() > 0.99


def test_the_chain_learns_from_rows_its_inputs_did_not_see(monkeypatch):
    r = np.random.default_rng(1)
    n, doc, feature = 200, [], []
    for i in range(n):
        for f in r.choice(50, 8, replace=False):
            doc.append(i)
            feature.append(int(f))
    doc, feature = np.array(doc), np.array(feature)
    labels = (r.random((n, 2)) < 0.3).astype(float)
    labels[::17, 0] = np.nan  # no label of the first category
    calls, fit = [], toxicity.fit
    marked = np.concatenate([feature, 1000 + np.arange(n)])  # a feature of its own tells each row
    rows = np.concatenate([doc, np.arange(n)])

    def watched(doc, feature, chain, y, **kw):
        model = fit(doc, feature, chain, y, **kw)
        calls.append((set(feature[feature >= 1000] - 1000), chain, model))
        return model

    monkeypatch.setattr(toxicity, "fit", watched)
    toxicity.fit_chain(rows, marked, labels, folds=4)
    known = {i for i in range(n) if i % 17}
    whole, *folds, second = calls
    assert whole[0] == known and len(folds) == 4 and second[0] == set(range(n))
    for f, (seen, _, model) in enumerate(folds):  # a fold's model saw none of it, and gave the second model's inputs there
        mine = [i for i in range(n) if i % 4 == f]
        assert seen == known - set(mine)
        want = 1 / (1 + np.exp(-np.clip(model.logit(rows, marked, np.zeros((n, 0))), -15, 15)))
        assert np.allclose(second[1][mine, 0], want[mine])
    assert np.ptp(second[1]) > 0


def test_labels_that_disagree_or_lack_a_category(spark):
    docs = spark.createDataFrame([(i, "vile words here" if i % 2 else "kind words there") for i in range(200)], DOCS)
    labels = [(i, None, i % 2) for i in range(200)] + [(1, None, 0), (3, None, None)]
    models = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = toxicity.score(docs, models).collect()
    assert all((x.p_toxic > 0.5) == bool(x.doc_id % 2) for x in got)


def test_pipeline_against_brute_force(spark, tmp_path):
    r = random.Random(4)
    good = [" ".join(word(r) for _ in range(70)) for _ in range(40)]
    passage = " ".join(word(r) for _ in range(45))
    texts = good + [good[0] + " end", good[1], "too short", *(f"{' '.join(word(r) for _ in range(60))} {passage} {word(r)}" for _ in range(3)), None]
    texts = [t if t is None or i % 2 else f"Shared banner line\n{t}" for i, t in enumerate(texts)]
    rows = [(i, t, "en", f"s{i % 25}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    now = {i: t for i, t, *_ in rows if len(brute.WORDS(t or "")) >= 50}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "line_dedup":
            now = dict(zip(now, brute.boilerplate([(t, f"s{i % 25}") for i, t in now.items()], 10), strict=True))
        elif name == "near_duplicates":
            now = {i: now[i] for i, (_, c) in brute.components(now).items() if i == c}
        elif name == "substring_dedup":
            now = {i: k if n else now[i] for i, (_, n, k) in zip(now, brute.repeats(list(now.values())), strict=True)}
        assert {x.doc_id: x.text for x in docs.collect()} == now, name
        assert all(x.n_chars == len(x.text) for x in docs.collect())
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {x.doc_id for x in out.select("doc_id").distinct().collect()} == set(now)


def test_queries_and_sql(spark, sf_dir):
    import __spark_entry__

    from docflow.llm import queries

    assert {f"op{i}" for i in range(1, 11)} == {q.split("_")[0] for q in queries.queries() if q.startswith("op")}
    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert "pipeline" in __spark_entry__.queries()
    out = queries.queries()["op6_quality_rules"](spark, sf_dir)
    assert out.filter(F.col("base_failed") & F.col("kept")).count() == 0
