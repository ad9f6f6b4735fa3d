"""Every operator and stage on nulls, empty and long texts, repeated rows, empty tables and clashing names."""

import pytest
from pyspark.sql import functions as F

from docflow.llm import dpbpe, heapbpe, jaccard, lines, lm, packing, pipeline, quality, substring, topk, toxicity

from .brute import WORDS, boilerplate, components, repeats
from .brute import quality as brute_quality

tokenizers = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label long, row_key long, keys string, rest string, pos string, n_words long"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
REPEAT = " ".join(f"p{i}" for i in range(60))
TEXTS = [
    (1, "a b c d e f"),
    (2, "a b c d e f"),
    (2, "a b c d e f"),  # a repeated row
    (3, None),
    (4, ""),
    (5, " \t\n "),
    (6, LONG),
    (7, LONG + " x"),
    (8, "x " + REPEAT + " y"),
    (9, REPEAT + "\nz\r\n\x0b end"),
    (10, "Ein Wort \x85 　  "),
    (11, "\U0001f600 日本 é İ \x00"),
    (None, "no id here"),
    (12, "One two"),
    (13, "ONE TWO"),
]
ROWS = [(i, t, None, None if k % 5 == 4 else f"s{k % 3}", None, k, 1, "k", "r", "p", 9) for k, (i, t) in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_jaccard(docs, empty):
    out = jaccard.jaccard_components(docs)
    want = components({i: t for i, t in TEXTS if i is not None})
    expected = [(i, *want[i]) for i, _ in TEXTS if i is not None] + [(None, 1, None)]
    assert rows(out, "doc_id", "n_shingles", "component_id") == sorted(expected, key=repr)
    assert jaccard.jaccard_components(empty).collect() == []


def test_substring(docs, empty):
    out = substring.remove_repeats(docs, carry=["rest", "label"])
    assert sorted((r.rest.label, r.n_words, r.n_removed, r.kept_text) for r in out.collect()) == [(k, *x) for k, x in enumerate(repeats([t for _, t in TEXTS]))]
    assert substring.remove_repeats(empty).collect() == []


def test_removed_intervals_are_maximal(docs):
    for r in substring.remove_repeats(docs).collect():
        assert sum(x.end - x.start for x in r.removed) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.removed, r.removed[1:], strict=False))


def test_lm(docs, empty):
    got = lm.score_texts(docs).collect()
    assert len(got) == len(TEXTS)
    assert all(r.score <= 0 and r.base_score < 0 for r in got)
    assert sorted(r.n_tokens for r in got) == sorted(len(WORDS(t or "")) + 1 for _, t in TEXTS)
    assert lm.score_texts(empty).collect() == []


def test_lm_with_nothing_to_learn_from(spark):
    out = lm.score_texts(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), folds=1, held_out=0).collect()
    assert out[0].train_tokens == 0 and out[0].n_known == 0 and out[0].score == 0


def test_quality(docs, empty):
    out = quality.ledger(docs, keep=["label", "rest"])
    got = {r.rest.label: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out.collect()}
    assert got == {k: brute_quality(t) for k, (_, t) in enumerate(TEXTS)}
    assert quality.ledger(empty).collect() == []
    assert {tuple(r)[1:] for r in quality.ablation(quality.ledger(empty)).collect()} == {(0, 0)}


def test_lines(docs, empty):
    got = {r.rest.label: r.kept_text for r in lines.remove_boilerplate(docs, min_sites=2, carry=["label"]).collect()}
    want = boilerplate([(r[1], r[3]) for r in ROWS], 2)
    assert got == dict(enumerate(want))
    assert lines.remove_boilerplate(empty).collect() == []


def test_packing(docs, empty):
    path = tokenizers.path("word_bpe_49k.json")
    out = packing.pack_texts(docs, path, size=64)
    total = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r.n == r.end and r.n <= 64 and (r.n & (r.n - 1)) == 0 for r in total)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {i for i, _ in TEXTS}
    assert packing.pack_texts(empty, path).collect() == []


def test_token_counts(docs, empty):
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted(((i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in TEXTS), key=repr)
    assert rows(heapbpe.count_tokens(docs, path), "doc_id", "n_bytes", "n_tokens") == want
    assert heapbpe.count_tokens(empty, path).collect() == []


def test_codec(docs, empty):
    path = tokenizers.path("byte_bpe_50k.json")
    out = dpbpe.decode_ids(dpbpe.encode_texts(docs, path), path)
    assert rows(out, "doc_id", "decoded") == sorted(((i, t or "") for i, t in TEXTS), key=repr)
    assert dpbpe.encode_texts(empty, path).collect() == []


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0, "x"), (6, 0, 1, "y"), (None, 1, 1, "z"), (2, None, None, "q"), (99, 1, 1, "r")], "doc_id long, quality int, toxic int, text string")
    out = toxicity.classify(docs, labels).collect()
    assert len(out) == len(TEXTS) and all(0 <= r.p_toxic <= 1 for r in out)
    none = toxicity.classify(docs, labels.limit(0)).collect()
    assert not any(r.is_toxic for r in none)
    assert toxicity.classify(empty, labels).collect() == []


VECTORS = [
    (0, [1.0, 2.0], "a"),
    (100, [0.5, -1.0], "b"),
    (100, [0.5, -1.0], "b"),
    (1, [1.0, 2.0], "c"),
    (2, [1.0, 2.0], "d"),
    (3, None, "e"),
    (4, [], "f"),
    (5, [None, 1.0], "g"),
    (6, [float("nan"), 1.0], "h"),
    (7, [float("inf"), 1.0], "i"),
    (8, [1.0, 2.0, 3.0], "j"),
    (None, [1.0, 1.0], "k"),
]


def test_topk(spark):
    table = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>, dim string")
    got = rows(topk.top_k(table), "query_id", "rank", "vec_id", "score")
    q = lambda *x: [int(1024 * v) for v in x]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    one, two = q(1.0, 2.0), q(0.5, -1.0)
    want = [(0, 1, 1, dot(one, one)), (0, 2, 2, dot(one, one)), (0, 3, 100, dot(one, two)), (0, 4, 100, dot(one, two))]
    want += [(100, 1, 0, dot(two, one)), (100, 2, 1, dot(two, one)), (100, 3, 2, dot(two, one))]
    assert got == sorted(want, key=repr)
    assert topk.top_k(table.limit(0)).collect() == []


def test_topk_query_of_a_repeated_id(spark):
    table = spark.createDataFrame([(100, [2.0, 0.0]), (100, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert rows(topk.top_k(table), "query_id", "rank", "vec_id", "score") == [(100, 1, 1, 1024 * 1024)]


def judged(name):
    """label -> text of the rows that a stage keeps, by brute force."""
    texts = [t for _, t in TEXTS]
    keep = range(len(TEXTS))
    if name == "quality_rules":
        measured = [brute_quality(t) for t in texts]
        keep = [k for k, (n, chars, symbols, dup, again) in enumerate(measured) if n >= 50 and 2 * again <= n and 10 * symbols <= 3 * n and 2 * n <= chars <= 25 * n]
    elif name == "near_duplicates":
        keep = [0, 3, 4, 5, 6, 8, 10, 11, 12, 13]  # one row of each group, wordless texts each
    elif name == "substring_dedup":
        texts = [k if n else t for t, (_, n, k) in zip(texts, repeats(texts), strict=True)]
        keep = [k for k in keep if WORDS(texts[k] or "")]
    else:
        keep = [k for k in keep if WORDS(texts[k] or "")]
    return {k: texts[k] for k in keep}


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES[:-1]])
def test_stages(spark, docs, empty, name):
    stage = dict(pipeline.STAGES)[name]
    out = stage(spark, docs, "")
    assert out.columns == docs.columns
    assert {r.label: r.text for r in out.collect()} == judged(name)
    kept = [c for c in docs.columns if c not in ("text", "n_chars")]
    before = {r.label: tuple(r[c] for c in kept) for r in docs.collect()}
    assert all(tuple(r[c] for c in kept) == before[r.label] for r in out.collect())  # other columns pass through
    assert stage(spark, empty, "").collect() == []


def test_near_duplicates_keep_one_of_each_group(spark, docs):
    got = {r.doc_id for r in dict(pipeline.STAGES)["near_duplicates"](spark, docs, "").collect()}
    assert got == {1, 3, 4, 5, 6, 8, 10, 11, 12, None}  # 2 repeats 1, 7 is near 6, 9 near 8, 13 is 12 in capitals


def test_near_duplicates_keep_one_row_of_each_group(spark):
    a, b, c, e, f = (" ".join(f"{x}{j}" for j in range(50)) for x in "abcef")
    rows = [(1, a, "s"), (1, a, "s"), (2, b, "s"), (3, b, "s"), (3, c, "s"), (4, None, "s"), (5, "", None)]  # 1 is repeated; one row of 3 is a copy of 2
    rows += [(None, a, "s"), (None, e, "s"), (None, e, "t"), (None, e + " x", None), (None, f, "s")]  # without ids: a copy of 1, a group, and one alone
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    stages = dict(pipeline.STAGES)
    out = stages["near_duplicates"](spark, docs, "")
    got = [(r.doc_id, (r.text or "").removesuffix(" x")) for r in out.collect()]
    assert sorted(got, key=repr) == sorted([(1, a), (2, b), (3, c), (4, ""), (5, ""), (None, e), (None, f)], key=repr)
    assert stages["substring_dedup"](spark, out, "").count() == 5  # all but those without words


def test_a_document_copied_over_many_sources_is_kept_once(spark):
    texts = [f"banner on all sites\n{' '.join(f'd{i}x{j}' for j in range(60))}\nlast line of {i}" for i in range(12)]
    rows = [(100 * i + k, t + "\n" * (k % 2), f"s{(i + k) % 15}") for i, t in enumerate(texts) for k in range(15 if i == 0 else 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    stages = dict(pipeline.STAGES)
    lined = stages["line_dedup"](spark, docs, "")
    assert lined.count() == len(rows)
    got = {r.doc_id: r.text for r in stages["near_duplicates"](spark, lined, "").collect()}
    assert got == {100 * i: t.split("\n", 1)[1] for i, t in enumerate(texts)}


def test_last_stage(spark, docs, empty):
    stage = pipeline.STAGES[-1][1]
    rows_of = {}
    for r in stage(spark, docs, "").collect():
        rows_of.setdefault(r.doc_id, []).append(r)
    for i, t in TEXTS:  # every row's ids lie in its pieces, without gap or overlap; repeated rows and null ids each for itself
        mine = [r for r in rows_of[i] if r.doc_tokens == next(x.doc_tokens for x in rows_of[i])]
        assert sum(r.length for r in mine) == mine[0].doc_tokens * sum(1 for j, _ in TEXTS if j == i)
        assert (mine[0].doc_tokens == 1) == (not (t or "").strip())
    assert stage(spark, empty, "").collect() == []
