"""The pipeline's stages, each held against brute force on its own input."""

import hashlib

import pytest
from test_operators import brute_components, brute_hits, brute_spans

import corpus_pipeline
from tidemark.llm import bpe, secrets, toxicity

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found, folder = [docs], tmp_path_factory.mktemp("stages")
    for i, (_, function) in enumerate(corpus_pipeline.STAGES):
        function(spark, found[-1], DATA).write.parquet(f"{folder}/{i}")
        found.append(spark.read.parquet(f"{folder}/{i}"))
    return found


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_all_but_the_last_have_the_columns_of_documents(stages):
    assert all(set(s.dtypes) == set(stages[0].dtypes) for s in stages[:-1])
    assert len(corpus_pipeline.STAGES) == 5 and stages[-1].count() == stages[-2].count()


def test_toxic_documents_go_and_the_rest_is_untouched(spark, stages):
    lexicon = toxicity.fit(stages[0], spark.read.parquet(f"{DATA}/labels.parquet"))
    matcher, before = toxicity.Matcher(lexicon), texts(stages[0])
    assert texts(stages[1]) == {i: t for i, t in before.items() if matcher.score(t or "")[0] < toxicity.THRESHOLD}
    assert len(texts(stages[1])) < len(before)


def test_first_of_each_near_duplicate_group_stays(stages):
    before = texts(stages[1])
    ids = sorted(before)
    keep = {ids[c] for _, _, c in brute_components([before[i] for i in ids])}
    assert texts(stages[2]) == {i: before[i] for i in keep} and len(keep) < len(ids)


def test_benchmark_windows_are_cut_out(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    before, after = texts(stages[2]), texts(stages[3])
    hit = {i for i, t in before.items() if brute_hits(t, items)[4]}
    assert hit and {i: t for i, t in after.items() if i not in hit} == {i: t for i, t in before.items() if i not in hit}
    assert all(len(after[i]) < len(before[i]) and not brute_hits(after[i], items)[4] for i in hit & set(after))


def test_secrets_are_replaced(stages):
    before, after = texts(stages[3]), texts(stages[4])
    scanner = secrets.Scanner(*secrets.load())
    assert {i: secrets.redact(t, scanner.spans(t)[1]) for i, t in before.items()} == after
    assert not any(brute_spans(t) for t in after.values())
    assert all(r.n_chars == len(r.text) for r in stages[4].collect())


def test_a_secret_is_replaced(spark, stages):
    docs = spark.createDataFrame([(1, "a password=b7db7aa4a5fcc78305 b", "en", "s", 31), (2, None, None, None, 0)], stages[0].schema)
    out = corpus_pipeline.redact_secrets(spark, docs, DATA).orderBy("doc_id").collect()
    assert [(r.text, r.n_chars) for r in out] == [("a [secret] b", 12), (None, 0)]


def test_ids_decode_to_the_text(stages):
    codec, before = bpe.Codec(bpe.load()), texts(stages[4])
    for r in stages[5].collect():
        assert list(r.ids) == codec.encode(before[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(codec.decode(r.ids).encode()).hexdigest()


def test_run_gives_the_same(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).select("doc_id", "ids_sha256").collect())) == sorted(
        map(tuple, stages[5].select("doc_id", "ids_sha256").collect())
    )


def test_awkward_rows_pass_every_stage(spark):
    texts = [None, None, "", "", " \n", "a", "one two three four five six", "one two three four five six", "ONE two three four five six", "word " * 30000, "é 日本 🙂 \x00 |"]
    rows = [(i if i != 7 else None, t, None, "s", len(t or ""), i, 0.5, "x", i) for i, t in enumerate(texts)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, __row int, score double, label string, key int"
    docs = spark.createDataFrame(rows, schema)
    kept = {}
    for name, function in corpus_pipeline.STAGES[:4]:
        out = function(spark, docs, DATA)
        assert out.columns == docs.columns, name
        kept[name] = sorted(r["__row"] for r in out.collect())
    assert kept.pop("n-gram Jaccard join") == [0, 1, 2, 3, 4, 5, 6, 9, 10]
    assert all(v == list(range(11)) for v in kept.values())
    assert corpus_pipeline.encode(spark, docs, DATA).count() == 11
    without = docs.drop("n_chars")
    assert corpus_pipeline.redact_secrets(spark, without, DATA).columns == without.columns


def test_empty_tables_pass_every_stage(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, docs, DATA).count() == 0
