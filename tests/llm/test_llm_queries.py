"""The registered queries over whole tables: against SQL, and against plain statements of their contracts."""

import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as vocab
import pytest

import corpus_pipeline
from quietspan.llm import bpe, queries, secrets, toxicity
from tests.llm.test_pair_ops import brute_classes, brute_repeats
from tests.llm.test_rows_ops import brute_base, brute_cost, greedy_counts

RANKS = vocab.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def texts(sf_dir):
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=vocab.PATTERN, mergeable_ranks=dict(bpe.load_ranks(RANKS)), special_tokens={})


def rows(spark, sf_dir, name):
    return queries.QUERIES[name](spark, sf_dir).collect()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, want))


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_op3(spark, sf_dir, texts):
    got = sorted(map(tuple, rows(spark, sf_dir, "op3_repeats")))
    assert [r[:5] for r in got] == brute_repeats(sorted(texts.items()), 400, "none") and all(r[5] == (r[2] > 0) for r in got)


def test_op4(spark, sf_dir, texts, encoding):
    for r in rows(spark, sf_dir, "op4_bpe"):
        ids = np.array(encoding.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_op5(spark, sf_dir, texts):
    want = brute_classes(sorted(texts.items()))
    assert {r.doc_id: r.class_id for r in rows(spark, sf_dir, "op5_neardup")} == want


def test_op7(spark, sf_dir, texts):
    assert sorted(r.doc_id for r in rows(spark, sf_dir, "op7_toxicity")) == sorted(texts)


def test_op8(spark, sf_dir, texts):
    counts = greedy_counts()
    assert {r.doc_id: (r.n_words, r.n_tokens) for r in rows(spark, sf_dir, "op8_token_counts")} == {d: counts(t) for d, t in texts.items()}


@pytest.fixture(scope="module")
def larger(sf_dir):
    """The next size: the smallest tables hold no secrets."""
    folder = sf_dir.replace("0.001", "0.01")
    return folder, dict(duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall())


def test_op9(spark, larger):
    folder, texts = larger
    found, words = 0, secrets.Words(secrets.load_words(vocab.path("word_bpe_49k.json")))
    for r in rows(spark, folder, "op9_secrets"):
        base = ",".join(f"{k}:{a}:{b}" for a, _, k, b in brute_base(texts[r.doc_id]))
        found += bool(base)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        values = {m.span(1) for m in secrets.CONTEXT.finditer(texts[r.doc_id])} | {m.span(2) for m in secrets.ASSIGN.finditer(texts[r.doc_id]) if len(m[2]) > 5}
        guessed = sorted((a, b) for a, b in values if brute_cost(texts[r.doc_id][a:b], words) >= secrets.MIN_LOG10_GUESSES)
        assert [s for s in r.spans.split(",") if s.startswith("guess")] == [f"guess:{a}:{b}" for a, b in guessed] and r.n_guess == len(guessed)
    assert found


def test_op10(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    tok, at = Tokenizer.from_file(vocab.path("word_bpe_49k.json")), 0
    got = {r.doc_id: r for r in rows(spark, sf_dir, "op10_token_files")}
    for d in sorted(texts):
        ids = np.array(tok.encode(texts[d], add_special_tokens=False).ids + [2], "<u4").tobytes()
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4


def contaminated_by(items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = {tuple(w[k : k + 10]) for _, t in items if (w := words(t)) for k in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}

    def contaminated(text):
        w = words(text)
        return any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))

    return contaminated


def test_pipeline(spark, larger, encoding):
    sf_dir, texts = larger
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    table = model.table()

    def toxic(t):
        index, values = toxicity.features(t.encode())
        return (table[index] * values).sum(dtype=np.float64) > model.threshold[0]

    contaminated = contaminated_by(duckdb.sql(f"SELECT item_id, text FROM '{sf_dir}/benchmark.parquet'").fetchall())
    left = [(d, t) for d, t in sorted(texts.items()) if not toxic(t)]
    classes = brute_classes(left)
    left = {d: t for d, t in left if classes[d] == d and not contaminated(t)}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got.keys() == left.keys() and len(got) < len(texts)
    masked = 0
    for d, r in got.items():
        text = encoding.decode_bytes(np.frombuffer(bytes(r.ids), "<u4").tolist()).decode()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.n_tokens == len(r.ids) // 4
        secret = bool(brute_base(left[d]))
        masked += secret
        assert not brute_base(text) and (not secret or "[SECRET]" in text)
        if "[SECRET]" not in text:
            assert text == left[d]
    assert masked


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0) if name == "neardup" else docs, sf_dir)
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]


def test_stages_hand_texts_over_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    apart = corpus_pipeline._apart(docs)
    assert apart.columns == ["doc_id", "text", "__doc"] and apart.schema["__doc"].dataType.names == [c for c in docs.columns if c != "text"]
    assert corpus_pipeline._rows(apart, docs).collect() == docs.collect()


def test_pipeline_awkward(spark, tmp_path):
    """Nulls, empty and repeated rows, a long text, columns named like results; then empty tables."""
    toxic, fine = "you are vile scum and trash", "a fine day to walk by the river with all my friends"
    texts = [fine + f" number {i}" for i in range(12)] + [toxic + f" {i}" for i in range(12)]
    rows = [(i, t, "x", None, i, True, "n", ["q"]) for i, t in enumerate(texts)]
    extra = [(100, None), (101, ""), (102, "!?"), (103, "password=x9K2mPq7Lw is mine"), (103, "password=x9K2mPq7Lw is mine"), (None, "no id here at all"), (104, "Lorem " * 40_000), (105, "one two three four five six seven eight nine ten eleven twelve")]
    rows += [(i, t, None, 1, 2, None, None, None) for i, t in extra]
    names = "doc_id long, text string, Toxic string, grade int, class_id long, stays boolean, n_words string, items array<string>"
    save = lambda data, schema, name, folder: spark.createDataFrame(data, schema).write.parquet(str(tmp_path / folder / f"{name}.parquet"))
    save(rows, names, "documents", "full")
    save([(i, int(i >= 12)) for i in range(24)] + [(None, 1), (100, None)], "doc_id long, toxic int", "labels", "full")
    save([(1, "Three four five, six seven eight nine TEN eleven twelve"), (None, None), (2, "")], "item_id long, text string", "benchmark", "full")
    docs = spark.read.parquet(str(tmp_path / "full" / "documents.parquet"))
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path / "full"))
        assert out.dtypes == docs.dtypes
    kept = {(r.doc_id, r.text) for r in out.collect()}
    assert {100, 101, 102, 103, 104, None} <= {i for i, _ in kept} and 105 not in {i for i, _ in kept}
    assert not any(i in range(12, 24) for i, _ in kept if i is not None) and (103, "password=x9K2mPq7Lw is mine") not in kept
    assert out.where("doc_id = 103").count() == 1 and out.where("doc_id < 12 AND (Toxic <> 'x' OR items[0] <> 'q')").isEmpty()
    got = corpus_pipeline.run(spark, str(tmp_path / "full"))
    assert got.count() == out.count() and got.where("doc_id = 100").first().n_tokens == 0
    for name, schema in (("documents", names), ("labels", "doc_id long, toxic int"), ("benchmark", "item_id long, text string")):
        save([], schema, name, "empty")
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).isEmpty()


def test_op5_recall(spark, larger):
    """Over the links that brute force finds between different texts."""
    from tests.llm.test_pair_ops import brute_links

    folder, texts = larger
    docs = sorted(texts.items())
    links = [(docs[a][0], docs[b][0]) for a, b in brute_links(docs) if docs[a][1] != docs[b][1]]
    got = {r.doc_id: r.class_id for r in rows(spark, folder, "op5_neardup")}
    assert len(links) > 5 and sum(got[a] == got[b] for a, b in links) >= 0.99 * len(links)
