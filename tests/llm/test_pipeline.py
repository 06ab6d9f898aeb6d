"""The pipeline's stages against direct computation on a small corpus."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from listings_spark.llm import secrets
from listings_spark.llm.common import shared_folder, stored

DDL = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    rng = random.Random(41)
    vocabulary = [f"v{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(2000)]
    docs, labels, toxic, copies = [], [], set(), {}
    for i in range(0, 1200, 4):
        text = rng.choices(vocabulary, k=150)
        if rng.random() < 0.15:
            text.insert(60, rng.choice(["wretchedly", "wretched"]))
            toxic.add(i)
        secret = " password=Abcdef123456" if i % 40 == 0 else ""
        docs.append((i, " ".join(text) + secret))
        labels.append((i, 1, int(i in toxic)))
        if i % 12 == 0:
            text[100] = "edited"
            docs.append((i + 1, " ".join(text) + secret))
            docs.append((i + 2, docs[-2][1]))
            copies |= {i + 1: i, i + 2: i}
    first = dict(reversed(docs))
    docs += [(5001, ""), (5002, None), (5003, ""), (4, first[4])]  # empty texts, and a repeated row
    rows = [(i, t, "en", rng.choice(["a", "b", None]), len(t or "")) for i, t in docs]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, DDL).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, toxic, copies


def test_stages(spark, corpus, monkeypatch):
    folder, rows, toxic, copies = corpus
    given = spark.read.parquet(f"{folder}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, given, folder)
        if name != "packing":
            assert made.columns == given.columns
        made = stored(made, "test")
        out[name], given = made.collect(), made

    root = lambda i: copies.get(i, i)
    clean = [r for r in rows if root(r[0]) not in toxic]
    assert Counter(tuple(r) for r in out["toxicity"]) == Counter(clean)

    ids = Counter(r["doc_id"] for r in out["near_copies"])
    assert not set(ids) & set(copies)
    assert len({5001, 5002, 5003} & set(ids)) == 1
    assert ids[4] == 1 or 4 in toxic  # a wholly repeated row
    expected = {root(r[0]) for r in clean} - {5001, 5002, 5003}
    assert set(ids) - {5001, 5002, 5003} == expected

    assert len(out["secrets"]) == len(out["near_copies"])
    assert not any(secrets.base_spans(r["text"] or "") for r in out["secrets"])
    assert any("[removed]" in (r["text"] or "") for r in out["secrets"])

    times = Counter(r["doc_id"] for r in out["mixing"])
    assert set(times) <= set(ids) and max(times.values()) <= 3
    assert {tuple(r) for r in out["mixing"]} <= {tuple(r) for r in out["secrets"]}
    packed = Counter(r["doc_id"] for r in out["packing"])
    assert packed == times
    assert len({(r["bucket"], r["batch"], r["slot"]) for r in out["packing"]}) == len(out["packing"])


def test_run_agrees_with_the_stages(spark, corpus):
    folder, rows, toxic, copies = corpus
    got = corpus_pipeline.run(spark, folder).collect()
    assert got and not {r["doc_id"] for r in got} & (toxic | set(copies))


def test_stages_on_no_documents(spark, corpus):
    none = spark.createDataFrame([], DDL)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, corpus[0]).collect() == []


def test_any_column_names(spark, corpus):
    """Columns named like the stages' own pass through every stage."""
    names = ["row", "row_key", "times", "alike", "planned", "node", "print", "value", "size", "odds", "_times", "_kept"]
    rows = [(90_000 + i, f"text {i % 3} of some words", "en", "a", 5, *[f"{n}{i}" for n in names]) for i in range(6)]
    given = spark.createDataFrame(rows, DDL + "".join(f", {n} string" for n in names))
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, given, corpus[0])
        if name != "packing":
            assert made.columns == given.columns
            assert {tuple(r) for r in made.collect()} <= set(rows)
        given = stored(made, "test")
    assert given.count() > 0


def test_mixing_tells_rows_of_two_sources_apart(spark, corpus):
    """Rows alike in id and text but of different sources are never taken for one another."""
    text = " ".join(f"w{i}" for i in range(120))
    rows = [(i, f"{text} {i}", "en", s, 1) for i in range(4) for s in ("a", "b")] + [(9, text, "en", "b", 1)]
    given = spark.createDataFrame(rows, DDL)
    mixed = corpus_pipeline.mix_sources(spark, given, corpus[0]).collect()
    sizes = {s: sum(len(r[1].split()) for r in rows if r[3] == s) for s in "ab"}
    words = Counter()
    for r in mixed:
        words[r["source"]] += len(r["text"].split())
    all_ = sum(sizes.values())
    targets = {"a": min(3 * sizes["a"], all_ * 5 / 7), "b": all_ * 2 / 7}
    assert all(abs(words[s] - targets[s]) <= 121 for s in "ab")


def test_no_labels(spark, corpus, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    given = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    assert corpus_pipeline.reject_toxic(spark, given, str(tmp_path)).count() == given.count()


def test_a_very_long_text_passes_every_stage(spark, corpus):
    text = " ".join(f"w{i % 4999}q{i // 7}" for i in range(110_000))
    given = spark.createDataFrame([(1, text, "en", "a", len(text)), (2, "short text", "en", "a", 10)], DDL)
    for _, stage in corpus_pipeline.STAGES:
        given = stored(stage(spark, given, corpus[0]), "test")
    assert given.filter("doc_id = 1").count() >= 1


def test_stages_leave_no_tables_but_their_decisions(spark, corpus):
    given = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = lambda: {s.getPath().getName() for s in files.listStatus(path)}
    before = names()
    for stage in (corpus_pipeline.drop_near_copies, corpus_pipeline.mix_sources, corpus_pipeline.pack_batches):
        stage(spark, given, corpus[0]).count()
    assert sorted(n.partition("-")[0] for n in names() - before) == ["kept", "packed", "taken"]


def test_stages_on_null_and_repeated_rows(spark, corpus):
    """Rows without id, text or source pass every stage; wholly repeated rows count once as copies."""
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(None, text, None, None, None), (None, text, None, None, None), (None, None, "en", "a", 0)]
    rows += [(7, "some other text of six words", "en", None, None)] * 3 + [(7, "a different row", "en", "a", 1)]
    given = spark.createDataFrame(rows, DDL)
    kept = corpus_pipeline.drop_near_copies(spark, given, corpus[0]).collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == {
        (None, text): 1, (None, None): 1, (7, rows[3][1]): 1, (7, "a different row"): 1
    }
    mixed = corpus_pipeline.mix_sources(spark, given, corpus[0]).collect()
    assert mixed and {tuple(r) for r in mixed} <= set(rows)
    assert max(Counter(tuple(r) for r in mixed).values()) <= 3 * 3
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, given, corpus[0])
        given = spark.createDataFrame(made.collect(), made.schema)
    assert given.count() > 0
