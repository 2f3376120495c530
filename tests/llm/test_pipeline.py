from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pointloom.llm import queries
from tests.llm import cases

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == list(corpus_pipeline.COLUMNS), name
        assert out.dtypes == spark.read.parquet(f"{SF}/documents.parquet").dtypes, name
        assert {r[0] for r in out.select("doc_id").collect()} <= ids, name


def test_repeated_passages_are_cut_once(spark):
    docs = cases.documents(spark).select(*corpus_pipeline.COLUMNS)
    got = {r["doc_id"]: r for r in corpus_pipeline.repeated_passages(spark, docs, SF).collect()}
    line = cases.texts()[5]
    assert line in got[5]["text"] and all(line not in (r["text"] or "") for i, r in got.items() if i != 5)
    assert 6 not in got and got[4]["text"] == cases.texts()[4]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def _odd(spark):
    """Nulls in every column, empty and equal texts, repeated rows, equal ids."""
    docs = cases.documents(spark).select(*corpus_pipeline.COLUMNS)
    more = [(None, None, None, None, None), (None, "plain words without id stand here", None, None, 3), (5, cases.texts()[5], "en", "s", 1), (7, None, "de", None, None)]
    return docs.unionByName(spark.createDataFrame(more, docs.schema))


def test_language_stage(spark):
    from pointloom.llm import langid

    docs = _odd(spark).withColumn("extra", F.lit(1))
    model = langid.train(docs.where(~langid.held_out()))
    want = []
    for r in docs.collect():
        lang, score = model.predict(r["text"])
        if lang != "und" and score >= corpus_pipeline.LEAST_SCORE:
            want.append((r["doc_id"], r["text"], r["lang"] or lang, r["source"], r["n_chars"]))
    got = [tuple(r) for r in corpus_pipeline.language(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_language_stage_without_labels_keeps_what_has_letters(spark):
    docs = _odd(spark).withColumn("lang", F.lit(None).cast("string"))
    got = Counter(r["text"] for r in corpus_pipeline.language(spark, docs, SF).collect())
    assert got == Counter(r["text"] for r in docs.collect() if r["text"] and any(c.isalpha() for c in r["text"]))


def test_near_duplicate_stage(spark):
    from pointloom.llm import simhash

    docs = _odd(spark)
    rows = sorted((tuple(r) for r in docs.collect()), key=lambda r: (r[0] is None, r[0], str(r)))
    sets = [set(simhash.shingle_hashes((r[1] or "").encode(), 5).tolist()) for r in rows]
    root = cases.groups(len(rows), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    at = {}
    for i, r in enumerate(rows):
        at.setdefault(r, root[i])
    assert len(got) == len(set(root)) and {at[r] for r in got} == set(root)
    assert sorted((r[0] for r in got), key=str) == sorted((rows[i][0] for i in set(root)), key=str)


def test_decontamination_stage(spark, tmp_path):
    items = [("a", cases.texts()[5]), (None, cases.texts()[8]), ("b", None), ("c", "")]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = _odd(spark)
    found = cases.contamination([(i, r["text"]) for i, r in enumerate(docs.collect())], items)
    want = [tuple(r) for i, r in enumerate(docs.collect()) if not found[i][1]]
    got = [tuple(r) for r in corpus_pipeline.decontaminated(spark, docs, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and 0 < len(want) < docs.count()


def test_packing_stage(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = _odd(spark)
    want = []
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        want += [(r["doc_id"], a // 4096, a, len(ids[a : a + 4096]), cases.crc(ids[a : a + 4096])) for a in range(0, len(ids), 4096)]
    got = corpus_pipeline.packed(spark, docs, SF).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    used = Counter()
    for r in got:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 4096 and len(used) == -(-sum(used.values()) // 4096)


def test_whole_characters():
    raw = "aé🙂b".encode()
    assert corpus_pipeline.whole_characters(raw, [{"start": 2, "end": 5}]) == []
    assert corpus_pipeline.whole_characters(raw, [{"start": 1, "end": 6}]) == [{"start": 1, "end": 3}]


def test_empty_tables(spark):
    docs = cases.empty(spark).select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    for t in ("documents", "conversations", "embeddings", "pages", "benchmark"):
        duckdb.sql(f"create or replace view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF).toPandas()
    want = duckdb.sql(queries.oracle_sql()[name]).df()[list(got.columns)]
    keys = list(got.columns)
    assert got.sort_values(keys).reset_index(drop=True).equals(want.sort_values(keys).reset_index(drop=True))
