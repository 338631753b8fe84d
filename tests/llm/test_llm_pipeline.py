"""The pipeline, stage by stage against plain Python, and the registered queries."""

import re
from collections import Counter

import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from barloom.llm import mixing, quality, sentence_pieces
from barloom.llm.queries import BLOCK_CHARS, ORACLES, OTHER_WEIGHT, QUERIES, WEIGHTS, documents
from tests.compare import difference, duck

SF = "/root/testdata/sf0.001"


def _fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _near(rows, width, percent):
    """The smallest id of each component."""
    sets = []
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", _fold(r.text))
        sets.append({tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    best = {}
    for r, g in zip(rows, group):
        best[g] = min(best.get(g, r.doc_id), r.doc_id)
    return set(best.values())


def test_every_stage_equals_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # A near copy, exact copies in other case, an empty text and a null one.
    extra = docs.where("length(text) > 3000").limit(1).select(
        F.explode(F.array(*[F.lit(n).cast("long") for n in (90_001, 90_002, 90_003)])).alias("doc_id"), "text", "lang", "source", "n_chars").withColumn(
        "text", F.when(F.col("doc_id") == 90_001, F.concat("text", F.lit(" one more word"))).when(F.col("doc_id") == 90_002, F.upper("text")).otherwise(F.col("text")))
    odd = spark.createDataFrame([(90_004, "", None, None, None), (90_005, None, "en", "src0", 0), (None, "a text without an id. It has words.", None, None, None)], docs.schema)
    held = docs.union(extra).union(odd)
    columns = docs.columns
    results = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, held, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        held = spark.read.parquet(str(tmp_path / name))
        results.append(held)
    good, unique, apart, ordered, encoded = results

    before = docs.union(extra).union(odd).collect()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    ranking = quality.fit(docs.union(extra).union(odd), labels)
    scores = quality.classify(docs.union(extra).union(odd), ranking).where("predicted = 1").collect()
    assert Counter(r.doc_id for r in good.collect()) == Counter(r.doc_id for r in scores)
    assert set(good.collect()) <= set(before)

    groups = {}
    for r in good.collect():
        groups.setdefault(_fold(r.text), []).append(-1 if r.doc_id is None else r.doc_id)
    assert sorted(max(v) for v in groups.values()) == sorted(-1 if r.doc_id is None else r.doc_id for r in unique.collect())

    rows = [r for r in unique.collect() if r.doc_id is not None]
    assert {r.doc_id for r in apart.collect()} - {None} == _near(rows, 5, 80)
    assert Counter(ordered.collect()) == Counter(apart.collect())

    other = sentencepiece.SentencePieceProcessor(model_proto=sentence_pieces.load(sentence_pieces.MODEL))
    texts = {r.doc_id: r.text for r in ordered.collect()}
    found = encoded.collect()
    assert len(found) == len(texts)
    assert all(r.parity and r.token_ids == other.encode(texts[r.doc_id] or "") for r in found)


def test_pipeline_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        docs = out if name != "sentence_pieces" else docs


def test_queries_are_registered_and_equal_their_sql(spark):
    names = queries()
    assert set(QUERIES) <= set(names) and "pipeline" in names
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLES) <= set(oracle_sql())
    con = duck(SF)
    for name, sql in ORACLES.items():
        assert difference(QUERIES[name](spark, SF), con, sql) is None, name


def test_run_gives_the_last_stage(spark):
    found = corpus_pipeline.run(spark, SF)
    assert "token_ids" in found.columns and found.where("NOT parity OR NOT round_trip").count() == 0 and found.count() > 0


def test_encoded_rows_keep_the_order_of_the_mix(spark, tmp_path):
    docs = documents(spark, SF)
    wanted = mixing.interleave(docs, WEIGHTS, OTHER_WEIGHT, BLOCK_CHARS).orderBy("slot", "at").select("row.doc_id").collect()
    stages, kept = dict(corpus_pipeline.STAGES), {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        # Several files of unlike length, which the reader packs by size.
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        stages["source_mixing"](spark, docs, SF).write.option("maxRecordsPerFile", 9).parquet(str(tmp_path / "mix"))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    written = spark.read.parquet(str(tmp_path / "mix"))
    encoded = stages["sentence_pieces"](spark, written, SF)
    assert [r.doc_id for r in encoded.orderBy("place").collect()] == [r.doc_id for r in wanted]
    assert [r.doc_id for r in stages["sentence_pieces"](spark, stages["source_mixing"](spark, docs, SF), SF).orderBy("place").collect()] == [
        r.doc_id for r in wanted]
