"""Each stage takes effect on what the one before it kept."""

import corpus_pipeline as C
import pytest
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = [docs]
    for i, (_, stage) in enumerate(C.STAGES):
        stage(spark, kept[-1], DIR).write.parquet(f"{tmp_path}/{i}")
        kept.append(spark.read.parquet(f"{tmp_path}/{i}"))
    assert all(d.columns == docs.columns for d in kept[:-1])
    counts = [d.count() for d in kept[:-1]]
    assert counts[0] > counts[1] == counts[2] > counts[3] == counts[4] > 0
    from filingspark.llm import line_dedup, simhash

    assert line_dedup.later_matches(kept[1]).count() > 0
    assert simhash.near_duplicates(kept[3]).where("doc_id <> component_id").count() == 0
    assert kept[4].where(r"text rlike '[A-Za-z0-9]@[a-z0-9]+[.]'").count() == 0
    assert {r.doc_id for r in kept[5].select("doc_id").collect()} == {r.doc_id for r in kept[4].select("doc_id").collect()}


@pytest.mark.parametrize("rows", ["none", "odd"])
def test_stages_on_empty_and_odd_tables(spark, rows):
    """Nulls in any column, repeated rows and ids, and empty texts pass all stages; nothing crashes."""
    schema = spark.read.parquet(f"{DIR}/documents.parquet").schema
    text = "This is a plain sentence about rivers and the towns beside them."
    odd = [(1, text, None, None, None), (1, text, None, None, None), (1, text + " Another end.", "en", "s", 3), (None, text, "en", "s", 3), (2, None, None, "s", None), (3, "", "en", None, 0), (4, " \n\t", "en", "s", 1)]
    order = ("doc_id", "text", "lang", "source", "n_chars")
    docs = spark.createDataFrame([tuple(dict(zip(order, r)).get(f.name) for f in schema) for r in ([] if rows == "none" else odd)], schema)
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), schema)
    packed = C.STAGES[-1][1](spark, docs, DIR)
    assert packed.count() == (0 if rows == "none" else packed.count()) and packed.columns[0] == "doc_id"


def test_near_copies_go_by_their_whole_texts(spark, tmp_path):
    """After line dedup a near copy has only its own lines left; it goes with them. What isn't one stays, and so does a text that the table doesn't have."""
    line = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    body = [line(i, 30) for i in range(6)]
    texts = ["\n".join(body), "\n".join([*body, line(50, 8)]), "\n".join([*body[:2], *(line(i, 30) for i in range(60, 64))]), None, "\n".join(body)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    left = C.drop_repeated_lines(spark, docs, str(tmp_path))
    left = spark.createDataFrame(left.collect(), left.schema)
    assert line(50, 8) in [r.text for r in left.collect()]
    kept = C.drop_near_copies(spark, left, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in kept) == [0, 2, 3]
    other = spark.createDataFrame([(0, texts[0], "en", "s", 1), (1, "quite another text than the one there", "en", "s", 1)], docs.schema)
    assert C.drop_near_copies(spark, other, str(tmp_path)).count() == 2


def test_near_copies_go_by_their_whole_texts_where_doc_ids_repeat(spark, tmp_path):
    """Each text of a doc_id is compared, as a copy and as an original; one that came no further is no original."""
    line = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    body, other, third, bad = ([line(i, 30) for i in range(s, s + 6)] for s in (0, 10, 20, 30))
    texts = {
        (0, "first"): body,
        (1, "copy"): [*body, line(50, 8)],
        (1, "apart"): other,
        (2, "copy"): [*other, line(51, 8)],
        (3, "one"): third,
        (3, "two"): [*third, line(52, 8)],
        (4, "rejected"): bad,
        (4, "kept"): [line(60, 20)],
        (5, "stays"): [*bad, line(53, 8)],
    }
    rows = [(i, "\n".join(t), "en", s, 1) for (i, s), t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    left = C.drop_repeated_lines(spark, docs.where("source <> 'rejected'"), str(tmp_path))
    left = spark.createDataFrame(left.collect(), left.schema)
    kept = C.drop_near_copies(spark, left, str(tmp_path)).collect()
    found = {(r.doc_id, r.source) for r in kept}
    assert len(kept) == 5 and found - {(3, "one"), (3, "two")} == {(0, "first"), (1, "apart"), (4, "kept"), (5, "stays")}
    table = [(0, "\n".join(body), "en", "s", 1), (1, "\n".join([*body, line(50, 8)]), "en", "s", 1)]
    spark.createDataFrame(table, docs.schema).write.parquet(f"{tmp_path}/two/documents.parquet")
    for first, n in ((line(70, 30), 2), (body[0], 1)):  # what stands under an original's doc_id must be made of it
        here = spark.createDataFrame([(0, first, "en", "s", 1), (1, line(50, 8), "en", "s", 1)], docs.schema)
        assert C.drop_near_copies(spark, here, f"{tmp_path}/two").count() == n


def test_packing_leaves_idle_workers_small(spark):
    """Idle Python workers count for their executor while other stages run: after packing they keep no words of texts. The rows are those of larger workers."""
    from filingspark.llm import packing, words
    from filingspark.llm.registry import vocabulary

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    path = vocabulary("word_bpe_49k.json")

    def kept(batches):
        import pyarrow as pa

        for _ in batches:
            found = [len(r) + len(r.old) for t in words._TABLES.values() for r in (t.words, t.pieces)]
            yield pa.RecordBatch.from_arrays([pa.array([sum(found)], pa.int64())], ["n"])

    wanted = ["doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"]
    large = sorted(map(tuple, packing.pack(docs, path).select(*wanted).collect()))
    assert sorted(map(tuple, C.pack_sequences(spark, docs, DIR).collect())) == large
    C.pack_sequences(spark, docs.repartition(16), DIR).count()  # every worker has packed once since
    assert spark.range(16, numPartitions=16).mapInArrow(kept, "n long").agg(F.max("n")).first()[0] == 0


def test_slices_hold_all_rows_in_order():
    import pyarrow as pa
    from filingspark.llm._util import in_slices

    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, b), pa.int64())], ["i"]) for a, b in ((0, 7), (7, 7), (7, 10), (10, 11))]
    for rows in (1, 3, 7, 100):
        out = list(in_slices(lambda it: it, rows)(iter(batches)))
        assert [i for b in out for i in b.column(0).to_pylist()] == list(range(11)) and max(map(len, out)) <= rows
    assert list(in_slices(lambda it: it)(iter([]))) == []
