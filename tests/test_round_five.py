"""What the fifth round's findings asked for."""

from dialoglens.operators import retrieval
from dialoglens.operators.vectors import hashed_vectors
from dialoglens.plans import queries as audit
from dialoglens.plans import recorded_queries  # noqa: F401 - registers more queries
from dialoglens.sources import call_logs
from dialoglens.sources.tables import ChunkIndex


def test_many_small_logs_are_read_by_few_tasks(spark, tmp_path, monkeypatch):
    """Spark dealt some four files to a task, whose start and own output file took most of the time."""
    for i in range(300):
        (tmp_path / f"c{i}.txt").write_text(f"[CALL_ID: {i}] [SUBSCRIBER: s]\n[-] USER: a question\n[-] BOT: an answer")
    written, real = [], call_logs.kept
    monkeypatch.setattr(call_logs, "kept", lambda df, name: written.append(df.rdd.getNumPartitions()) or real(df, name))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        found = call_logs.scan_call_logs(spark, f"file://{tmp_path}")
        assert found.turns.count() == 600 and found.rejected.count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert written == [call_logs.TASKS * spark.sparkContext.defaultParallelism]


def test_each_call_is_a_file_without_a_folder_of_its_own(spark, sf, monkeypatch):
    folders, real = [], call_logs.scan_call_logs
    monkeypatch.setattr(call_logs, "scan_call_logs", lambda s, path: folders.append(path) or real(s, path))
    audit.QUERIES["log_files"](spark, sf)
    calls = spark.read.parquet(f"{sf}/conversations.parquet").selectExpr("conv_id % 3 as kind", "conv_id").distinct().groupBy("kind").count().collect()
    calls = {r["kind"]: r["count"] for r in calls}
    for kind, name in ((0, "json"), (2, "text")):
        files = spark.read.format("binaryFile").load(f"{folders[0]}/{name}")
        assert "c" not in files.columns and files.count() == calls[kind]


def test_chunks_and_their_vectors_come_from_one_pass(spark, tmp_path):
    """Texts were cut twice, once for the chunks and once for their vectors, and both were shuffled to meet."""
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(400))), (2, " \t "), (3, None), (4, "one")], "doc_id long, text string")
    index = ChunkIndex(spark, str(tmp_path), buckets=4)
    rows = index.rows(index.named(docs, "doc_id", "text"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1
    cut = {r["chunk_id"]: r for r in retrieval.chunked(docs, "doc_id", "text").where("level = 'child'").collect()}
    vectors = {r["id"]: r["v"] for r in hashed_vectors(spark.createDataFrame([(k, r["content"]) for k, r in cut.items()], "id string, text string"), "id", "text").collect()}
    found = rows.collect()
    for r in found:
        if r["chunk_id"] is not None:
            assert (r["content"], r["token_count"], r["v"]) == (cut[r["chunk_id"]]["content"], cut[r["chunk_id"]]["token_count"], vectors[r["chunk_id"]])
    assert sorted(r["source_id"] for r in found if r["chunk_id"] is None) == [2, 3] and len(found) == len(cut) + 2
    assert all(r["text_hash"] for r in found)
