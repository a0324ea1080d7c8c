import hashlib

from conftest_llm import frame
from pyspark.sql import functions as F

from tidewatch.llm import exact_dedup


def want(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(low), []).append(i)
    return sorted((i, max(g), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)


def test_stream_matches_brute_force(spark, corpus, tmp_path):
    rows = [r for r in corpus if r[0] != 2007] + [(3000, "ÄÖ É"), (3001, "äÖ É"), (3002, "Äö é"), (5, "again"), (6, "AGAIN")]
    rows = list({i: (i, t) for i, t in rows}.values())
    path = str(tmp_path / "documents.parquet")
    frame(spark, rows).repartition(3).write.parquet(path)
    got = exact_dedup.dedup_files(spark, path).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_state_goes_on_over_later_files(spark, tmp_path):
    path = str(tmp_path / "in")
    frame(spark, [(1, "Same"), (2, "other")]).coalesce(1).write.parquet(path)
    batch = spark.read.parquet(path)
    d = exact_dedup.ExactDedup(spark, str(tmp_path / "state"))
    d.feed(exact_dedup.with_locator(spark.readStream.schema(batch.schema).parquet(path)))
    frame(spark, [(9, "same"), (9, "same"), (None, "sAME")]).coalesce(1).write.mode("append").parquet(path)
    d.feed(exact_dedup.with_locator(spark.readStream.schema(batch.schema).parquet(path)))
    got = d.result(exact_dedup.with_locator(spark.read.parquet(path))).collect()
    assert sorted((r.doc_id or 0, r.keep_id, r.group_size) for r in got) == [(0, 9, 4), (1, 9, 4), (2, 2, 1), (9, 9, 4), (9, 9, 4)]
    assert sum(r.kept for r in got if r.keep_id == 9) == 1


def test_collisions_are_told_apart(spark, tmp_path, monkeypatch):
    def weak(rows):
        return rows.select("doc_id", "locator", exact_dedup.normal(F.col("text")).alias("body")).withColumn("digest", F.unhex(F.sha2(F.substring("body", 1, 1), 256)))

    monkeypatch.setattr(exact_dedup, "_digest", weak)
    path = str(tmp_path / "in")
    frame(spark, [(1, "ab"), (2, "ac"), (3, "ab"), (4, "zz")]).write.parquet(path)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup_files(spark, path).collect()}
    assert got == {1: (3, 2, False), 3: (3, 2, True), 2: (2, 1, True), 4: (4, 1, True)}


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "in")
    frame(spark, []).write.parquet(path)
    assert exact_dedup.dedup_files(spark, path).count() == 0
