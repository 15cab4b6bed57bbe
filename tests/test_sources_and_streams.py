"""Text formats round trip, and streams against the batch operators."""

import json

from pyspark.sql import functions as F

from contactloom.operators import contacts, dataset, report
from contactloom.sources import formats
from contactloom.streaming import contacts as streams


def test_text_formats(spark, tmp_path):
    (tmp_path / "fa").mkdir()
    (tmp_path / "fa/a.fa").write_text("lost\n>one first A>G contig\nACGT\nacg\n\n>two\r\nNN\r\nC\r\n>three\n")
    (tmp_path / "fa/b.fa").write_text(">four\tx>y\nAC\n>five\nT\n")
    (tmp_path / "fa/c.fa").write_text("")
    assert sorted(tuple(r) for r in formats.fasta(spark, str(tmp_path / "fa")).collect()) == [("five", "T"), ("four", "AC"), ("one", "ACGTacg"), ("three", ""), ("two", "NNC")]
    long = "".join(f">s{i} >x\n{'ACGT' * 30}\n" for i in range(400))
    (tmp_path / "long.fa").write_text("before\n" + long)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 5000)
    try:
        split = formats.fasta(spark, str(tmp_path / "long.fa")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(tuple(r) for r in split) == sorted((f"s{i}", "ACGT" * 30) for i in range(400))
    (tmp_path / "s.tsv").write_text("c1\t9820411000\nc2\tx\n")
    assert [tuple(r) for r in formats.chrom_sizes(spark, str(tmp_path / "s.tsv")).collect()] == [("c1", 9820411000), ("c2", None)]
    (tmp_path / "r.tsv").write_text("c1\t100\t350\textra\nc1\t0\t150\textra\n")
    assert [tuple(r) for r in formats.low_complexity(spark, str(tmp_path / "r.tsv"), 100).collect()] == [("c1", 1, 3)]
    (tmp_path / "b.json").write_text(json.dumps({"c1": [5, 7], "c2": []}))
    assert {tuple(r) for r in formats.breakpoint_json(spark, str(tmp_path / "b.json")).collect()} == {("c1", 5), ("c1", 7)}
    (tmp_path / "p.json").write_text(json.dumps({"x_1_C2": 0.5}))
    assert [tuple(r) for r in formats.score_json(spark, str(tmp_path / "p.json")).collect()] == [("x_1_C2", 0.5)]
    (tmp_path / "m.tsv").write_text("\tD1\tD2\n\tT1\tT2\nN50\t1,5\t-\n")
    got = {tuple(r) for r in formats.metric_table(spark, str(tmp_path / "m.tsv")).select("metric", "dataset", "tool", "value").collect()}
    assert got == {("N50", "D1", "T1", 1.5), ("N50", "D2", "T2", None)}


def test_writers(spark, tmp_path):
    seqs = spark.createDataFrame([("a", "ACGT"), ("b", "GG")], "name string, seq string")
    formats.write_fasta(seqs, str(tmp_path / "fa"))
    assert {tuple(r) for r in formats.fasta(spark, str(tmp_path / "fa")).collect()} == {("a", "ACGT"), ("b", "GG")}
    formats.write_paf(spark.createDataFrame([("q", 10, 0, 5)], "Q_name string, Q_len long, Q_start long, Q_end long"), str(tmp_path / "paf"))
    assert formats.paf(spark, str(tmp_path / "paf")).first().asDict() == dict(zip([c.split()[0] for c in formats.PAF.split(", ")], ["q", 10, 0, 5, "0", "0", 0, 0, 0, 0, 0, 0]))
    images = spark.createDataFrame([(1, [1], 10, 5000), (2, [2], 10, 25000)], "sample_id long, x array<int>, image_size int, bin_size int")
    formats.write_dataset(images, str(tmp_path / "d"), Source="test")
    back = dataset.load(spark.read.parquet(str(tmp_path / "d/images")), 10, 25000)
    assert [r.sample_id for r in back.collect()] == [2]
    assert spark.read.parquet(str(tmp_path / "d/metadata")).first().metadata["Source"] == "test"
    scores = [(f"k{i}", i / 16) for i in range(40)]
    formats.write_json_map(spark.createDataFrame(scores, "name string, prob double").repartition(3), str(tmp_path / "j"), "name", "prob")
    assert sorted(tuple(r) for r in formats.score_json(spark, str(tmp_path / "j")).collect()) == sorted(scores)
    (tmp_path / "one.json").write_text(json.dumps(dict(scores), indent=2))
    assert sorted(tuple(r) for r in formats.score_json(spark, str(tmp_path / "one.json")).collect()) == sorted(scores)
    points = [("c1", 7), ("c1", 5), ("c2", 9), ("c2", 9)]
    formats.write_breakpoint_json(spark.createDataFrame(points, "name string, bp long"), str(tmp_path / "bp"))
    assert sorted(tuple(r) for r in formats.breakpoint_json(spark, str(tmp_path / "bp")).collect()) == [("c1", 5), ("c1", 7), ("c2", 9)]
    parts = [("c1", 1, False, 0, 12), ("c1", 2, True, 12, 40), ("c2", 1, False, 0, 5_000_000_000)]
    formats.write_part_json(spark.createDataFrame(parts, "chrom string, part_id int, chimeric boolean, b0 long, b1 long"), str(tmp_path / "parts"))
    assert sorted(tuple(r) for r in formats.part_json(spark, str(tmp_path / "parts")).collect()) == parts
    net = [("A", "Start", "B", "End", 0.12344), ("A", "End", "B", "End", 0.5), ("C", "End", "D", "Start", 1.0)]
    formats.write_network_json(spark.createDataFrame(net, "a string, oa string, b string, ob string, prob double"), str(tmp_path / "net"))
    assert sorted(tuple(r) for r in formats.network_json(spark, str(tmp_path / "net")).collect()) == sorted((a, b, c, d, round(p, 4)) for a, b, c, d, p in net)
    formats.write_scaffold_map(spark.createDataFrame([("s", 2, "b"), ("s", 1, "a"), ("t", 1, "c")], "name string, piece long, contig string"), str(tmp_path / "map"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "map")).collect()) == ["s\ta b", "t\tc"]
    for epoch, loss in ((1, 0.5), (2, 0.25)):
        formats.append_training_log(spark.createDataFrame([(epoch, loss)], "epoch int, train_loss double"), str(tmp_path / "log"))
    assert sorted((r.epoch, r.train_loss, r.val_npv) for r in formats.training_log(spark, str(tmp_path / "log")).collect()) == [(1, 0.5, None), (2, 0.25, None)]


def test_tables_beside_each_other(spark):
    one = spark.createDataFrame([("a", 1, None), ("b", 2, 5)], "k string, x int, y int")
    two = spark.createDataFrame([("a", 9, 7, 1), ("c", 3, None, 2)], "k string, x int, y int, z int")
    assert sorted((tuple(r) for r in report.combined_first(one, two, ["k"]).collect()), key=str) == [("a", 1, 7, 1), ("b", 2, 5, None), ("c", 3, None, 2)]
    assert sorted((tuple(r) for r in report.joined(one.drop("y"), two.select("k", "z"), ["k"]).collect()), key=str) == [("a", 1, 1), ("b", 2, None), ("c", None, 2)]


READS = "chrom1 string, pos1 long, chrom2 string, pos2 long, ts timestamp, read_id long"


def test_streamed_counts_add_up_to_the_batch(spark, tmp_path):
    rows = [("ab"[i % 2], i * 37 % 900, "a", i * 11 % 900, 10**6 + i * 61, i) for i in range(400)]
    df = spark.createDataFrame(rows, READS.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_seconds("ts"))
    source = tmp_path / "in"
    df.orderBy("ts").coalesce(1).write.parquet(str(source))
    df.where("read_id < 50").coalesce(1).write.mode("append").parquet(str(source))
    # a last row far ahead closes all windows
    spark.createDataFrame([("z", 1, "z", 1, 10**7, 999)], READS.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    out = tmp_path / "out"
    query = streams.binned(streams.once(stream, "30 days"), 100, late=None).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.read.parquet(str(out)).where("chrom1 <> 'z'").groupBy("chrom1", "bin1", "chrom2", "bin2").agg(F.sum("cnt").alias("cnt"))
    want = contacts.binned(df, [100]).drop("resolution").select("chrom1", "bin1", "chrom2", "bin2", "cnt")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_bursts(spark, tmp_path):
    rows = [(1, t) for t in (0, 60, 120, 1000)] + [(2, 30)]
    df = spark.createDataFrame(rows, "k long, ts long").withColumn("ts", F.timestamp_seconds("ts"))
    assert sorted((r.k, r.n) for r in streams.bursts(df, "k").collect()) == [(1, 1), (1, 3), (2, 1)]
