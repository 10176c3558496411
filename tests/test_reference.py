import random
import time

from pyspark.sql import functions as F

from cytoplan.operators import reference as rf


def test_pieces_take_time_in_proportion(spark):
    """Each piece was looked for from the contig's beginning on, in a row that held the whole contig."""
    rng = random.Random(7)
    block = "".join(rng.choice("ACGTé") for _ in range(1_000))
    text = block * 3_000
    contigs = spark.createDataFrame([(3, text), (4, ""), (5, None)], "tid int, sequence string")
    begin = time.perf_counter()
    got = {(r.tid, r.piece): r for r in rf.pieces(contigs, 64, 16).collect()}
    assert time.perf_counter() - begin < 20
    assert len(got) == len(text) // 64 + 2 and got[4, 0].letters == "" and got[5, 0].letters is None
    assert all(r.piece_start == k * 64 and r.letters == text[k * 64 : k * 64 + 80] for (tid, k), r in got.items() if tid == 3)


def test_windows_of_all_sizes(spark):
    """Short windows are joined with short pieces, longer ones with longer ones, the longest with all that they touch."""
    rng = random.Random(8)
    text = "".join(rng.choice("ACGT") for _ in range(20_000))
    contigs = spark.createDataFrame([(0, text)], "tid int, sequence string")
    windows = [(i, rng.randrange(len(text)), rng.choice([1, 100, 511, 512, 513, 900, 1_024, 1_025, 5_000])) for i in range(300)]
    reads = spark.createDataFrame([(i, 0, a, n) for i, a, n in windows] + [(900, 1, 5, 10), (901, 0, None, None)], "read_id long, tid int, a long, n long")
    got = rf.with_letters(reads, contigs, F.col("a"), F.col("n"), "x", 4_096, 1_024)
    assert {r.read_id: r.x for r in got.collect()} == {i: text[a : a + n] for i, a, n in windows} | {900: None, 901: None}
    # no short window is joined with a long piece
    held = rf.with_letters(reads.filter("n <= 512"), contigs, F.col("a"), F.col("n"), "x")
    assert "_level" in held._jdf.queryExecution().optimizedPlan().toString()
