"""Readers and writers round trip."""

import pytest
from pyspark.sql import functions as F

from helixframe.sources import formats


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one x\nacg\nTT\n>two\nGG\n")
    rows = {r.name: (r.seq, r.length, r.label) for r in formats.read_fasta(spark, str(tmp_path / "a.fa"), 1).collect()}
    assert rows == {"one x": ("ACGTT", 5, 1), "two": ("GG", 2, 1)}


def test_fasta_headers_with_arrows(spark, tmp_path):
    (tmp_path / "b.fa").write_text(">A->B\r\nacg\r\n>C > D\r\nGG\r\nTT")
    assert sorted((r.name, r.seq) for r in formats.read_fasta(spark, str(tmp_path / "b.fa")).collect()) == [("A->B", "ACG"), ("C > D", "GGTT")]


def test_checked_rejects(spark):
    rows = spark.createDataFrame([("ACGX",)], "seq string")
    with pytest.raises(Exception, match="character X"):
        formats.checked(rows, "DNA").collect()
    assert formats.checked(rows.withColumn("seq", F.lit("ACG")), "DNA").first().seq == "ACG"


def test_vectors(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 2.5]), (0, [0.0, -1.0])], "label int, features array<double>")
    for sep in (",", "\t"):
        formats.write_vectors(rows, str(tmp_path / "v"), sep)
        assert sorted(r.features for r in formats.read_vectors(spark, str(tmp_path / "v"), sep).collect()) == [[0.0, -1.0], [1.0, 2.5]]
    formats.write_vectors(rows, str(tmp_path / "l"), by_label=True)
    assert formats.read_vectors(spark, str(tmp_path / "l" / "label=1")).first().features == [1.0, 2.5]
    formats.to_libsvm(rows, str(tmp_path / "s"))
    assert sorted((r.label, r.features) for r in formats.read_libsvm(spark, str(tmp_path / "s"), 2).collect()) == [(0.0, [0.0, -1.0]), (1.0, [1.0, 2.5])]


def test_residue_labels_blocks_and_profiles(spark, tmp_path):
    (tmp_path / "r").write_text(">a\n0 1 1\n>b\n1\n")
    assert [r.labels for r in formats.read_residue_labels(spark, str(tmp_path / "r")).orderBy("no").collect()] == [[0, 1, 1], [1]]
    (tmp_path / "b").write_text("> vec of sequence: 3\n1\t2\n3\t4\n> end\n")
    assert [(r.seq_no, r.pos, r.vec) for r in formats.read_blocks(spark, str(tmp_path / "b")).orderBy("pos").collect()] == [(3, 0, [1.0, 2.0]), (3, 1, [3.0, 4.0])]
    line = "1 M " + " ".join(str(i) for i in range(20)) + " " + " ".join(str(i) for i in range(20)) + " 0.5 0.1"
    (tmp_path / "p").write_text("\nhead\nA R N\n" + line + "\n")
    r = formats.read_pssm(spark, str(tmp_path / "p")).first()
    assert (r.pos, r.aa, r.scores[19], r.pct[19]) == (1, "M", 19.0, 19.0)


def test_properties_and_blast(spark, tmp_path):
    (tmp_path / "c").write_text("Physicochemical properties,GG,GA\nRise,1.5 ,2.5\n")
    assert sorted((r.kmer, r.prop, r.value) for r in formats.read_properties(spark, str(tmp_path / "c")).collect()) == [("GA", "Rise", 2.5), ("GG", "Rise", 1.5)]
    many = 150_000
    (tmp_path / "w").write_text("p," + ",".join(f"k{i}" for i in range(many)) + "\nRise," + ",".join("1" for _ in range(many)) + "\n")
    assert formats.read_properties(spark, str(tmp_path / "w")).count() == many
    hit = "<Hit><Hit_id>h</Hit_id><Hit_hsps><Hsp><Hsp_evalue>{}</Hsp_evalue><Hsp_query-from>1</Hsp_query-from><Hsp_query-to>3</Hsp_query-to><Hsp_qseq>A-CD</Hsp_qseq><Hsp_hseq>AGXD</Hsp_hseq></Hsp></Hit_hsps></Hit>"
    turn = "<Iteration><Iteration_iter-num>{}</Iteration_iter-num><Iteration_query-len>5</Iteration_query-len><Iteration_hits>{}</Iteration_hits></Iteration>"
    late = hit.replace("<Hsp_query-from>1<", "<Hsp_query-from>2<").replace("<Hsp_query-to>3<", "<Hsp_query-to>4<")
    (tmp_path / "x.xml").write_text("<r>" + turn.format(1, hit.format("1e-9") * 2) + turn.format(2, late.format("1e-9") + hit.format("2")) + "</r>")
    rows = formats.read_blast_hits(spark, str(tmp_path / "x.xml")).collect()
    assert [(r.query_from, r.query_to, r.aligned) for r in rows] == [(2, 4, "-A-D-")]


def test_residue_labels_are_numbered_without_gaps(spark, tmp_path):
    n = 30_000
    (tmp_path / "r").write_text("".join(f">s{i}\n{i} 1\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        rows = formats.read_residue_labels(spark, str(tmp_path / "r"))
        assert rows.select("no").distinct().count() == n and rows.where("labels[0] <> no").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    labels = spark.createDataFrame([(0, 2), (1, 3), (2, 0)], "label int, n long")
    assert [(r.no, r.label) for r in formats.spread_labels(labels).orderBy("no").collect()] == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 1)]
    assert sorted(formats.pad_labels(spark.createDataFrame([([1, 1],), ([1, 1, 1, 1],)], "labels array<int>"), 3).collect()) == [([1, 1, 0],), ([1, 1, 1],)]
    assert formats.split_proteins(spark.createDataFrame([("AxXC",)], "seq string")).first().seq == "AC"


def test_blocks_round_trip(spark, tmp_path):
    rows = [(s, p, [float(s), p / 2]) for s in range(5) for p in range(s + 1)]
    df = spark.createDataFrame(rows, "seq_no long, pos int, vec array<double>")
    formats.write_blocks(df, str(tmp_path / "b"))
    assert sorted((r.seq_no, r.pos, r.vec) for r in formats.read_blocks(spark, str(tmp_path / "b")).collect()) == rows
    fixed = formats.read_blocks(spark, str(tmp_path / "b"), 3).where("seq_no in (1, 4)").orderBy("seq_no", "pos").collect()
    assert [(r.seq_no, r.vec) for r in fixed] == [(1, [1.0, 0.0]), (1, [1.0, 0.5]), (1, [0.0, 0.0]), (4, [4.0, 0.0]), (4, [4.0, 0.5]), (4, [4.0, 1.0])]
    both, counts = formats.stacked([df.where("seq_no < 2"), df.where("seq_no >= 2")])
    assert both.count() == len(rows) and {r.part: r.n for r in counts.collect()} == {0: 3, 1: 12}


def test_index_files(spark, tmp_path):
    (tmp_path / "aa").write_text("H TEST1\nD words\nI    A/L     R/K\n 1 2 3 4 5 6 7 8 9 10\n 11 12 13 14 15 16 17 18 19 20\n//\nH TEST2\nI    A/L\n NA 2 2 2 2 2 2 2 2 2\n 2 2 2 2 2 2 2 2 2 2\n//\n")
    got = {(r.prop, r.letter): r.value for r in formats.read_aaindex(spark, str(tmp_path / "aa")).collect()}
    assert len(got) == 40 and got["TEST1", "A"] == 1 and got["TEST1", "V"] == 20 and got["TEST1", "L"] == 11 and got["TEST2", "A"] == 1.9
    (tmp_path / "ui").write_text(">First one\nskipped\n1\t2.5\n>Second\nx\n3\t4\n")
    assert sorted((r.prop, r["values"]) for r in formats.read_user_index(spark, str(tmp_path / "ui")).collect()) == [("First one", [1.0, 2.5]), ("Second", [3.0, 4.0])]
    (tmp_path / "alt").write_text("AA\n1 2\nAC\n3 4\n")
    assert sorted((r.kmer, r.prop, r.value) for r in formats.read_alternating(spark, str(tmp_path / "alt"), ["x", "y"]).collect()) == [("AA", "x", 1.0), ("AA", "y", 2.0), ("AC", "x", 3.0), ("AC", "y", 4.0)]


def test_motif_files(spark, tmp_path):
    row = lambda k: " ".join(str(float(i == k)) for i in range(20))
    (tmp_path / "elm").write_text("".join(f"MOTIF m{m}\n\nletter matrix\n{row(m)}\n{row(3)}\nURL x\n\n" for m in (0, 1)) + "END\n")
    got = {(r.motif, r.row): r.weights.index(1.0) for r in formats.read_elm_motifs(spark, str(tmp_path / "elm")).collect()}
    assert got == {(0, 0): 0, (0, 1): 6, (1, 0): 4, (1, 1): 6}  # A; E; C; E in the matrices' order
    (tmp_path / "mega").write_text("head\nMT\tx:A[CD]\nMT\ty:[ST]L\nEND\nMT\tz:GG\n")
    found = formats.read_pattern_motifs(spark, str(tmp_path / "mega"))
    assert list(found) == ["A[CD]", "[ST]L"] and found["A[CD]"] == formats.motif_from_pattern("A[CD]")


def test_result_files(spark, tmp_path):
    formats.write_metrics(spark.createDataFrame([(0.5, 0.25)], "Acc double, Pr double"), str(tmp_path / "m"))
    assert [r.value for r in spark.read.text(str(tmp_path / "m")).collect()] == ["The final results of cross validation  are as follows:", "Acc = 0.5000", "Precision = 0.2500"]
    rows = spark.createDataFrame([(i, 1, -1, i / 100) for i in range(100)], "id long, y int, p int, score double").repartition(5)
    formats.write_probabilities(rows, str(tmp_path / "p"))
    lines = [x for f in sorted((tmp_path / "p").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines[:2] == ["Sample index\tTrue labels\tpredicted labels\tprobability values", "1\t1\t-1\t0.0"] and lines[100] == "100\t1\t-1\t0.99"
    formats.write_table(spark.createDataFrame([(2, [1.0, 2.0]), (1, [3.0, 4.0])], "id int, z array<double>"), str(tmp_path / "t"), ["id"])
    assert [x for f in sorted((tmp_path / "t").glob("part-*")) for x in f.read_text().splitlines()] == ["1\t3.0\t4.0", "2\t1.0\t2.0"]
    scores = spark.createDataFrame([(1, "train", i, j, float(10 * i + j)) for i in range(2) for j in range(2)], "fold int, part string, i int, j int, score double")
    formats.write_scores(scores, spark.createDataFrame([(1, "train", 0, 1), (1, "train", 1, -1)], "fold int, part string, i int, y int"), str(tmp_path / "s"))
    assert [r.value for r in spark.read.text(str(tmp_path / "s" / "scores" / "fold=1" / "part=train")).orderBy("value").collect()] == ["0.0\t1.0", "10.0\t11.0"]
    assert formats.result_path("results/", "Seq", "BOW", "Kmer", k=3, fixed=5) == "results/Seq/BOW/Kmer/k_3_fixed_5"
    assert "| Acc  | " in formats.console_table("Results", {"Acc": 0.5})
