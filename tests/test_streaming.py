from helixframe.streaming.words import deduplicated, fasta_stream, running_composition, windowed_words


def test_stream_counts_kmers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(">x\nACAC\n>y\nAC\n")
    out = windowed_words(fasta_stream(spark, str(tmp_path / "in")), 2)
    q = out.writeStream.format("memory").queryName("kmers").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.word: r.n for r in spark.sql("SELECT word, sum(n) AS n FROM kmers GROUP BY word").collect()}
    assert got == {"AC": 3, "CA": 1}


def test_streams_drop_copies_and_count_letters(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(">x->y\nACAC\n>y\nAC\n>z\nacac\n")
    for name, out, mode in (("kept", deduplicated(fasta_stream(spark, str(tmp_path / "in"))), "append"), ("seen", running_composition(fasta_stream(spark, str(tmp_path / "in")), "ACGT"), "complete")):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r.seq for r in spark.sql("SELECT seq FROM kept").collect()) == ["AC", "ACAC"]
    assert {r.letter: r.n for r in spark.sql("SELECT * FROM seen").collect()} == {"A": 5, "C": 5}
