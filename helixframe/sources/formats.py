"""Readers and writers of the sequence and feature formats. Schemas are stated, never inferred."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import ALPHABETS, MATRIX_ORDER
from ..operators.scale import ranked


def parse_fasta(record: Column) -> list[Column]:
    """name and seq (one line, upper case) of a FASTA record's text, with or without its '>'."""
    body = F.regexp_replace(record, r"^>", "")
    at = F.instr(body, "\n")
    name = F.trim(F.when(at > 0, F.substring_index(body, "\n", 1)).otherwise(body))
    seq = F.when(at > 0, F.upper(F.regexp_replace(F.substr(body, at + 1), r"\s", ""))).otherwise(F.lit(""))
    return [name.alias("name"), seq.alias("seq")]


def read_fasta(spark: SparkSession, path: str, label: int | None = None) -> DataFrame:
    """name, seq, length and, if given, label of the records of FASTA files. The reader cuts records at each '>' that begins a
    line; one within a header is part of it."""
    rows = spark.read.text(path, lineSep="\n>").where(F.length(F.trim("value")) > 0)
    rows = rows.select(*parse_fasta(F.regexp_replace("value", "\r", "")))
    rows = rows.withColumn("length", F.length("seq"))
    return rows if label is None else rows.withColumn("label", F.lit(label))


def numbered(spark: SparkSession, path: str, sep: str = "\n", keep: Column | None = None) -> DataFrame:
    """file, no and value of the pieces of text files, cut at sep: no counts those that `keep` (a condition on value) lets through,
    from 0 in each file's order and without gaps, whatever tasks read them."""
    rows = spark.read.text(path, lineSep=sep).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_place"), "value")
    rows = rows if keep is None else rows.where(keep)
    return ranked(rows, ["file"], ["_block", "_place"], "no").select("file", F.col("no").cast("long").alias("no"), "value")


def first_illegal(seq: Column, alphabet: str) -> Column:
    """The first letter that the alphabet doesn't have, '' if there is none. Case doesn't count."""
    return F.regexp_extract(seq, f"[^{alphabet}{alphabet.lower()}]", 0)


def checked(seqs: DataFrame, kind: str, min_length: int = 1) -> DataFrame:
    """seqs, failing with a message on the first sequence that is too short or has an illegal letter."""
    bad = first_illegal(F.col("seq"), ALPHABETS[kind])
    wrong = F.when(F.length("seq") < min_length, F.lit("a sequence is too short")).when(bad != "", F.concat(F.lit("a sequence has the character "), bad))
    return seqs.withColumn("seq", F.when(wrong.isNull(), F.col("seq")).otherwise(F.raise_error(wrong)))


def labelled_union(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """One corpus of the files of several labels."""
    out = None
    for df, label in parts:
        df = df.withColumn("label", F.lit(label))
        out = df if out is None else out.unionByName(df)
    return out


def split_proteins(seqs: DataFrame) -> DataFrame:
    """seqs as profile searches want them: no X, in either case. Each sequence is a row already, as it was a file."""
    return seqs.withColumn("seq", F.regexp_replace("seq", "[xX]", ""))


def read_residue_labels(spark: SparkSession, path: str) -> DataFrame:
    """file, no and labels (ints) of each line that is no header: no counts from 0 in a file, as its sequences do."""
    rows = numbered(spark, path, keep=~F.col("value").startswith(">") & (F.trim("value") != ""))
    return rows.select("file", "no", F.split(F.trim("value"), r"\s+").cast("array<int>").alias("labels"))


def spread_labels(counts: DataFrame) -> DataFrame:
    """no, label: as many rows for each label as counts (label, n) says, numbered from 0 in the labels' order."""
    total = counts.withColumn("_first", F.coalesce(F.sum("n").over(Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per label
    rows = total.where("n > 0").select("label", F.explode(F.sequence("_first", F.col("_first") + F.col("n") - 1)).alias("no"))
    return rows.select(F.col("no").cast("long").alias("no"), "label")


def pad_labels(rows: DataFrame, length: int) -> DataFrame:
    """labels cut to length, or padded with zeros."""
    cut = F.slice("labels", 1, length)
    return rows.withColumn("labels", F.concat(cut, F.array_repeat(F.lit(0), F.lit(length) - F.size(cut))))


def read_vectors(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """features of csv, tsv or tab files without header."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), re.escape(sep)).cast("array<double>").alias("features"))


def stacked(parts: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The rows of several vector files as one table, with their file's number as `part`, and the number of rows of each part."""
    out = None
    for i, df in enumerate(parts):
        df = df.withColumn("part", F.lit(i))
        out = df if out is None else out.unionByName(df)
    return out, out.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def write_vectors(df: DataFrame, path: str, sep: str = ",", by_label: bool = False) -> None:
    """One line per row of features (array of doubles); a folder for each label if asked for."""
    line = F.array_join(F.transform("features", lambda x: x.cast("string")), sep).alias("value")
    out = df.select(*(["label"] if by_label else []), line).write.mode("overwrite")
    (out.partitionBy("label") if by_label else out).text(path)


def to_libsvm(df: DataFrame, path: str) -> None:
    """label and features in libsvm lines, with the labels where they belong."""
    from pyspark.ml.functions import array_to_vector

    df.select(F.col("label").cast("double"), array_to_vector("features").alias("features")).write.mode("overwrite").format("libsvm").save(path)


def read_libsvm(spark: SparkSession, path: str, n: int) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return spark.read.format("libsvm").option("numFeatures", n).load(path).select("label", vector_to_array("features").alias("features"))


def read_blocks(spark: SparkSession, path: str, fixed_len: int | None = None) -> DataFrame:
    """seq_no, pos and vec of text blocks: '> ...: number', tab-separated rows, '> end'. The reader cuts files at the ends of blocks.
    With fixed_len each block has so many rows, cut or padded with zeros."""
    rows = spark.read.text(path, lineSep="> end").where(F.col("value").contains(">"))
    head = F.regexp_extract("value", r">[^\n]*:\s*(\d+)", 1).cast("long").alias("seq_no")
    lines = F.filter(F.split(F.regexp_replace(F.regexp_replace("value", "\r", ""), r"(?s)^.*?>[^\n]*\n", ""), "\n"), lambda x: F.trim(x) != "")
    rows = rows.select(head, F.transform(lines, lambda x: F.split(F.trim(x), r"\t").cast("array<double>")).alias("m"))
    if fixed_len is not None:
        zeros = F.transform(F.get("m", F.lit(0)), lambda x: F.lit(0.0))
        cut = F.slice("m", 1, fixed_len)
        rows = rows.where("size(m) > 0").select("seq_no", F.concat(cut, F.array_repeat(zeros, F.lit(fixed_len) - F.size(cut))).alias("m"))
    return rows.select("seq_no", F.posexplode("m").alias("pos", "vec"))


def write_blocks(rows: DataFrame, path: str) -> None:
    """Rows (seq_no, pos, vec) as the blocks that read_blocks reads, one after the other in each file."""
    line = F.array_join(F.transform("vec", lambda x: x.cast("string")), "\t")
    m = rows.groupBy("seq_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda r: r["l"]), "\n").alias("body"))
    block = F.concat(F.lit("> vec of sequence: "), F.col("seq_no").cast("string"), F.lit("\n"), "body", F.lit("\n> end"))
    m.select("seq_no", block.alias("value")).sortWithinPartitions("seq_no").select("value").write.mode("overwrite").text(path)


def read_pssm(spark: SparkSession, path: str) -> DataFrame:
    """pos, aa, scores (20 log odds) and pct (20 counts) of ASCII profiles; lines with fewer than 42 fields are heads."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f")).where((F.size("f") >= 42) & F.col("f")[0].rlike(r"^\d+$"))
    return rows.select(F.col("f")[0].cast("int").alias("pos"), F.col("f")[1].alias("aa"), F.slice("f", 3, 20).cast("array<double>").alias("scores"), F.slice("f", 23, 20).cast("array<double>").alias("pct"))


def read_blast_hits(spark: SparkSession, path: str, max_evalue: float = 1e-3) -> DataFrame:
    """Aligned rows of BLAST XML reports, of each file's last iteration: hit, evalue, query_from, query_to, aligned: letters of the hit
    at the query's places, odd letters as gaps, and gaps before query_from and behind query_to."""
    hsp = "struct<Hsp_evalue: string, `Hsp_query-from`: string, `Hsp_query-to`: string, Hsp_qseq: string, Hsp_hseq: string>"
    hits = f"Iteration_hits struct<Hit: array<struct<Hit_id: string, Hit_hsps: struct<Hsp: array<{hsp}>>>>>"
    rows = spark.read.format("xml").option("rowTag", "Iteration").schema(f"`Iteration_iter-num` int, `Iteration_query-len` int, {hits}").load(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("Iteration_iter-num").alias("turn"), F.col("Iteration_query-len").alias("whole"), "Iteration_hits.Hit")
    last = rows.groupBy("file").agg(F.max("turn").alias("turn"))  # a row per file
    rows = rows.join(last, ["file", "turn"]).select("whole", F.explode("Hit").alias("x")).select("whole", F.col("x.Hit_id").alias("hit"), F.explode("x.Hit_hsps.Hsp").alias("h"))
    keep = F.zip_with(F.split(F.col("h.Hsp_qseq"), ""), F.split(F.col("h.Hsp_hseq"), ""), lambda q, x: F.when(q == "-", F.lit("")).otherwise(x))
    row = F.translate(F.array_join(keep, ""), "XBZUJO", "------")
    at, to = F.col("h")["Hsp_query-from"].cast("int"), F.col("h")["Hsp_query-to"].cast("int")
    aligned = F.concat(F.repeat(F.lit("-"), at - 1), row, F.repeat(F.lit("-"), F.greatest(F.coalesce("whole", to) - to, F.lit(0))))
    out = rows.select("hit", F.col("h.Hsp_evalue").cast("double").alias("evalue"), at.alias("query_from"), to.alias("query_to"), aligned.alias("aligned"))
    return out.where(F.col("evalue") <= max_evalue)


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    """kmer, prop, value of CSV files whose first line names the k-mers; every line and column counts."""
    lines = numbered(spark, path, keep=F.trim("value") != "").withColumn("f", F.split(F.regexp_replace("value", "\r", ""), ","))
    head = lines.where("no = 0").select(F.col("file").alias("_file"), F.col("f").alias("head"))  # one row of each file
    rows = lines.where("no > 0").join(head, F.col("file") == F.col("_file"))
    tail = lambda c: F.slice(c, F.lit(2), F.size(c))
    rows = rows.select(F.trim(F.col("f")[0]).alias("prop"), F.explode(F.arrays_zip(tail(F.col("head")).alias("k"), tail(F.col("f")).alias("v"))).alias("p"))
    return rows.select(F.trim("p.k").alias("kmer"), "prop", F.trim("p.v").cast("double").alias("value"))


def read_alternating(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """kmer, prop, value of files in which a line with a k-mer and one with its values, in the order of names, take turns."""
    lines = numbered(spark, path, keep=F.trim("value") != "").withColumn("pair", F.floor(F.col("no") / 2))
    pairs = lines.groupBy("file", "pair").agg(F.max(F.when(F.col("no") % 2 == 0, F.trim("value"))).alias("kmer"), F.max(F.when(F.col("no") % 2 == 1, F.split(F.trim("value"), r"\s+"))).alias("v"))
    rows = pairs.select("kmer", F.explode(F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("prop"), F.col("v").alias("v"))).alias("p"))
    return rows.where("p.prop is not null").select("kmer", "p.prop", F.col("p.v").cast("double").alias("value"))


def read_user_index(spark: SparkSession, path: str) -> DataFrame:
    """prop, values of user-defined indices: a line '>name', one that is skipped, and one of tab-separated values."""
    rows = spark.read.text(path, lineSep="\n>").where(F.trim("value") != "").select(F.split(F.regexp_replace("value", "^>|\r", ""), "\n").alias("l")).where("size(l) >= 3")
    return rows.select(F.trim(F.col("l")[0]).alias("prop"), F.split(F.trim(F.col("l")[2]), r"\t").cast("array<double>").alias("values"))


def read_aaindex(spark: SparkSession, path: str) -> DataFrame:
    """prop, letter, value of an AAindex flat file: the H line of each record names it, the two lines after its I line hold the values
    in the order ARNDCQEGHI LKMFPSTWYV. A missing value is a twentieth of the sum of the others, three decimals."""
    rows = spark.read.text(path, lineSep="\n//").select(F.regexp_replace("value", "\r", "").alias("r")).where(F.col("r").rlike(r"(?m)^I"))
    both = F.concat_ws(" ", F.regexp_extract("r", r"(?m)^I[^\n]*\n([^\n]*)\n[^\n]*", 1), F.regexp_extract("r", r"(?m)^I[^\n]*\n[^\n]*\n([^\n]*)", 1))
    v = F.transform(F.split(F.trim(both), r"\s+"), lambda x: F.when(x != "NA", x.cast("double")))
    rows = rows.select(F.trim(F.regexp_extract("r", r"(?m)^H (.*)$", 1)).alias("prop"), v.alias("v"))
    mean = F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))) / 20, 3)
    letters = F.array(*[F.lit(a) for a in MATRIX_ORDER])
    rows = rows.withColumn("mean", mean).select("prop", "mean", F.posexplode(F.arrays_zip(letters.alias("letter"), "v")).alias("i", "p"))
    return rows.where("p.letter is not null").select("prop", "p.letter", F.coalesce("p.v", "mean").alias("value"))


# fixed value: the letters of the columns of ELM motif matrices, in their order
ELM_ORDER = "ACDEFGHIKLMNPQRSTWYV"


def read_elm_motifs(spark: SparkSession, path: str) -> DataFrame:
    """motif, row, weights (in the matrices' order) of ELM files: blocks of a MOTIF line and two more, rows of 20 weights, and a URL
    line. What stands behind a line END isn't read. Rows end at the first line that isn't 20 numbers."""
    rows = numbered(spark, path, "MOTIF").select("no", F.split(F.regexp_replace("value", "\r", ""), "\n").alias("l"))
    numbers = F.filter(F.transform(F.slice("l", F.lit(4), F.size("l")), lambda x: F.split(F.trim(x), r"\s+")), lambda f: (F.size(f) >= 20) & f[0].rlike(r"^[-+]?[0-9.]"))
    place = [ELM_ORDER.index(a) for a in MATRIX_ORDER]
    rows = rows.where((F.col("no") > 0) & (F.size("l") > 3)).select((F.col("no") - 1).cast("int").alias("motif"), F.posexplode(numbers).alias("row", "f"))
    return rows.select("motif", "row", F.array(*[F.col("f")[i].cast("double") for i in place]).alias("weights"))


def read_pattern_motifs(spark: SparkSession, path: str) -> dict[str, list[list[float]]]:
    """Motifs of pattern files by their pattern (a tab-separated line 'MT ...:pattern'), up to a line END, as motif_from_pattern()
    gives them. Motif files are small; their patterns come to the driver."""
    lines = numbered(spark, path)
    end = lines.where(F.trim(F.split("value", "\t")[0]) == "END").agg(F.min("no")).first()[0]
    lines = lines if end is None else lines.where(F.col("no") < end)
    found = lines.where(F.col("value").rlike("^MT\t.*:")).select("no", F.trim(F.regexp_extract("value", r":([^:\t\r]*)", 1)).alias("p")).orderBy("no").collect()
    return {r.p: motif_from_pattern(r.p) for r in found}


def motif_from_pattern(pattern: str) -> list[list[float]]:
    """Rows of 20 weights (alphabetical) for a pattern such as 'A[CD]x': the letters of a place share it as 1/1.5**i, the first
    most; 'x' or '.' is any letter."""
    from ..functions.tables import PROTEIN

    rows = []
    for m in re.finditer(r"\[([A-Z]+)\]|([A-Za-z.])", pattern):
        kept = m[1] or (PROTEIN if m[2] in "xX." else m[2])
        w = {c: 1.0 if m[2] and m[2] in "xX." else 1.5**-i for i, c in enumerate(kept) if c in PROTEIN}
        total = sum(w.values()) or 1.0
        rows.append([w.get(c, 0.0) / total for c in PROTEIN])
    return rows


# ---- sinks of results ----------------------------------------------------------------------------------------------------


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One line 'name = value' with four decimals for each metric of a one-row table."""
    names = {"Pr": "Precision", "Rc": "Recall"}
    lines = F.array(F.lit("The final results of cross validation  are as follows:"), *[F.concat(F.lit(f"{names.get(c, c)} = "), F.format_string("%.4f", F.col(c).cast("double"))) for c in metrics.columns])
    metrics.limit(1).select(F.array_join(lines, "\n").alias("value")).write.mode("overwrite").text(path)


def write_probabilities(rows: DataFrame, path: str) -> None:
    """rows (id, y, p, score) as tab-separated lines below a head: sample index (from 1 in the order of ids), true label, predicted
    label, probability. Parts are files in order; the head stands in the first."""
    at = ranked(rows, [], ["id"], "_i")
    head = "Sample index\tTrue labels\tpredicted labels\tprobability values"
    line = F.concat_ws("\t", (F.col("_i") + 1).cast("string"), F.col("y").cast("string"), F.col("p").cast("string"), F.col("score").cast("string"))
    line = F.when(F.col("_i") == 0, F.concat(F.lit(head + "\n"), line)).otherwise(line)
    at.repartitionByRange("_i").sortWithinPartitions("_i").select(line.alias("value")).write.mode("overwrite").text(path)


def write_table(rows: DataFrame, path: str, order: list[str], sep: str = "\t") -> None:
    """Clusters, rankings, reduced coordinates or scores as lines: all columns of a row, arrays end to end, in the order of
    `order`."""
    columns = [F.array_join(F.transform(f.name, lambda x: x.cast("string")), sep) if f.dataType.typeName() == "array" else F.coalesce(F.col(f.name).cast("string"), F.lit("")) for f in rows.schema]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.concat_ws(sep, *columns).alias("value")).write.mode("overwrite").text(path)


def write_scores(scores: DataFrame, labels: DataFrame, path: str) -> None:
    """Score matrices by fold: scores (fold, part 'train' or 'test', i, j, score) as one line of scores for each i, in folders
    fold=/part=, and labels (fold, part, i, y) beside them."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", "score"))), lambda r: r["score"].cast("string")), "\t")
    rows = scores.groupBy("fold", "part", "i").agg(line.alias("value"))
    rows.repartitionByRange("fold", "part", "i").sortWithinPartitions("fold", "part", "i").select("fold", "part", "value").write.mode("overwrite").partitionBy("fold", "part").text(f"{path}/scores")
    labels.repartitionByRange("fold", "part", "i").sortWithinPartitions("fold", "part", "i").select("fold", "part", F.col("y").cast("string").alias("value")).write.mode("overwrite").partitionBy("fold", "part").text(f"{path}/labels")


def result_path(root: str, level: str, mode: str, method: str, batch: bool = False, **params) -> str:
    """Where a run's files stand: root/[batch/]level/mode/method, and a folder that names the parameters in their order."""
    if level not in ("Seq", "Res"):
        raise ValueError("a level is Seq or Res")
    named = "_".join(f"{k}_{v}" for k, v in params.items())
    return "/".join(x for x in (root.rstrip("/"), "batch" if batch else "", level, mode, method, named) if x)


def console_table(title: str, values: dict) -> str:
    """A box of names and values, numbers with four decimals."""
    rows = [(str(k), f"{v:.4f}" if isinstance(v, float) else str(v)) for k, v in values.items()]
    left, right = max([len(k) for k, _ in rows] + [4]), max([len(v) for _, v in rows] + [len(title) - 7, 5])
    bar = f"+{'-' * (left + 2)}+{'-' * (right + 2)}+"
    return "\n".join([bar, f"| {title:^{left + right + 3}} |", bar, *[f"| {k:<{left}} | {v:>{right}} |" for k, v in rows], bar])
