"""Encodings of single residues, and what is made of them. Results are long: seq_id, pos (from 0), vec (doubles)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions.exprs import letters, lookup
from .words import kmer_words


def encode(seqs: DataFrame, table: dict, drop_unknown: bool = False) -> DataFrame:
    """Each letter's row of a fixed table. An unknown letter fails, or is left out with drop_unknown."""
    rows = seqs.select("seq_id", F.posexplode(letters(F.col("seq"))).alias("pos", "letter")).withColumn("vec", lookup(F.col("letter"), table))
    if drop_unknown:
        rows = rows.where(F.col("vec").isNotNull())
    else:
        rows = rows.withColumn("vec", F.coalesce("vec", F.raise_error(F.concat(F.lit("no code for the letter "), F.col("letter"))).cast("array<double>")))
    return rows.select("seq_id", "pos", "vec")


def _unit(i: int, n: int) -> tuple[float, ...]:
    return tuple(float(i == j) for j in range(n))


def one_hot(seqs: DataFrame, alphabet: str) -> DataFrame:
    return encode(seqs, {a: _unit(i, len(alphabet)) for i, a in enumerate(alphabet)})


def position_specific(seqs: DataFrame, k: int, alphabet: str) -> DataFrame:
    """seq_id, pos, idx: the place of each window's single 1 among the words in alphabet order."""
    index = {w: i for i, w in enumerate(T.universe(k, alphabet))}
    return kmer_words(seqs, k).select("seq_id", "pos", lookup(F.col("word"), index).alias("idx"))


def six_bit(seqs: DataFrame) -> DataFrame:
    """One of six groups; letters in no group are left out, as in the original."""
    return encode(seqs, {a: _unit(i, 6) for i, g in enumerate(T.SIX_GROUPS) for a in g}, drop_unknown=True)


def five_bit(seqs: DataFrame) -> DataFrame:
    return encode(seqs, {a: tuple(map(float, bits)) for a, bits in T.FIVE_BITS.items()})


def aesnn3(seqs: DataFrame) -> DataFrame:
    return encode(seqs, T.AESNN3)


def ncp(seqs: DataFrame) -> DataFrame:
    return encode(seqs, T.NCP)


def blast_scores(seqs: DataFrame) -> DataFrame:
    return encode(seqs, T.BLAST)


def matrix_rows(seqs: DataFrame, matrix: dict) -> DataFrame:
    """Rows of BLOSUM62 or PAM250."""
    return encode(seqs, matrix)


def physical(seqs: DataFrame) -> DataFrame:
    """Hydrophobicity, hydrophilicity and mass."""
    return encode(seqs, {a: (T.HYDROPHOBICITY[a], T.HYDROPHILICITY[a], T.MASS[a]) for a in T.PROTEIN})


def dinucleotide_binary(seqs: DataFrame, alphabet: str = T.DNA) -> DataFrame:
    """Each pair's index as four bits."""
    return word_codes(seqs, 2, {w: tuple(map(float, f"{i:04b}")) for i, w in enumerate(T.universe(2, alphabet))})


def word_codes(seqs: DataFrame, k: int, table: dict) -> DataFrame:
    """Each window's row of a fixed table, such as dinucleotide or trinucleotide properties."""
    return kmer_words(seqs, k).select("seq_id", "pos", lookup(F.col("word"), table).alias("vec"))


def dpc(seqs: DataFrame) -> DataFrame:
    return word_codes(seqs, 2, {w: tuple(T.DI_DNA[p][i] for p in T.DI_DNA) for i, w in enumerate(T.DI_ORDER)})


def tpc(seqs: DataFrame) -> DataFrame:
    """Windows of three letters: DNase I and nucleosome positioning."""
    return word_codes(seqs, 3, {w: (T.DNASE_I[i], float(T.NUCLEOSOME[i])) for i, w in enumerate(T.TRI_ORDER)})


def pssm_rows(seqs: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """Rows of a supplied profile (seq_id, pos, scores); BLOSUM62's where a residue has none."""
    rows = matrix_rows(seqs, T.BLOSUM62)
    if profile is None:
        return rows
    return rows.join(profile.select("seq_id", "pos", "scores"), ["seq_id", "pos"], "left").select("seq_id", "pos", F.coalesce("scores", "vec").alias("vec"))


def psfm(msa: DataFrame, digits: int = 6) -> DataFrame:
    """seq_id, pos, letter, share: letters of an alignment's columns without gaps. msa: seq_id, aligned."""
    rows = msa.select("seq_id", F.posexplode(letters(F.col("aligned"))).alias("pos", "letter")).where("letter <> '-'")
    counts = rows.groupBy("seq_id", "pos", "letter").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("seq_id", "pos"))
    return counts.select("seq_id", "pos", "letter", F.round(F.col("n") / total, digits).alias("share"))


def structure_bits(structures: DataFrame) -> DataFrame:
    """0 for '.' and 1 for a bracket of a dot-bracket string (seq_id, struct)."""
    return structures.select("seq_id", F.posexplode(letters(F.col("struct"))).alias("pos", "c")).select("seq_id", "pos", F.array(F.when(F.col("c") == ".", 0.0).otherwise(1.0)).alias("vec"))


def secondary_structure(structures: DataFrame) -> DataFrame:
    """H, E and C as unit vectors (seq_id, ss)."""
    rows = structures.select("seq_id", F.posexplode(letters(F.col("ss"))).alias("pos", "c"))
    return rows.select("seq_id", "pos", lookup(F.col("c"), {"H": (1, 0, 0), "E": (0, 1, 0), "C": (0, 0, 1)}).alias("vec"))


def tool_values(rows: DataFrame, column: str) -> DataFrame:
    """A supplied value per residue (solvent accessibility, conservation); null, NaN and what is no number count as 0."""
    return rows.select("seq_id", "pos", F.array(F.coalesce(F.nanvl(F.col(column).try_cast("double"), F.lit(0.0)), F.lit(0.0))).alias("vec"))


def sliding(rows: DataFrame, win: int) -> DataFrame:
    """seq_id, pos, features: the rows of an odd window around each residue end to end, padded with zeros at the end on both
    edges. A sequence must be longer than the window."""
    if win % 2 == 0:
        raise ValueError("the window must be odd")
    w = Window.partitionBy("seq_id").orderBy("pos").rowsBetween(-(win // 2), win // 2)
    got = rows.withColumn("near", F.collect_list("vec").over(w))
    zeros = F.transform(F.element_at("near", 1), lambda x: F.lit(0.0))
    return got.select("seq_id", "pos", F.flatten(F.concat("near", F.array_repeat(zeros, F.lit(win) - F.size("near")))).alias("features"))


def fragment(rows: DataFrame, length: int, width: int) -> DataFrame:
    """seq_id, features: a sequence's rows in order, cut or padded with zero rows to length, end to end."""
    tensor_rows = tensor(rows, length, width)
    return tensor_rows.select("seq_id", F.flatten("matrix").alias("features"))


def tensor(rows: DataFrame, length: int, width: int) -> DataFrame:
    """seq_id, matrix: length rows of width values, cut or padded with zeros."""
    got = rows.where(F.col("pos") < length).groupBy("seq_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "vec"))), lambda r: r["vec"]).alias("m"))
    zeros = F.array(*[F.lit(0.0)] * width)
    return got.select("seq_id", F.concat("m", F.array_repeat(zeros, F.lit(length) - F.size("m"))).alias("matrix"))
