"""Alphabets, code tables and matrices."""

from __future__ import annotations

from itertools import product

# fixed values: alphabets; amino acids in alphabetical order, and in the order of the substitution matrices' columns
DNA = "ACGT"
RNA = "ACGU"
PROTEIN = "ACDEFGHIKLMNPQRSTVWY"
MATRIX_ORDER = "ARNDCQEGHILKMFPSTWYV"
ALPHABETS = {"DNA": DNA, "RNA": RNA, "Protein": PROTEIN}

# fixed values: groups of amino acids of the six-bit code
SIX_GROUPS = ["HRK", "DENQ", "C", "STPAG", "MILV", "FYW"]

# fixed values: five-bit codes, in alphabetical order of the amino acids
FIVE_BITS = dict(zip(PROTEIN, "00011 00101 00110 00111 01001 01010 01011 01100 01101 01110 10001 10010 10011 10100 10101 10110 11000 11001 11010 11100".split()))

# fixed values: the learned three-dimensional amino-acid code AESNN3
AESNN3 = {
    "A": (-0.99, -0.61, 0.00), "R": (0.28, -0.99, -0.22), "N": (0.77, -0.24, 0.59), "D": (0.74, -0.72, -0.35), "C": (0.34, 0.88, 0.35),
    "Q": (0.12, -0.99, -0.99), "E": (0.59, -0.55, -0.99), "G": (-0.79, -0.99, 0.10), "H": (0.08, -0.71, 0.68), "I": (-0.77, 0.67, -0.37),
    "L": (-0.92, 0.31, -0.99), "K": (-0.63, 0.25, 0.50), "M": (-0.80, 0.44, -0.71), "F": (0.87, 0.65, -0.53), "P": (-0.99, -0.99, -0.99),
    "S": (0.99, 0.40, 0.37), "T": (0.42, 0.21, 0.97), "W": (-0.13, 0.77, -0.90), "Y": (0.59, 0.33, -0.99), "V": (-0.99, 0.27, -0.52),
}

# fixed values: nucleotide chemical property bits (ring, functional group, hydrogen bond)
NCP = {"A": (1, 1, 1), "C": (0, 1, 0), "G": (1, 0, 0), "U": (0, 0, 1)}

# fixed values: nucleotide match scores, columns A T C G
BLAST = {"A": (1, -5, -5, -1), "T": (-5, 1, -1, -5), "C": (-5, -1, 1, -5), "G": (-1, -5, -5, 1)}

# fixed values: hydrophobicity, hydrophilicity and mass of the amino acids
HYDROPHOBICITY = {"A": 0.62, "R": -2.53, "N": -0.78, "D": -0.09, "C": 0.29, "Q": -0.85, "E": -0.74, "G": 0.48, "H": -0.4, "I": 1.38, "L": 1.53, "K": -1.5, "M": 0.64, "F": 1.19, "P": 0.12, "S": -0.18, "T": -0.05, "W": 0.81, "Y": 0.26, "V": 1.8}
HYDROPHILICITY = {"A": -0.5, "R": 3.0, "N": 0.2, "D": 3.0, "C": -1.0, "Q": 0.2, "E": 3.0, "G": 0.0, "H": -0.5, "I": -1.8, "L": -1.8, "K": 3.0, "M": -1.3, "F": -2.5, "P": 0.0, "S": 0.3, "T": -0.4, "W": -3.4, "Y": -2.3, "V": -1.5}
MASS = {"A": 71.079, "R": 156.188, "N": 114.104, "D": 115.086, "C": 103.145, "Q": 128.131, "E": 129.116, "G": 57.0521, "H": 137.141, "I": 113.16, "L": 113.16, "K": 128.17, "M": 131.99, "F": 147.177, "P": 97.177, "S": 87.078, "T": 101.105, "W": 186.123, "Y": 163.176, "V": 99.133}

# fixed values: dinucleotide properties of DNA, in the order GG GA GC GT AG AA AC AT CG CA CC CT TG TA TC TT
DI_ORDER = "GG GA GC GT AG AA AC AT CG CA CC CT TG TA TC TT".split()
DI_DNA = {
    "Twist": (0.026, 0.025, 0.025, 0.036, 0.031, 0.026, 0.036, 0.033, 0.014, 0.016, 0.026, 0.031, 0.016, 0.017, 0.025, 0.026),
    "Tilt": (0.042, 0.038, 0.036, 0.038, 0.037, 0.038, 0.038, 0.036, 0.026, 0.025, 0.042, 0.037, 0.025, 0.018, 0.038, 0.038),
    "Roll": (0.019, 0.020, 0.026, 0.023, 0.019, 0.020, 0.023, 0.022, 0.016, 0.017, 0.019, 0.019, 0.017, 0.016, 0.020, 0.020),
    "Shift": (1.430, 1.320, 1.200, 1.320, 1.460, 1.690, 1.320, 1.030, 1.080, 1.070, 1.430, 1.460, 1.070, 0.720, 1.320, 1.690),
    "Slide": (1.650, 1.930, 2.610, 3.030, 2.030, 2.260, 3.030, 3.830, 2.000, 1.780, 1.650, 2.030, 1.780, 1.200, 1.930, 2.260),
    "Rise": (8.040, 8.560, 9.530, 8.930, 7.080, 7.650, 8.930, 9.070, 6.230, 6.380, 8.040, 7.080, 6.380, 6.230, 8.560, 7.650),
}
# fixed values: dinucleotide properties of RNA, in the same order with U for T
DI_RNA = {
    "Shift": (-0.010, 0.070, 0.070, 0.230, -0.040, -0.080, 0.230, -0.060, 0.300, 0.110, -0.010, -0.040, 0.110, -0.020, 0.070, -0.080),
    "Slide": (-1.780, -1.700, -1.390, -1.430, -1.500, -1.270, -1.430, -1.360, -1.890, -1.460, -1.780, -1.500, -1.460, -1.450, -1.700, -1.270),
    "Rise": (3.320, 3.380, 3.220, 3.240, 3.300, 3.180, 3.240, 3.240, 3.300, 3.090, 3.320, 3.300, 3.090, 3.260, 3.380, 3.180),
    "Tilt": (0.300, 1.300, 0.000, 0.800, 0.500, -0.800, 0.800, 1.100, -0.100, 1.000, 0.300, 0.500, 1.000, -0.200, 1.300, -0.800),
    "Roll": (12.100, 9.400, 6.100, 4.800, 8.500, 7.000, 4.800, 7.100, 12.100, 9.900, 8.700, 8.500, 9.900, 10.700, 9.400, 7.000),
    "Twist": (32.000, 32.000, 35.000, 32.000, 30.000, 31.000, 32.000, 33.000, 27.000, 31.000, 32.000, 30.000, 31.000, 32.000, 32.000, 31.000),
}
# fixed values: trinucleotide property DNase I, in the order of three letters each running G A C T
TRI_ORDER = ["".join(x) for x in product("GACT", repeat=3)]
DNASE_I = (
    3.311, 3.819, 1.387, 3.619, 3.221, 4.385, 3.498, 4.153, 3.275, 2.754, 1.387, 2.683, 2.832, 3.77, 3.498, 5.26,
    3.782, 3.879, 2.683, 4.471, 3.995, 6.882, 5.26, 6.698, 3.625, 3.516, 3.619, 4.471, 2.185, 3.047, 4.153, 6.698,
    4.502, 2.57, 3.275, 3.625, 2.671, 3.958, 2.832, 2.185, 4.502, 5.0, 3.311, 3.782, 2.671, 3.813, 3.221, 3.995,
    5.0, 10.0, 2.754, 3.516, 3.813, 4.013, 3.77, 3.047, 2.57, 2.197, 3.819, 3.879, 3.958, 4.013, 4.385, 0.1,
)
# fixed values: trinucleotide property nucleosome positioning, in the same order
NUCLEOSOME = (
    13, -5, 45, 8, 8, -12, 8, 7, 25, 13, 45, 25, 17, -6, 8, -6,
    8, -9, 25, 11, 6, -36, -6, -30, 8, 6, 8, 11, 18, -13, 7, -30,
    2, 31, 25, 8, -2, -9, 17, 18, 2, 8, 13, 8, -2, -18, 8, 6,
    8, 8, 13, 6, -18, -20, -6, -13, 31, 8, -5, -9, -9, -20, -12, -36,
)

# fixed values: BLOSUM62, the lower triangle in MATRIX_ORDER
_BLOSUM62 = """
4
-1 5
-2 0 6
-2 -2 1 6
0 -3 -3 -3 9
-1 1 0 0 -3 5
-1 0 0 2 -4 2 5
0 -2 0 -1 -3 -2 -2 6
-2 0 1 -1 -3 0 0 -2 8
-1 -3 -3 -3 -1 -3 -3 -4 -3 4
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4
"""
# fixed values: PAM250, the lower triangle in MATRIX_ORDER
_PAM250 = """
2
-2 6
0 0 2
0 -1 2 4
-2 -4 -4 -5 12
0 1 1 2 -5 4
0 -1 1 3 -5 2 4
1 -3 0 1 -3 -1 0 5
-1 2 2 1 -3 3 1 -2 6
-1 -2 -2 -2 -2 -2 -2 -3 -2 5
-2 -3 -3 -4 -6 -2 -3 -4 -2 2 6
-1 3 1 0 -5 1 0 -2 0 -2 -3 5
-1 0 -2 -3 -5 -1 -2 -3 -2 2 4 0 6
-3 -4 -3 -6 -4 -5 -5 -5 -2 1 2 -5 0 9
1 0 0 -1 -3 0 -1 0 0 -2 -3 -1 -2 -5 6
1 0 1 0 0 -1 0 1 -1 -1 -3 0 -2 -3 1 2
1 -1 0 0 -2 -1 0 0 -1 0 -2 0 -1 -3 0 1 3
-6 2 -4 -7 -8 -5 -7 -7 -3 -5 -2 -3 -4 0 -6 -2 -5 17
-3 -4 -2 -4 0 -4 -4 -5 0 -1 -1 -4 -2 7 -5 -3 -3 0 10
0 -2 -2 -2 -2 -2 -2 -1 -2 4 2 -2 2 -1 -1 -1 0 -6 -2 4
"""


def _symmetric(triangle: str) -> dict[str, tuple[int, ...]]:
    rows = [list(map(int, line.split())) for line in triangle.strip().splitlines()]
    return {a: tuple(rows[max(i, j)][min(i, j)] for j in range(len(rows))) for i, a in enumerate(MATRIX_ORDER)}


BLOSUM62 = _symmetric(_BLOSUM62)
PAM250 = _symmetric(_PAM250)


def universe(k: int, alphabet: str) -> list[str]:
    """All words of k letters in the alphabet's order."""
    return ["".join(x) for x in product(alphabet, repeat=k)]


def properties(table: dict[str, tuple[float, ...]], order: list[str]) -> dict[str, dict[str, float]]:
    """word -> property -> value."""
    return {w: {p: float(v[i]) for p, v in table.items()} for i, w in enumerate(order)}


def standardised(values: dict[str, float], sample: bool) -> dict[str, float]:
    """z-scores, two decimals: by the sample's deviation for nucleotides, the population's for amino acids."""
    n = len(values)
    mean = sum(values.values()) / n
    sd = (sum((v - mean) ** 2 for v in values.values()) / (n - 1 if sample else n)) ** 0.5
    return {k: round((v - mean) / sd, 2) for k, v in values.items()}


def top_letters(n: int) -> dict[str, str]:
    """The n letters of highest BLOSUM62 score with each amino acid, the earlier in MATRIX_ORDER on a tie."""
    return {a: "".join(b for _, b in sorted(zip(row, MATRIX_ORDER), key=lambda x: -x[0])[:n]) for a, row in BLOSUM62.items()}


def read_matrix(text: str, skip: int) -> dict[str, tuple[int, ...]]:
    """A substitution matrix from its file's text: `skip` head lines, then a line for each letter; the first 20 columns."""
    rows = [line.split() for line in text.splitlines()[skip:] if line.strip()]
    return {r[0]: tuple(map(int, r[1:21])) for r in rows if r[0] in MATRIX_ORDER}
