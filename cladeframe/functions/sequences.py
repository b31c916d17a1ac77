"""Column functions on characters and sequences: state sets as bit masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The states of DNA are A 0, G 1, C 2, T 3; a code for several bases is the set of them.
DNA = {
    "A": 1, "G": 2, "C": 4, "T": 8, "U": 8,
    "R": 3, "M": 5, "W": 9, "S": 6, "K": 10, "Y": 12,
    "V": 7, "D": 11, "H": 13, "B": 14, "N": 15, "?": 0, "-": 0,
}
BINARY = {"0": 1, "1": 2, "?": 0, "-": 0}
#: Amino acids in the order of their one-letter codes; B, X and Z are states of their own.
PROTEIN = {c: 1 << i for i, c in enumerate("ABCDEFGHIKLMNPQRSTVWXYZ")} | {"?": 0, "-": 0}
ALPHABETS = {"dna": DNA, "binary": BINARY, "protein": PROTEIN}


def mask_of(character: Column, alphabet: dict[str, int]) -> Column:
    """The set of one character, without regard to case; unknown ones are the empty set."""
    known = F.create_map(*[F.lit(x) for kv in alphabet.items() for x in kv])
    return F.coalesce(F.element_at(known, F.upper(character)), F.lit(0))


def encode(sequence: Column, alphabet: dict[str, int] | None = None, skip_first: bool = False) -> Column:
    """A sequence as an array of state sets; blanks are left out.

    ``skip_first`` starts at the second character (an old habit some results depend on).
    """
    clean = F.upper(F.regexp_replace(sequence, r"\s", ""))
    clean = F.substring(clean, 2, 2**31 - 1) if skip_first else clean
    letters = F.filter(F.split(clean, ""), lambda c: c != "")
    return F.transform(letters, lambda c: mask_of(c, alphabet or DNA))


def decode(states: Column, alphabet: dict[str, int] | None = None) -> Column:
    """An array of state sets as text: the first character of the alphabet with that set, else !."""
    first: dict[int, str] = {}
    for c, m in (alphabet or DNA).items():
        first.setdefault(m, c)
    back = F.create_map(*[F.lit(x) for kv in first.items() for x in kv])
    return F.array_join(F.transform(states, lambda m: F.coalesce(F.element_at(back, m), F.lit("!"))), "")


def compared_sites(a: Column, b: Column, gaps: bool = False) -> Column:
    """Sites at which both have a state (or, with gaps, at least one has)."""
    one = F.zip_with(a, b, lambda x, y: F.when(((x != 0) & (y != 0)) if not gaps else ((x != 0) | (y != 0)), 1).otherwise(0))
    return F.aggregate(one, F.lit(0), lambda s, x: s + x)


def hamming(a: Column, b: Column, gaps: bool = False) -> Column:
    """Sites whose sets have no state in common; a gap against a state counts only with ``gaps``."""
    both = lambda x, y: (x != 0) & (y != 0) & (x.bitwiseAND(y) == 0)
    gap = lambda x, y: ((x == 0) & (y != 0)) | ((x != 0) & (y == 0))
    one = F.zip_with(a, b, lambda x, y: F.when((both(x, y) | gap(x, y)) if gaps else both(x, y), 1).otherwise(0))
    return F.aggregate(one, F.lit(0), lambda s, x: s + x)


def similarity(differences: Column, compared: Column) -> Column:
    """1 - differences / compared sites; 1 if nothing could be compared."""
    return F.when(compared == 0, 1.0).otherwise(1 - differences / compared)


def jukes_cantor(proportion: Column) -> Column:
    """-3/4 ln(1 - 4/3 p), infinite from p = 3/4."""
    return F.when(proportion < 0.75, -0.75 * F.ln(1 - proportion * 4 / 3)).otherwise(F.lit(float("inf")))
