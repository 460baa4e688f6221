"""Text and residue-name functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Three-letter residue names and their letters.
RESIDUES = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}
#: Order of residue letters in alignments; the gap is the last code.
ALPHABET = "ARNDCQEGHILKMFPSTWYV-"


def _lookup(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def one_letter(name: Column) -> Column:
    """X for an unknown residue."""
    return F.coalesce(F.try_element_at(_lookup(RESIDUES), F.upper(name)), F.lit("X"))


def three_letters(letter: Column) -> Column:
    """Null for an unknown letter."""
    return F.try_element_at(_lookup({v: k for k, v in RESIDUES.items()}), F.upper(letter))


def residue_code(letter: Column) -> Column:
    """Place in ALPHABET; everything else is a gap."""
    place = F.instr(F.lit(ALPHABET), letter) - 1
    return F.when((F.length(letter) == 1) & (place >= 0), place).otherwise(F.lit(len(ALPHABET) - 1)).cast("int")


def canonical_atom(name: Column) -> Column:
    """Old spellings: stars are primes, and O1P to O3P are OP1 to OP3 (two- or three-letter names only)."""
    primed = F.replace(name, F.lit("*"), F.lit("'"))
    return F.when(primed.rlike("^O[0-9]P$"), F.concat(F.lit("OP"), F.substring(primed, 2, 1))).otherwise(primed)


def fixed_column(line: Column, first: int, last: int) -> Column:
    """Characters first to last of a line, 1-based, without any spaces."""
    return F.replace(F.substring(line, first, last - first + 1), F.lit(" "), F.lit(""))


def parsed(text: Column, kind: str, default=None) -> Column:
    """The text as a number, or the default where it is none."""
    value = text.try_cast(kind)
    return value if default is None else F.coalesce(value, F.lit(default).cast(kind))


def fixed_precision(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", value.cast("double"))


def digits_of(text: Column) -> Column:
    """The number in a label such as TRP124; null without digits."""
    return F.regexp_replace(text, r"\D", "").try_cast("int")


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def without_insertions(aligned: Column) -> Column:
    return F.regexp_replace(aligned, "[a-z]", "")


def without_gaps(aligned: Column) -> Column:
    return F.replace(aligned, F.lit("-"), F.lit(""))


def node_name(chain: Column, number: Column) -> Column:
    """Chain and five-digit number."""
    return F.concat(chain, F.lpad(number.cast("string"), 5, "0"))


def valid_sequence(sequence: Column, least: int = 27, most: int = 600) -> Column:
    """Whether the length without X is in range; false for null."""
    return F.coalesce(F.length(F.replace(sequence, F.lit("X"), F.lit(""))).between(least, most), F.lit(False))


def found_at(source: Column, target: Column) -> Column:
    """0-based place of source in target, both without X; -1 if absent."""
    bare = [F.replace(x, F.lit("X"), F.lit("")) for x in (target, source)]
    return (F.instr(*bare) - 1).cast("int")


def fused(light: Column, linker: Column, target: Column) -> Column:
    return F.concat(light, linker, target)


def structure_state(codes: Column) -> Column:
    """helix, strand or coil of a secondary-structure letter."""
    return F.when(codes.isin("H", "G", "I"), "helix").when(codes.isin("B", "E"), "strand").otherwise("coil")
