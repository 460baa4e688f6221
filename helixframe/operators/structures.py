"""Atoms and residues: collection, radii, molecule classes, chains, neighbours, collisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import geometry as g
from helixframe.functions.text import ALPHABET, RESIDUES, canonical_atom
from helixframe.operators.crowded import parts_around
from helixframe.operators.relational import first_match_lookup, pattern_options, range_join, with_earlier
from helixframe.scratch import settled

# Names of main-chain atoms.
PROTEIN_MAIN = ("N", "CA", "C", "O", "OXT")
NUCLEIC_MAIN = ("P", "OP1", "OP2", "OP3", "O5'", "C5'", "C4'", "O4'", "C3'", "O3'", "C2'", "O2'", "C1'")
# Names of nucleotides.
NUCLEOTIDES = ("A", "C", "G", "T", "U")
AMINO, NUCLEOTIDE = 1, 2


def wanted_atoms(records: DataFrame, hetero: bool = False, water: bool = False, insertions: bool = False) -> DataFrame:
    """PDB records without hydrogens, other alternate locations, and what the options leave out."""
    hydrogen = (F.col("name").startswith("H") & ((F.col("element") == "") | (F.col("element") == "H"))) | F.col("name").rlike("^[1-4]H")
    kept = ~hydrogen & F.col("altloc").isin("", "A")
    kept &= F.col("label").isin("ATOM", "HETATM") if hetero else F.col("label") == "ATOM"
    if not water:
        kept &= F.col("resname") != "HOH"
    if not insertions:
        kept &= F.col("icode") == ""
    return records.filter(kept)


def backbone(records: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, chain, num, n, ca, c): coordinates of the first N, CA and C of every residue that has a CA."""
    keys = keys or []
    atoms = records.filter((F.col("label") == "ATOM") & F.col("name").isin("N", "CA", "C"))
    p = g.point("x", "y", "z")
    return (
        atoms.groupBy(*keys, "chain", F.col("resnum").alias("num"))
        .agg(*[F.min_by(F.when(F.col("name") == n, p), F.when(F.col("name") == n, F.col("serial"))).alias(n.lower()) for n in ("N", "CA", "C")])
        .filter("ca is not null")
    )


def residues(atoms: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, chain, num, name, atoms): the name is the last atom's."""
    return atoms.groupBy(*(keys or []), "chain", "num").agg(F.max_by("resname", "atom_idx").alias("name"), F.count("*").alias("atoms"))


def residue_atoms(atoms: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, chain, num, indices): sorted places of each residue's atoms."""
    return atoms.groupBy(*(keys or []), "chain", "num").agg(F.array_sort(F.collect_list("atom_idx")).alias("indices"))


def molecule_classes(atoms: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Adds molecule_class: 1 for amino acids, 2 for nucleotides, else 0.

    The name of a residue's first atom (of smallest atom_idx) tells it. Of other names,
    residues with three main-chain atoms of proteins are 1, and those with eleven of
    nucleotides 2, unless they have as many of both.
    """
    keys = [*(keys or []), "chain", "num"]
    name = canonical_atom(F.col("name"))
    counts = atoms.groupBy(*keys).agg(
        F.count_if(name.isin(*PROTEIN_MAIN)).alias("_p"), F.count_if(name.isin(*NUCLEIC_MAIN)).alias("_n"), F.min_by("resname", "atom_idx").alias("_of")
    )
    kind = F.when(F.col("_of").isin(*RESIDUES), AMINO).when(F.col("_of").isin(*NUCLEOTIDES), NUCLEOTIDE)
    kind = kind.when(F.col("_p") == F.col("_n"), 0).when(F.col("_p") >= 3, AMINO).when(F.col("_n") >= 11, NUCLEOTIDE).otherwise(0)
    return atoms.join(counts.select(*keys, kind.alias("molecule_class")), keys, "left")


def is_main(molecule_class: Column, name: Column) -> Column:
    name = canonical_atom(name)
    return F.when(molecule_class == AMINO, name.isin(*PROTEIN_MAIN)).when(molecule_class == NUCLEOTIDE, name.isin(*NUCLEIC_MAIN)).otherwise(F.lit(False))


def with_radius(atoms: DataFrame, members: DataFrame, classes: DataFrame, key: str = "atom_idx") -> DataFrame:
    """Adds r, by the best pattern of members (pattern, class) and classes (class, radius); null where none fits."""
    patterns = members.join(classes, "class").select("pattern", "radius")
    kinds = atoms.select("resname", "name").distinct()
    options = pattern_options(F.col("resname"), F.col("name"))
    radii = first_match_lookup(kinds, patterns, options, ["resname", "name"], value_cols=("radius",))
    return atoms.join(radii.withColumnRenamed("radius", "r"), ["resname", "name"], "left")


def filter_by_name(atoms: DataFrame, name: str) -> DataFrame:
    return atoms.filter(F.col("name") == name)


def filter_by_target(model: DataFrame, target_residues: DataFrame) -> DataFrame:
    """Atoms of residues that the target has."""
    return model.join(target_residues.select("chain", "num").distinct(), ["chain", "num"], "left_semi")


def name_mismatches(model: DataFrame, target_residues: DataFrame) -> DataFrame:
    """Residues that both have under different names; callers raise if there are any."""
    named = target_residues.select("chain", "num", F.col("name").alias("target_name"))
    return model.select("chain", "num", "resname").distinct().join(named, ["chain", "num"]).filter("resname <> target_name")


def filter_by_target_atoms(model: DataFrame, target: DataFrame) -> DataFrame:
    """Atoms that the target has in the same residue, old and new spellings alike; they take the target's spelling."""
    spelled = target.select("chain", "num", "resname", canonical_atom(F.col("name")).alias("_c"), F.col("name").alias("_own")).dropDuplicates(["chain", "num", "resname", "_c"])
    joined = model.withColumn("_c", canonical_atom(F.col("name"))).join(spelled, ["chain", "num", "resname", "_c"])
    return joined.withColumn("name", F.col("_own")).select(model.columns)


def merge_atoms(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def rename_chains(atoms: DataFrame, mapping: dict[str, str], chain_col: str = "chain") -> DataFrame:
    if not mapping:
        return atoms
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return atoms.withColumn(chain_col, F.coalesce(F.try_element_at(table, chain_col), F.col(chain_col)))


def letter_chains(atoms: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Chains in order become A to Y where there are under 26, else n1, n2, ...; a blank one becomes x first."""
    keys = keys or []
    named = atoms.withColumn("_chain", F.when(F.trim("chain") == "", "x").otherwise(F.col("chain")))
    chains = named.select(*keys, "_chain").distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_chain"))
    count = F.count("*").over(Window.partitionBy(*keys))
    letters = chains.select(*keys, "_chain", F.when(count < 26, F.chr(rank + 64)).otherwise(F.concat(F.lit("n"), rank.cast("string"))).alias("_letter"))
    return named.join(letters, [*keys, "_chain"]).withColumn("chain", F.col("_letter")).select(atoms.columns)


def renumber(atoms: DataFrame, mapping: DataFrame, replace_names: bool = False) -> DataFrame:
    """Atoms with the numbers of mapping (chain, num, new_chain, new_num, new_name); those it lacks go."""
    joined = atoms.join(mapping, ["chain", "num"])
    joined = joined.withColumns({"chain": F.col("new_chain"), "num": F.col("new_num")})
    if replace_names:
        joined = joined.withColumn("resname", F.col("new_name"))
    return joined.select(atoms.columns)


def mean_bfactor(atoms: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return atoms.groupBy(*(keys or []), "chain", "num").agg(F.avg("bfactor").alias("bfactor"))


def lowest_share(rows: DataFrame, value: str, tie: str, share: float = 0.2, keys: list[str] | None = None) -> DataFrame:
    """The lowest round(share n) rows of each group, halves rounded to even, ties by tie."""
    ranked = with_earlier(rows, [value, tie], "_before", keys=keys, total="_n")
    return ranked.filter(F.col("_before") + 1 <= F.bround(F.col("_n") * share)).drop("_before", "_n")


def tolerable(l: Column, r: Column) -> Column:
    """Collisions that chemistry explains: one residue, a disulphide, a peptide or a phosphodiester bond."""
    same = (l["chain"] == r["chain"]) & (l["num"] == r["num"])
    sulphur = (l["resname"] == "CYS") & (r["resname"] == "CYS") & (l["name"] == "SG") & (r["name"] == "SG")
    def bond(a: str, b: str) -> Column:
        return ((l["name"] == a) & (r["name"] == b)) | ((l["name"] == b) & (r["name"] == a))
    return same | sulphur | bond("C", "N") | bond("P", "O3'")


def collisions(atoms: DataFrame, largest_radius: float, keys: list[str] | None = None, probe: float = 0.0) -> DataFrame:
    """(l, r, d) for pairs of spheres (atom_idx, p, r) that overlap when both grow by the probe; l's atom_idx is the lesser."""
    pairs = range_join(atoms, atoms, 2 * (largest_radius + probe), keys=keys)
    return pairs.filter((F.col("l.atom_idx") < F.col("r.atom_idx")) & (F.col("d") < F.col("l.r") + F.col("r.r") + 2 * probe))


def clashes(atoms: DataFrame, largest_radius: float, cutoff: float = 0.4, across_only: bool = False, keys: list[str] | None = None) -> DataFrame:
    """(keys, i, j, overlap): intolerable overlaps over the cutoff."""
    pairs = collisions(atoms, largest_radius, keys)
    if across_only:
        pairs = pairs.filter("l.chain <> r.chain")
    overlap = F.col("l.r") + F.col("r.r") - F.col("d")
    bad = pairs.filter(~tolerable(F.col("l"), F.col("r"))).withColumn("overlap", overlap).filter(F.col("overlap") > cutoff)
    return bad.select(*[F.col(f"l.{k}").alias(k) for k in keys or []], F.col("l.atom_idx").alias("i"), F.col("r.atom_idx").alias("j"), "overlap")


def touching_chains(atoms: DataFrame, largest_radius: float, probe: float = 1.4, keys: list[str] | None = None) -> DataFrame:
    """Distinct pairs of chains with spheres that meet when they grow by the probe."""
    pairs = collisions(atoms, largest_radius, keys, probe).filter("l.chain <> r.chain")
    names = [F.least("l.chain", "r.chain").alias("chain_a"), F.greatest("l.chain", "r.chain").alias("chain_b")]
    return pairs.select(*[F.col(f"l.{k}").alias(k) for k in keys or []], *names).distinct()


def visible_spheres(atoms: DataFrame, largest_radius: float, keys: list[str] | None = None) -> DataFrame:
    """Spheres that no other sphere holds; of equal ones the one of least atom_idx stays."""
    pairs = range_join(atoms, atoms, largest_radius, keys=keys).filter("l.atom_idx <> r.atom_idx")
    equal = (F.col("d") == 0) & (F.col("l.r") == F.col("r.r"))
    hidden = (F.col("d") + F.col("l.r") <= F.col("r.r")) & (~equal | (F.col("r.atom_idx") < F.col("l.atom_idx")))
    gone = pairs.filter(hidden).select(*[F.col(f"l.{k}").alias(k) for k in keys or []], F.col("l.atom_idx").alias("atom_idx")).distinct()
    return atoms.join(gone, [*(keys or []), "atom_idx"], "left_anti")


def neighbours(active: DataFrame, everything: DataFrame, threshold: float = 4.0, keys: list[str] | None = None) -> DataFrame:
    """(l, r, d): pairs of an active CA and another one nearer than the threshold."""
    pairs = range_join(active, everything, threshold, keys=keys)
    apart = (F.col("l.chain") != F.col("r.chain")) | (F.col("l.num") != F.col("r.num"))
    return pairs.filter((F.col("d") < threshold) & apart)


#: Residues in a block, where all pairs of a structure's residues are asked for; and those of a cell that meet the ones around it under one key.
BLOCK, CROWD = 1024, 1024
#: Blocks of a structure at most, as a residue is sent to each one; a larger structure has larger blocks.
BLOCKS = 32


def _dealt(l: DataFrame, r: DataFrame, on: list[str]) -> DataFrame:
    """A join of small sides with many rows out; its partitions are told, as Spark would merge them by the sides' sizes."""
    n = int(l.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return l.repartition(n, *on).hint("merge").join(r.repartition(n, *on), on)


def _all_pairs(left: DataFrame, right: DataFrame, keys: list[str], block: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with the columns to join by: a structure's residues, dealt by pairs of blocks of about so many or, of BLOCKS at most, of more."""
    own = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    on = [f"_k{i}" for i in range(len(keys))]
    count = lambda df, name: df.groupBy(*own).agg(F.least(F.ceil(F.count("*") / block), F.lit(BLOCKS)).alias(name))
    counted = count(left, "_is").join(count(right, "_js"), on) if on else F.broadcast(count(left, "_is").crossJoin(count(right, "_js")))

    def side(df: DataFrame, mine: str, others: str, i: str, j: str) -> DataFrame:
        placed = df.select("*", *own).join(counted, on) if on else df.join(counted)
        block_of = F.pmod(F.xxhash64("chain", "num"), F.col(mine))
        every = F.explode(F.when(F.col(others) > 0, F.sequence(F.lit(0).cast("long"), F.col(others) - 1)))
        return placed.select(*df.columns, *on, block_of.alias(i), every.alias(j))

    return side(left, "_is", "_js", "_i", "_j"), side(right, "_js", "_is", "_j", "_i"), [*on, "_i", "_j"]


def _near_pairs(own: DataFrame, around: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """(own, around) of residues with atoms in cells side by side, once each: in the least of own's cells that touches one of the other's."""
    cell = lambda p: F.struct(*[F.floor(p[c] / radius).cast("long").alias(c) for c in "xyz"])
    placed = lambda df: df.withColumn("cells", F.array_distinct(F.transform("atoms", lambda a: cell(a["p"]))))
    steps = F.array(*[F.struct(*[F.lit(s).alias(c) for c, s in zip("xyz", (i, j, k), strict=True)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    near = F.array_distinct(F.flatten(F.transform("cells", lambda c: F.transform(steps, lambda s: F.struct(*[(c[x] + s[x]).alias(x) for x in "xyz"])))))
    ks = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    on = [f"_k{i}" for i in range(len(keys))]
    l = placed(own).select(F.struct(*own.columns, "cells").alias("own"), *ks, F.explode("cells").alias("_at"))
    r = placed(around).select(F.struct(*around.columns, "cells").alias("around"), *ks, F.explode(near).alias("_at"))
    touching = F.filter("own.cells", lambda c: F.exists("around.cells", lambda e: (F.abs(c["x"] - e["x"]) <= 1) & (F.abs(c["y"] - e["y"]) <= 1) & (F.abs(c["z"] - e["z"]) <= 1)))
    first = F.when(F.size("own.cells") == 1, True).otherwise(F.array_min(touching) == F.col("_at"))
    return _dealt(l, r, [*on, "_at"]).filter(first).select("own", "around")


def _gaps_of_single_atoms(single: DataFrame, radius: float | None, keys: list[str]) -> DataFrame:
    """min_residue_distance of residues (.., p, r) with one atom: flat columns and built-in functions, so that a pair costs little."""
    if radius is None:
        ours, theirs, on = _all_pairs(single, single, keys, BLOCK)
    else:
        ours, theirs, on = parts_around(single, single, radius, "p", "p", keys, CROWD)

    def flat(df: DataFrame, end: str) -> DataFrame:
        ks = [F.col(k).alias(k) for k in keys] if end == "a" else []
        named = [F.col(c).alias(f"{end}_{c}") for c in ("chain", "num", "r")]
        return df.select(*on, *[k.alias(f"_o{i}") for i, k in enumerate(ks)], *named, *[F.col("p")[c].alias(f"{end}_{c}") for c in "xyz"])

    ours, theirs = flat(ours, "a"), flat(theirs, "b")
    pairs = _dealt(ours, theirs, on) if radius is None else ours.hint("merge").join(theirs, on)
    d = g.distance(*[F.struct(*[F.col(f"{e}_{c}").alias(c) for c in "xyz"]) for e in "ab"])
    pairs = pairs.filter("a_num <> b_num or a_chain <> b_chain")
    if radius is not None:
        pairs = pairs.filter(d <= radius)
    ends = [f"{e}_{c}" for e in "ab" for c in ("chain", "num")]
    return pairs.select(*[F.col(f"_o{i}").alias(k) for i, k in enumerate(keys)], *ends, (d - F.col("a_r") - F.col("b_r")).alias("gap"))


def _gaps_of_several_atoms(left: DataFrame, right: DataFrame, radius: float | None, keys: list[str], swapped: bool = False) -> DataFrame:
    """min_residue_distance of residues (.., atoms), left's to right's; swapped if right is the one of few residues, with a radius."""
    if radius is None:
        l, r, on = _all_pairs(left, right, keys, BLOCK)
        pairs = _dealt(l.select(F.struct(*left.columns).alias("l"), *on), r.select(F.struct(*right.columns).alias("r"), *on), on)
    elif swapped:
        pairs = _near_pairs(left, right, keys, radius).withColumnsRenamed({"own": "l", "around": "r"})
    else:
        pairs = _near_pairs(right, left, keys, radius).withColumnsRenamed({"own": "r", "around": "l"})
    pairs = pairs.filter("l.chain <> r.chain or l.num <> r.num")
    near = lambda a, b: F.lit(True) if radius is None else g.distance(a["p"], b["p"]) <= radius
    gaps = F.flatten(F.transform("l.atoms", lambda a: F.transform(F.filter("r.atoms", lambda b: near(a, b)), lambda b: g.distance(a["p"], b["p"]) - a["r"] - b["r"])))
    if radius is not None:
        pairs = pairs.filter(F.size(gaps) > 0)
    ends = [F.col(f"{s}.{c}").alias(f"{n}_{c}") for s, n in (("l", "a"), ("r", "b")) for c in ("chain", "num")]
    return pairs.select(*[F.col(f"l.{k}").alias(k) for k in keys], *ends, F.array_min(gaps).alias("gap"))


def min_residue_distance(atoms: DataFrame, radius: float | None, largest_radius: float, keys: list[str] | None = None) -> DataFrame:
    """The least gap between spheres of two residues, for residues of which some pair of centres is within the radius.

    Without a radius, for all pairs of residues of a structure, since that asks for all of
    them. Residues meet with all their atoms, so pairs are not shuffled; the work and the
    rows out are the pairs themselves, which grow with the square of a crowd. Residues of
    one atom meet each other as flat rows, those of several as arrays.
    """
    keys = keys or []
    rows = atoms
    if radius is not None:
        rows = rows.filter(F.col("p")["x"].isNotNull() & F.col("p")["y"].isNotNull() & F.col("p")["z"].isNotNull())
    of = list(dict.fromkeys([*keys, "chain", "num"]))
    residues = rows.groupBy(*of).agg(F.collect_list(F.struct("p", "r")).alias("atoms"))
    single, several = residues.filter(F.size("atoms") == 1), residues.filter(F.size("atoms") > 1)
    found = _gaps_of_single_atoms(single.select(*of, *[F.get("atoms", 0)[c].alias(c) for c in ("p", "r")]), radius, keys)
    found = found.unionByName(_gaps_of_several_atoms(several, residues, radius, keys))
    return found.unionByName(_gaps_of_several_atoms(single, several, radius, keys, swapped=True))


def bounding_spheres(atoms: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, chain, centre, radius): the mean of a chain's centres and the farthest surface."""
    keys = [*(keys or []), "chain"]
    centres = atoms.groupBy(*keys).agg(*[F.avg(F.col("p")[c]).alias(f"_{c}") for c in "xyz"])
    centres = centres.select(*keys, F.struct(*[F.col(f"_{c}").alias(c) for c in "xyz"]).alias("centre"))
    return atoms.join(centres, keys).groupBy(*keys, "centre").agg(F.max(g.distance(F.col("p"), F.col("centre")) + F.col("r")).alias("radius"))


def bonds(right_ends: DataFrame, left_ends: DataFrame, longest: float = 1.8, keys: list[str] | None = None) -> DataFrame:
    """(keys, from, to): for each residue's right end (idx, n, p), the first left end in cyclic order that is nearer than longest.

    n is the number of residues in the structure.
    """
    pairs = range_join(right_ends, left_ends, longest, keys=keys).filter((F.col("l.idx") != F.col("r.idx")) & (F.col("d") < longest))
    ahead = F.pmod(F.col("r.idx") - F.col("l.idx"), F.col("l.n"))
    ks = [F.col(f"l.{k}").alias(k) for k in keys or []]
    rows = pairs.select(*ks, F.col("l.idx").alias("from"), F.col("r.idx").alias("_to"), ahead.alias("_ahead"))
    return rows.groupBy(*(keys or []), "from").agg(F.min_by("_to", "_ahead").alias("to"))


def transferred(positions: DataFrame, coordinates: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """positions (pos, atom) with the coordinate of the aligned residue's atom, or its CA where it lacks the atom."""
    keys = keys or []
    own = coordinates.select(*keys, F.col("pos"), F.col("atom"), F.col("p"))
    ca = coordinates.filter("atom = 'CA'").select(*keys, "pos", F.col("p").alias("_ca"))
    joined = positions.join(own, [*keys, "pos", "atom"], "left").join(ca, [*keys, "pos"], "left")
    return joined.withColumn("p", F.coalesce("p", "_ca")).drop("_ca")


def state_counts(dssp: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, total, helix, strand) of secondary-structure letters ss."""
    return dssp.groupBy(*(keys or [])).agg(
        F.count("*").alias("total"), F.count_if(F.col("ss").isin("H", "G", "I")).alias("helix"), F.count_if(F.col("ss").isin("B", "E")).alias("strand")
    )


def contact_map(ca: DataFrame, cutoff: float = 10.0, keys: list[str] | None = None) -> DataFrame:
    """Pairs of CA (idx, chain, p) nearer than the cutoff, with whether their chains differ."""
    pairs = range_join(ca, ca, cutoff, keys=keys).filter((F.col("l.idx") != F.col("r.idx")) & (F.col("d") < cutoff))
    ks = [F.col(f"l.{k}").alias(k) for k in keys or []]
    return pairs.select(*ks, F.col("l.idx").alias("i"), F.col("r.idx").alias("j"), "d", (F.col("l.chain") != F.col("r.chain")).alias("between_chains"))


def topological_order(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(idx, root, depth): the chain a residue belongs to, named by its first one, and its place in it.

    links (from, to) are bonds, one from each residue; nodes (idx) are all residues. Chains are
    walked from residues that no bond leads to, in order of idx, up to a residue that an earlier
    chain has; so a residue belongs to the least start from which bonds lead to it. On a ring
    without a start both are null. Walks are doubled, in rounds that grow with the logarithm of
    the longest.
    """
    known = nodes.select("idx").distinct()
    right = links.join(known.withColumnRenamed("idx", "from"), "from", "left_semi").join(known.withColumnRenamed("idx", "to"), "to", "left_semi")
    starts = known.join(right.select(F.col("to").alias("idx")), "idx", "left_anti")
    best = starts.select("idx", F.struct(F.col("idx").alias("root"), F.lit(0).cast("long").alias("depth")).alias("best"))
    #  leap has the residue `step` bonds on; best the least start at most step - 1 bonds before
    leap, step = settled(right.groupBy("from").agg(F.min("to").alias("to"))), 1
    longest = known.count()
    while step < longest and not leap.isEmpty():
        moved = best.join(leap, best["idx"] == leap["from"]).select(
            F.col("to").alias("idx"), F.struct(F.col("best.root").alias("root"), (F.col("best.depth") + step).alias("depth")).alias("best")
        )
        best = settled(best.unionByName(moved).groupBy("idx").agg(F.min("best").alias("best")))
        on = leap.select(F.col("from").alias("to"), F.col("to").alias("_next"))
        leap, step = settled(leap.join(on, "to").select("from", F.col("_next").alias("to"))), step * 2
    return nodes.join(best, "idx", "left").select("idx", "best.root", F.col("best.depth").cast("int").alias("depth"))


#: Names of the atoms that bonds between residues leave at the left and the right.
LINKING = {"protein": (["N"], ["C"]), "nucleic": (["P"], ["O3'", "O3*"])}


def residue_chains(atoms: DataFrame, kind: str = "protein", longest: float = 1.8) -> DataFrame:
    """(chain, num, root, depth) of the residues of one structure that have a linking atom, by bonds shorter than longest.

    kind is "protein" or "nucleic". Atoms (atom_idx, chain, num, resname, name, p); water is
    left out, and of repeated names the last counts.
    """
    left, right = LINKING[kind]
    end = [F.max_by("p", F.when(F.col("name").isin(names), F.col("atom_idx"))).alias(side) for side, names in (("left", left), ("right", right))]
    found = atoms.filter((F.col("resname") != "HOH") & F.col("name").isin(left + right)).groupBy("chain", "num").agg(*end)
    ends = settled(with_earlier(found, ["chain", "num"], "idx", total="n"))
    rights, lefts = (ends.filter(F.col(side).isNotNull()).select("idx", "n", F.col(side).alias("p")) for side in ("right", "left"))
    return ends.join(topological_order(bonds(rights, lefts, longest), ends.select("idx")), "idx").select("chain", "num", "root", "depth")


def relettered(atoms: DataFrame, chains: DataFrame) -> DataFrame:
    """Atoms with chain letters A to Z in order of the chains' roots; others keep theirs. More than 26 chains are an error."""
    roots = chains.filter("root is not null").select("root").distinct()
    if (n := roots.count()) > 26:
        raise ValueError(f"{n} chains, too many to name")
    letters = roots.withColumn("_letter", F.chr(64 + F.row_number().over(Window.orderBy("root"))))  # 26 rows at most
    named = chains.join(F.broadcast(letters), "root").select("chain", "num", "_letter")
    return atoms.join(named, ["chain", "num"], "left").withColumn("chain", F.coalesce("_letter", "chain")).select(atoms.columns)


def neighbour_graph(quadruples: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, node, neighbours): sorted distinct nodes that share a quadruple (an array of four)."""
    q = F.col("quadruple")
    pairs = F.flatten(F.transform(q, lambda a: F.transform(F.filter(q, lambda b: b != a), lambda b: F.struct(a.alias("node"), b.alias("other")))))
    rows = quadruples.select(*(keys or []), F.explode(pairs).alias("p")).select(*(keys or []), "p.node", "p.other")
    return rows.groupBy(*(keys or []), "node").agg(F.array_sort(F.collect_set("other")).alias("neighbours"))


def property_vectors(rows: DataFrame, tables: list[DataFrame], letter_col: str = "letter", length_col: str | None = None) -> DataFrame:
    """rows with one_hot over the 20 residues, the columns of each table (letter, ...), and relative position where a length is given."""
    hot = F.transform(F.array(*[F.lit(c) for c in ALPHABET[:20]]), lambda c: F.when(F.col(letter_col) == c, 1.0).otherwise(0.0))
    out = rows.withColumn("one_hot", hot)
    for table in tables:
        out = out.join(table.withColumnRenamed("letter", "_letter"), out[letter_col] == F.col("_letter"), "left").drop("_letter")
    return out if length_col is None else out.withColumn("position", F.col("pos") / F.col(length_col))
