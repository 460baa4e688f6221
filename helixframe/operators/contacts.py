"""Contact algebra: classes, roll-up to residues, filters, combination, summaries.

Residue contacts are long: (a_chain, a_num, b_chain, b_num, class, area), with optional
leading keys such as the structure. Contacts are directed and never symmetrised.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.geometry import halfspace
from helixframe.functions.text import node_name
from helixframe.operators.relational import full_outer_merge, interval_group, merge_by_tag

ENDS = ["a_chain", "a_num", "b_chain", "b_num"]
KEY = [*ENDS, "class"]


def same_residue() -> Column:
    return (F.col("a_chain") == F.col("b_chain")) & (F.col("a_num") == F.col("b_num"))


def covalent(a_atom: Column, b_atom: Column) -> Column:
    """Atoms of neighbouring residues of a chain that a peptide or phosphodiester bond joins."""
    next_to = (F.col("a_chain") == F.col("b_chain")) & (F.abs(F.col("a_num") - F.col("b_num")) == 1)
    def bond(x: str, y: str) -> Column:
        ahead = F.col("b_num") > F.col("a_num")
        return F.when(ahead, (a_atom == x) & (b_atom == y)).otherwise((a_atom == y) & (b_atom == x))
    return next_to & (bond("C", "N") | bond("O3'", "P"))


#: What an atom contact is: main-chain or side-chain atom (M, S) at each end, or W for solvent.
KINDS = ("MM", "MS", "SM", "SS", "MW", "SW")


def contact_kind(a_main: Column, b_main: Column, solvent: Column) -> Column:
    a, b = (F.when(main, "M").otherwise("S") for main in (a_main, b_main))
    return F.concat(a, F.when(solvent, "W").otherwise(b))


def kinds_by_class() -> dict[str, list[str]]:
    """The kinds whose areas add up to each class; A stands for either atom."""
    classes: dict[str, list[str]] = {}
    for a, b in KINDS:
        for name in [a + b, f"A{b}"] if b == "W" else [a + b, f"A{b}", f"{a}A", "AA"]:
            classes.setdefault(name, []).append(a + b)
    return classes


def residue_contacts(atom_contacts: DataFrame, atoms: DataFrame, atom_key: str = "atom_idx", keys: list[str] | None = None) -> DataFrame:
    """Atom contacts (a, b, area) over atoms (atom_idx, chain, num, name, main) to residue contacts.

    Each contact adds its area to all of its classes. Contacts within a residue count only
    as solvent (a = b), and covalent ones and those without an area not at all.
    """
    keys = keys or []
    columns = ["chain", "num", "name", "main"]
    a, b = (atoms.select(*keys, F.col(atom_key).alias(s), *[F.col(c).alias(f"{s}_{c}") for c in columns]) for s in "ab")
    joined = atom_contacts.join(a, [*keys, "a"]).join(b, [*keys, "b"])
    solvent = F.col("a") == F.col("b")
    joined = joined.filter(solvent | (~same_residue() & ~covalent(F.col("a_name"), F.col("b_name"))))
    rows = joined.select(*keys, *ENDS, contact_kind(F.col("a_main"), F.col("b_main"), solvent).alias("_kind"), "area")
    #  one row for each pair of residues, with its kinds side by side; only then one for each class
    sums = rows.groupBy(*keys, *ENDS).agg(*[F.sum(F.when(F.col("_kind") == k, F.col("area"))).alias(k) for k in KINDS])
    areas = {name: reduce(lambda x, y: F.coalesce(x + y, x, y), [F.col(k) for k in kinds]) for name, kinds in kinds_by_class().items()}
    classes = F.array(*[F.struct(F.lit(name).alias("class"), area.alias("area")) for name, area in areas.items()])
    return sums.select(*keys, *ENDS, F.inline(classes)).filter("area is not null")


def inter_chain(contacts: DataFrame) -> DataFrame:
    return contacts.filter(F.col("a_chain") != F.col("b_chain"))


def _residues(rows: DataFrame, keys: list[str], end: str) -> DataFrame:
    return rows.select(*keys, F.col(f"{end}_chain").alias("_chain"), F.col(f"{end}_num").alias("_num")).distinct()


def _by_end(contacts: DataFrame, residues: DataFrame, keys: list[str], how: str) -> DataFrame:
    for end in "ab":
        named = residues.select(*keys, F.col("_chain").alias(f"{end}_chain"), F.col("_num").alias(f"{end}_num"))
        contacts = contacts.join(named, [*keys, f"{end}_chain", f"{end}_num"], how)
    return contacts


def core(contacts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Contacts of which neither end has solvent-accessible area (AW on itself)."""
    keys = keys or []
    exposed = _residues(contacts.filter(same_residue() & (F.col("class") == "AW")), keys, "a")
    return _by_end(contacts, exposed, keys, "left_anti").select(contacts.columns)


def interface_zone(contacts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Contacts of which both ends touch another chain."""
    keys = keys or []
    across = inter_chain(contacts)
    touching = _residues(across, keys, "a").union(_residues(across, keys, "b")).distinct()
    return _by_end(contacts, touching, keys, "left_semi").select(contacts.columns)


def inter_interval(contacts: DataFrame, intervals: list[tuple[int, str, int, int]]) -> DataFrame:
    """Contacts between residues of two different interval groups."""
    a, b = (interval_group(F.col(f"{e}_chain"), F.col(f"{e}_num"), intervals) for e in "ab")
    return contacts.filter(a.isNotNull() & b.isNotNull() & (a != b))


def filtered(contacts: DataFrame, core_only=False, zone=False, across=False, intervals=None, keys: list[str] | None = None) -> DataFrame:
    """Core, zone, inter-chain and interval filters, each on what the one before left."""
    if core_only:
        contacts = core(contacts, keys)
    if zone:
        contacts = interface_zone(contacts, keys)
    if across:
        contacts = inter_chain(contacts)
    return inter_interval(contacts, intervals) if intervals else contacts


def with_reflexive(kept: DataFrame, everything: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """kept, and the contacts of its residues with themselves; existing rows win."""
    keys = keys or []
    residues = _residues(kept, keys, "a").union(_residues(kept, keys, "b")).distinct()
    own = _by_end(everything.filter(same_residue()), residues, keys, "left_semi").select(everything.columns)
    return kept.unionByName(own.join(kept, [*keys, *KEY], "left_anti").select(kept.columns))


def combined(target: DataFrame, model: DataFrame, keys: list[str] | None = None, binarize: bool = False) -> DataFrame:
    """(keys, ends, class, t_area, m_area): the full outer merge, missing areas 0; binarized areas are 0 or 1."""
    merged = merge_by_tag(target, model, [*(keys or []), *KEY], "area", ("t_area", "m_area"))
    if binarize:
        merged = merged.withColumns({c: F.when(F.col(c) > 0, 1.0).otherwise(0.0) for c in ("t_area", "m_area")})
    return merged


def combined_atoms(target: DataFrame, model: DataFrame, across: bool = False) -> DataFrame:
    """The merge of atom contacts keyed by (chain, num, atom) at both ends; of repeated keys the one of largest ordinal.

    Pairs within a residue are left out.
    """
    atom_key = ["a_chain", "a_num", "a_atom", "b_chain", "b_num", "b_atom"]
    sides = [
        side.groupBy(*atom_key).agg(F.max_by("area", "ordinal").alias(name)) for side, name in ((target, "t_area"), (model, "m_area"))
    ]
    merged = full_outer_merge(*sides, atom_key, {"t_area": 0.0, "m_area": 0.0}).filter(~same_residue())
    return inter_chain(merged) if across else merged


def chain_names(contacts: DataFrame) -> DataFrame:
    return contacts.select(F.explode(F.array("a_chain", "b_chain")).alias("chain")).distinct()


def summary(contacts: DataFrame) -> DataFrame:
    """(name, area): all_<class>, inter_chain_<a>_<b>_<class> and sas, the sum of AW.

    One pass of grouping sets over rows that map tasks have combined.
    """
    split = F.col("a_chain") != F.col("b_chain")
    rows = contacts.select(
        "class", "area", F.when(split, F.col("a_chain")).alias("ca"), F.when(split, F.col("b_chain")).alias("cb")
    ).groupBy("class", "ca", "cb").agg(F.sum("area").alias("area"))
    grouped = rows.groupingSets([["class"], ["class", "ca", "cb"]], "class", "ca", "cb").agg(F.sum("area").alias("area"), F.grouping("ca").alias("whole"))
    named = grouped.select(
        F.when((F.col("whole") == 1) & (F.col("class") == "AW"), "sas")
        .when(F.col("whole") == 1, F.concat(F.lit("all_"), "class"))
        .when(F.col("ca").isNotNull(), F.concat(F.lit("inter_chain_"), "ca", F.lit("_"), "cb", F.lit("_"), "class"))
        .alias("name"),
        "area",
    )
    return named.filter("name is not null")


def exposure(contacts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Contacts with, on each residue's contact with itself, what it exposes to other chains: <class>_exposed and <class>_exposed_to_<chain>."""
    keys = keys or []
    across = inter_chain(contacts)
    both = F.array(F.concat("class", F.lit("_exposed")), F.concat("class", F.lit("_exposed_to_"), "b_chain"))
    own = across.select(
        *keys, "a_chain", "a_num", F.col("a_chain").alias("b_chain"), F.col("a_num").alias("b_num"), F.explode(both).alias("class"), "area"
    )
    own = own.groupBy(*keys, *KEY).agg(F.sum("area").alias("area"))
    return contacts.unionByName(own.select(contacts.columns))


def graph_edges(contacts: DataFrame) -> DataFrame:
    """(from, to, weight): ceil(100 area) of contacts between different residues."""
    return contacts.filter(~same_residue()).select(
        node_name(F.col("a_chain"), F.col("a_num")).alias("from"),
        node_name(F.col("b_chain"), F.col("b_num")).alias("to"),
        F.ceil(F.col("area") * 100).alias("weight"),
    )


def stacking_labels(contacts: DataFrame, planes: DataFrame, side_atoms: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Adds stacking rows for SS contacts of nucleotides.

    planes: (chain, num, origin, normal) of residue a's ring; side_atoms: (chain, num, p).
    All of b's atoms on one side of the plane make the contact na_stacking, and _up or
    _down; otherwise it is na_siding. Atoms in one place count once, and what faces a plane
    is told once for each plane, however many contacts ask.
    """
    keys = keys or []
    ss = contacts.filter(F.col("class") == "SS")
    named = planes.select(*keys, F.col("chain").alias("a_chain"), F.col("num").alias("a_num"), "origin", "normal")
    atoms = side_atoms.select(*keys, F.col("chain").alias("b_chain"), F.col("num").alias("b_num"), "p").distinct()
    faced = ss.join(named, [*keys, "a_chain", "a_num"]).withColumn("plane", F.struct("origin", "normal")).drop("origin", "normal")
    asked = faced.select(*keys, "b_chain", "b_num", "plane").distinct()
    side = halfspace(F.col("p"), F.col("plane.origin"), F.col("plane.normal"))
    told = asked.join(atoms, [*keys, "b_chain", "b_num"]).withColumn("side", side).groupBy(*keys, "b_chain", "b_num", "plane").agg(F.min("side").alias("low"), F.max("side").alias("high"))
    on = [F.col(f"f.{k}") == F.col(f"t.{k}") for k in (*keys, "b_chain", "b_num")] + [F.col("f.plane").eqNullSafe(F.col("t.plane"))]
    sides = faced.alias("f").join(told.alias("t"), on).select("f.*", "t.low", "t.high").groupBy(*keys, *ENDS, "area").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    labels = F.when((F.col("low") == F.col("high")) & (F.col("low") != 0), F.array(F.lit("na_stacking"), F.when(F.col("low") > 0, "na_stacking_up").otherwise("na_stacking_down")))
    added = sides.select(*keys, *ENDS, F.explode(labels.otherwise(F.array(F.lit("na_siding")))).alias("class"), "area")
    return contacts.unionByName(added.select(contacts.columns))


def accepted_contacts(contacts: DataFrame, policy: str, inside=None, intervals=None, side_only: bool = False) -> DataFrame:
    """Contacts that an interface picture shows.

    policy: inter_chain (chains "?" left out), inside (both ends among the chains inside),
    inter_residue (side_only for SS alone) or inter_interval (a single group: one end in
    it, the other in none).
    """
    if policy == "inter_chain":
        return inter_chain(contacts).filter((F.col("a_chain") != "?") & (F.col("b_chain") != "?"))
    if policy == "inside":
        return contacts.filter(F.col("a_chain").isin(*inside) & F.col("b_chain").isin(*inside))
    if policy == "inter_residue":
        rows = contacts.filter(~same_residue())
        return rows.filter(F.col("class") == "SS") if side_only else rows
    if policy == "inter_interval":
        if len({group for group, *_ in intervals}) > 1:
            return inter_interval(contacts, intervals)
        a, b = (interval_group(F.col(f"{e}_chain"), F.col(f"{e}_num"), intervals).isNotNull() for e in "ab")
        return contacts.filter(a != b)
    raise ValueError(f"no policy {policy!r}")
