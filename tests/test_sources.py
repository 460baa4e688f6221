"""Readers and writers on small hand-written files."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import structures
from helixframe.sources import archives, sequences, structures as s

PDB = """HEADER    X
ATOM      1  N   GLY A   1      11.104   6.134  -6.504  1.00 20.50           N
ATOM      2  CA  GLY A   1      11.639   6.071  -5.147  1.00 21.00           C
ATOM      3  CA BGLY A   1      11.700   6.100  -5.100  1.00 21.00           C
ATOM      4  C   GLY A   1A     12.000   7.000  -4.000  1.00  9.00           C
ATOM      5 1HB  ALA B   2       1.000   2.000   3.000  1.00  5.00
ATOM      6  CB  ALA B   2       1.000   2.000   3.000  1.00  5.00           C
ATOM  broken line
HETATM    7  O   HOH W   3       0.000   0.000   0.000  1.00  1.00           O
ATOM      8  CA  SER     4       1.500   2.500   3.500
ENDMDL
ATOM      9  N   GLY A   1       0.000   0.000   0.000  1.00  0.00           N
"""


def text(spark, tmp_path, name, content):
    (tmp_path / name).write_text(content)
    return s.lines(spark, str(tmp_path / name))


def test_pdb(spark, tmp_path):
    rows = text(spark, tmp_path, "model1.pdb", PDB)
    atoms = s.parse_pdb(rows)
    got = {r["serial"]: r for r in atoms.collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, 8}
    assert got[1]["structure_id"] == "model1"
    assert (got[1]["name"], got[1]["chain"], got[1]["resnum"], got[1]["x"], got[1]["bfactor"], got[1]["element"]) == ("N", "A", 1, 11.104, 20.5, "N")
    assert (got[8]["chain"], got[8]["bfactor"], got[8]["element"]) == ("?", 0.0, "")
    assert sorted(r["serial"] for r in structures.wanted_atoms(atoms).collect()) == [1, 2, 6, 8]
    assert sorted(r["serial"] for r in structures.wanted_atoms(atoms, True, True, True).collect()) == [1, 2, 4, 6, 7, 8]
    assert s.parse_pdb(rows, first_model=False).count() == 9
    lines = s.pdb_lines(atoms.filter("serial = 1")).first()["line"]
    assert len(lines) == 80
    assert lines[:66] == PDB.splitlines()[1][:66]
    back = s.parse_pdb(s.pdb_lines(atoms), first_model=False)
    columns = ["serial", "name", "altloc", "resname", "chain", "resnum", "icode", "x", "y", "z", "bfactor"]
    assert sorted(map(str, back.select(columns).collect())) == sorted(map(str, atoms.select(columns).collect()))


def test_backbone(spark, tmp_path):
    atoms = s.parse_pdb(text(spark, tmp_path, "m.pdb", PDB))
    found = {(r["chain"], r["num"]): r for r in structures.backbone(atoms, ["structure_id"]).collect()}
    assert found["A", 1]["ca"]["x"] == 11.639
    assert found["A", 1]["c"]["x"] == 12.0
    assert found["?", 4]["n"] is None


def test_fasta_and_a3m(spark, tmp_path):
    rows = text(spark, tmp_path, "x.fasta", ">linker3|n_3\nEAAAK\nEAAAK\n\n>two\nACD\n")
    got = sorted((r["seq_idx"], r["header"], r["sequence"]) for r in sequences.parse_fasta(rows).collect())
    assert got == [(0, "linker3|n_3", "EAAAKEAAAK"), (1, "two", "ACD")]
    assert sequences.parse_fasta(rows, first_only=True).count() == 1
    a3m = sequences.parse_a3m(text(spark, tmp_path, "x.a3m", ">q\nACDE\n>h\nAabC-kE\n")).orderBy("seq_idx").collect()
    assert [r["aligned"] for r in a3m] == ["ACDE", "AC-E"]
    assert [r["insertions"] for r in a3m] == [[0, 0, 0, 0], [0, 2, 0, 1]]


def test_hits(spark, tmp_path):
    row = "  1 1abc_A description".ljust(69) + "   12" + " " + "   3-14".rjust(9) + " " + "  5-16".rjust(9) + "(99)"
    row = row[:69] + "    12" + "     3-14" + " " + "     5-16 (99)"
    lead = " " * 22
    block = [
        ">1abc_A", "Probab=99.50  E-value=1e-30  Score=200.1  Aligned_cols=12  Identities=30%  Similarity=0.5  Sum_probs=9.1  Template_Neff=8.0", "", "",
        "Q query          3 ACDEFGH-KLMNP  14 (20)", "Q Consensus", lead + "||||||| +++++", "T Consensus", "T 1abc_A          5 ACDEFGHIKLM-P  16 (30)", "T ss", "x", "Confidence".ljust(22) + "9999999 99999", "",
    ]
    content = "\n".join(["Query q", "", " No Hit", row, "", *block])
    hits = sequences.parse_hits(text(spark, tmp_path, "h.hhr", content))
    r = hits.first()
    assert (r["label"], r["qstart"], r["tstart"], r["prob"], r["seqid"], r["neff"]) == ("1abc_A", 2, 4, 0.995, 0.3, 0.8)
    matches = sorted((m["q"], m["t"], m["similarity"], m["confidence"]) for m in sequences.hit_matches(hits).collect())
    assert matches[0] == (2, 4, 4, 9)
    assert len(matches) == 12
    assert sequences.parse_hits(text(spark, tmp_path, "h.hhr", content), most_identity=20.0).count() == 0
    other = spark.createDataFrame([("2xyz_B",)], "name string")
    assert sequences.parse_hits(text(spark, tmp_path, "h.hhr", content), other).count() == 0


def test_archive(spark, tmp_path):
    entries = {"b": "second entry", "a": "first", "c": "x" * 50}
    frame = spark.createDataFrame(list(entries.items()), "name string, text string")
    index = sequences.archive_index(frame).orderBy("offset").collect()
    blob = b"".join(entries[r["name"]].encode() + b"\0" for r in index)
    (tmp_path / "data.ffdata").write_bytes(blob)
    (tmp_path / "data.ffindex").write_text("".join(f"{r['name']}\t{r['offset']}\t{r['length']}\n" for r in index))
    read = sequences.read_archive_index(spark, str(tmp_path / "data.ffindex"))
    blobs = sequences.archive_blobs(spark, str(tmp_path / "data.ffdata"))
    assert {r["name"]: r["text"] for r in sequences.archive_entries(read, blobs).collect()} == entries
    one = spark.createDataFrame([("c",)], "name string")
    assert [r["text"] for r in sequences.archive_entries(read, blobs, one).collect()] == ["x" * 50]


def test_dssp_and_containers(spark, tmp_path):
    dssp = "junk\n  #  RESIDUE AA STRUCTURE\n    1    1 A G  H\n    2    2 A A  E\n    3        !\n    4    4AB C\n"
    got = sorted((r["resnum"], r["icode"], r["chain"], r["aa"], r["ss"]) for r in s.parse_dssp(text(spark, tmp_path, "x.dssp", dssp)).collect())
    assert got == [(1, "", "A", "G", "H"), (2, "", "A", "A", "E"), (4, "A", "B", "C", "")]
    counts = structures.state_counts(s.parse_dssp(text(spark, tmp_path, "x.dssp", dssp))).first()
    assert (counts["total"], counts["helix"], counts["strand"]) == (3, 1, 1)
    body = "# note\natoms\n2\nA 1 x\n\nB 2 y\ncontacts\n1\n0 1 2.5\n"
    rows = text(spark, tmp_path, "c.txt", body)
    assert [r["fields"] for r in s.parse_container(rows, "atoms").orderBy("ordinal").collect()] == [["A", "1", "x"], ["B", "2", "y"]]
    assert [r["fields"] for r in s.parse_container(rows, "contacts").collect()] == [["0", "1", "2.5"]]
    frame = spark.createDataFrame([("B", 2), ("A", 1)], "chain string, num int")
    assert [r["line"] for r in s.container_lines(frame, "residues", ["chain"]).orderBy("line_no").collect()] == ["residues", "2", "A 1", "B 2"]


def test_radii(spark, tmp_path):
    (tmp_path / "classes").write_text("CA  1.90\n\nC  1.75\nN 1.70\n")
    (tmp_path / "members").write_text("*_CA  CA\nGLY_C*  C\n*_N* N\n")
    classes, members = s.radius_tables(spark, str(tmp_path / "classes"), str(tmp_path / "members"))
    atoms = spark.createDataFrame([(0, "GLY", "CA"), (1, "ALA", "CA"), (2, "ALA", "CB"), (3, "ALA", "NZ")], "atom_idx int, resname string, name string")
    got = {r["atom_idx"]: r["r"] for r in structures.with_radius(atoms, members, classes).collect()}
    assert got == {0: 1.75, 1: 1.9, 2: None, 3: 1.7}


def test_map_image(spark):
    frame = spark.createDataFrame([(0, 1, 0.0), (1, 0, 1.0)], "a_idx int, b_idx int, v double")
    assert {r["rgb"] for r in s.map_image(frame, F.col("v")).collect()} == {255, 255 * 65536}


def test_score_listings(spark, tmp_path):
    tm = "x\nTM-score    = 0.7514  (d0= 3.00)\nGDT-TS-score= 0.6612 %(d<1)=0.4 %(d<2)\n"
    r = s.tm_scores(text(spark, tmp_path, "a.tm", tm)).first()
    assert (r["TM_score"], r["TM_score_GDT_TS"], r["TM_score_GDT_HA"]) == (0.7514, 0.6612, 0.0)
    horiz = "Conf: 998\nPred: CCH\n  AA: MKV\n\nConf: 12\nPred: HH\n"
    r = s.secondary_structure(text(spark, tmp_path, "a.horiz", horiz)).first()
    assert (r["ss_pred"], r["ss_conf"]) == ("CCHHH", "99812")


def make_archive(folder, stem, entries, order=None):
    """A data file in the given order and its index in order of name."""
    data, index = b"", []
    for name in order or list(entries):
        body = entries[name].encode() + b"\0"
        index.append((name, len(data), len(body)))
        data += body
    (folder / f"{stem}.ffdata").write_bytes(data)
    (folder / f"{stem}.ffindex").write_text("".join(f"{n}\t{o}\t{s}\n" for n, o, s in sorted(index)))


@pytest.mark.parametrize("index_bytes", [7, 64, 1 << 20])
def test_archives_by_range(spark, tmp_path, index_bytes):
    rng = random.Random(3)
    entries = {f"e{i:03}": "".join(rng.choice("aé😀\n>") for _ in range(rng.randrange(200))) for i in range(120)} | {"": "no name", "last": ""}
    make_archive(tmp_path, "one", entries, rng.sample(list(entries), len(entries)))
    make_archive(tmp_path, "two", {"e005": "again", "x": "y"})
    make_archive(tmp_path, "none", {})
    archives.read_archives(spark, str(tmp_path / "one.ffindex"))  # registers the source
    read = spark.read.format("indexed_archive").option("index_bytes", index_bytes).load(str(tmp_path / "*.ffindex"))
    got = sorted((r["archive"].rsplit("/", 1)[1], r["name"], r["text"]) for r in read.collect())
    assert got == sorted([("one.ffindex", n, t) for n, t in entries.items()] + [("two.ffindex", "e005", "again"), ("two.ffindex", "x", "y")])
    some = read.filter(F.col("name").isin("e005", "e077", "missing") & (F.length("text") > 0))
    assert sorted(r["name"] for r in some.collect()) == ["e005", "e005", "e077"]
    assert [r["text"] for r in read.filter("name = 'x'").collect()] == ["y"]
    assert read.filter("name = 'x' AND name = 'e005'").count() == 0


def test_archives_read_only_what_is_asked_for(spark, tmp_path, monkeypatch):
    """Bytes of the data file that a reader fetches are those of the entries."""
    entries = {f"e{i}": chr(97 + i % 26) * 5000 for i in range(500)}
    make_archive(tmp_path, "big", entries)
    fetched = []

    class Counted:
        def __init__(self, file):
            self.file = file

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def size(self):
            return self.file.size()

        def read_at(self, n, at):
            fetched.append(n)
            return self.file.read_at(n, at)

    class Store:
        def open_input_file(self, name):
            opened = archives.fs.LocalFileSystem().open_input_file(name)
            return Counted(opened) if name.endswith("ffdata") else opened

        def get_file_info(self, name):
            return archives.fs.LocalFileSystem().get_file_info(name)

    monkeypatch.setattr(archives, "file_system", lambda path: (Store(), path))
    reader = archives.ArchiveReader({"path": str(tmp_path / "big.ffindex"), "index_bytes": "1000"})
    left = list(reader.pushFilters([archives.In(("name",), ["e7", "e450", "none"]), archives.EqualTo(("text",), "x")]))
    assert left == [archives.EqualTo(("text",), "x")]
    assert len(reader.partitions()) > 5
    names = [n for part in reader.partitions() for batch in reader.read(part) for n in batch.column("name").to_pylist()]
    assert sorted(names) == ["e450", "e7"] and sum(fetched) == 2 * 5000
    with pytest.raises(ValueError, match="ffindex"):
        archives.data_file("other.txt")


def test_archive_filters_are_pushed(spark, tmp_path):
    make_archive(tmp_path, "one", {"a": "1", "b": "2"})
    found = archives.read_archives(spark, str(tmp_path / "one.ffindex"), ["b"])
    assert [(r["name"], r["offset"], r["text"]) for r in found.collect()] == [("b", 2, "2")]
    assert " Filter " not in found._jdf.queryExecution().executedPlan().toString()
