"""Readers, on small files written here."""

import gzip
import io
import json
import tarfile
import zipfile

import pytest

from strandline.operators import structure
from strandline.sources import archives, tar_source, tables, text


def put(path, content):
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return f"file://{path}"


def test_fasta(spark, tmp_path):
    a = put(tmp_path / "a.fa", "junk line\n>one first\nACGT\nAC\n>two\n\n>three x\nGG\r\nTT\n")
    b = put(tmp_path / "b.fa.gz", gzip.compress(b">z\nAAA\n>y\nCC\n"))
    got = {(r.header, r.sequence) for r in text.read_fasta(spark, [a, b]).collect()}
    assert got == {("two", ""), ("three x", "GGTT"), ("z", "AAA"), ("y", "CC")} | ({("one first", "ACGTAC")} & got)
    c = put(tmp_path / "c.fa", ">one first\nACGT\nAC\n>two\nG\n")
    assert [(r.header, r.sequence) for r in text.read_fasta(spark, c, limit=1).collect()] == [("one first", "ACGTAC")]


def test_tar_fasta_keeps_what_a_broken_archive_gave(spark, tmp_path):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w:gz") as t:
        for name, data in (("x/1.fa", b">a\nAC\nGT\n"), ("x/2.fa", b">b\n" + bytes(range(65, 90)) * 8000)):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    whole = put(tmp_path / "whole.tgz", raw.getvalue())
    broken = put(tmp_path / "broken.tgz", raw.getvalue()[:-200])
    records, status = archives.read_tar_fasta(spark, [whole, broken])
    assert {(r.path.rsplit("/")[-1], r.truncated) for r in status.collect()} == {("whole.tgz", False), ("broken.tgz", True)}
    got = {(r.path.rsplit("/")[-1], r.header) for r in records.collect()}
    assert {("whole.tgz", "a"), ("whole.tgz", "b"), ("broken.tgz", "a")} <= got
    assert {r.id for r in archives.archive_ids(spark, whole, ".fa").collect()} == set()


@pytest.mark.parametrize("kind", [tarfile.USTAR_FORMAT, tarfile.GNU_FORMAT, tarfile.PAX_FORMAT])
def test_streamed_tars_give_the_same_records(spark, tmp_path, kind):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w:gz", format=kind) as t:
        folder = tarfile.TarInfo("x")
        folder.type = tarfile.DIRTYPE
        t.addfile(folder)
        for i in range(30):
            data = b"".join(b">r%d_%d of it\nACGT\n%s\r\n" % (i, j, b"GA" * (j * i % 700)) for j in range(i % 4)) + (b">last%d\nUU" % i if i % 2 else b"")
            info = tarfile.TarInfo(f"x/{'deep/' * (i % 30)}{i}.fa")
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    whole = put(tmp_path / "whole.tar.gz", raw.getvalue())
    expect = sorted((r.member, r.header, r.sequence) for r in archives.read_tar_fasta(spark, whole)[0].collect())
    got = sorted((r.member, r.header, r.sequence) for r in archives.stream_tar_fasta(spark, whole).collect())
    if kind == tarfile.USTAR_FORMAT:
        assert got == expect
    assert [r[1:] for r in sorted(got, key=lambda r: r[1:])] == [r[1:] for r in sorted(expect, key=lambda r: r[1:])]
    broken = put(tmp_path / "broken.tar.gz", raw.getvalue()[: len(raw.getvalue()) // 2])
    assert {(r.header, r.sequence) for r in archives.stream_tar_fasta(spark, broken).collect()[:-1]} <= {r[1:] for r in expect}
    with pytest.raises(ValueError):
        archives.stream_tar_fasta(spark, "file:///x/plain.tar")


STOCKHOLM = """# STOCKHOLM 1.0
#=GF ID   tRNA
#=GF AC   RF00005.12
s1   ACG-
s2   AC.U
#=GC SS_cons  <..
s1   UU
s2   GG
#=GC SS_cons  .>
//
# STOCKHOLM 1.0
#=GF ID   other
#=GF AC   RF1
q   AA
//
"""


def test_stockholm(spark, tmp_path):
    rows = text.read_stockholm(spark, put(tmp_path / "f.sto", STOCKHOLM)).orderBy("accession", "row_no").collect()
    assert [(r.family, r.accession, r.row_no, r.name, r.aligned, r.ss_cons) for r in rows] == [
        ("tRNA", "RF00005", 0, "s1", "ACG-UU", "<...>"), ("tRNA", "RF00005", 1, "s2", "AC.UGG", "<...>"), ("other", "RF1", 0, "q", "AA", "")]


def test_rdat(spark, tmp_path):
    p = put(tmp_path / "a.rdat", "RDAT_VERSION\t0.34\nNAME\tx\nSEQUENCE\tACGUAC\nSTRUCTURE\t......\nOFFSET\t10\nSEQPOS\tA11\tC12\tG99\nANNOTATION\tchemical:MgCl2:10mM modifier:DMS\nANNOTATION_DATA:1\tchemical:Mg:5mM\nREACTIVITY:1\t0.5\tnan\t2\n")
    q = put(tmp_path / "b.rdat", "NAME y\nSEQUENCE AC\nOFFSET 0\n")
    files, rows = text.read_rdat(spark, [p, q])
    assert {(r.name, r.sequence, r.offset) for r in files.collect()} == {("x", "ACGUAC", 10), ("y", "AC", 0)}
    assert [r.annotations for r in files.where("name = 'x'").collect()] == [["chemical:MgCl2:10mM", "modifier:DMS"]]
    got = text.titration_examples(files, rows).collect()
    assert [(r.row, r.pos, r.reactivity) for r in got] == [(1, 0, 0.5)]


def test_front_matter_cmscan_ccd(spark, tmp_path):
    p = put(tmp_path / "e.md", "---\nrmdb_id: X_1\nions: [Mg, 'Na']\n---\nbody ions: no\n")
    r = text.read_front_matter(spark, p, ["rmdb_id", "gone"], ["ions"]).first()
    assert (r.rmdb_id, r.gone, r.ions) == ("X_1", None, ["Mg", "Na"])
    line = "tRNA RF5 1abc_A - cm 1 70 1 70 + no 1 0.5 0.0 {} {} {} -\n"
    s = text.read_cmscan(spark, put(tmp_path / "c.tbl", "# head\n" + line.format(50.1, "1e-9", "!") + line.format(9, 1, "?") + "short row\n")).collect()
    assert [(r.chain, r.family, r.score, r.evalue) for r in s] == [("1abc_A", "tRNA", 50.1, 1e-9)]
    c = put(tmp_path / "ccd.cif", "data_PSU\n_chem_comp.name   \"PSEUDOURIDINE\"\n_chem_comp.type 'RNA LINKING'\n_chem_comp.mon_nstd_parent_comp_id U\ndata_XXX\n_chem_comp.name\n;long name\nhere\n;\n_chem_comp.type ?\n")
    got = {r.comp: (r.name, r.type, r.mon_nstd_parent_comp_id) for r in text.read_ccd(spark, c).collect()}
    assert got == {"PSU": ("PSEUDOURIDINE", "RNA LINKING", "U"), "XXX": ("long name\nhere", None, None)}
    assert text.read_ccd(spark, c, spark.createDataFrame([("PSU",)], "comp string")).count() == 1


def test_pdb(spark, tmp_path):
    atom = "ATOM  {:>5} {:<4}{:1}{:>3} {:1}{:>4}{:1}   {:8.3f}{:8.3f}{:8.3f}{:6.2f}{:6.2f}          {:>2}\n"
    body = "MODEL        1\n" + atom.format(1, " P", "", "A", "B", 7, "", 1, 2, -3.5, 1, 20, "P") + "ENDMDL\nMODEL        2\n" + atom.format(1, " P", "", "A", "B", 7, "", 9, 9, 9, 1, 20, "P")
    rows = text.read_pdb_atoms(spark, put(tmp_path / "1abc.pdb", body))
    assert [(r.entry, r.chain, r.seq_id, r.comp, r.atom, r.x, r.z, r.b, r.model) for r in rows.orderBy("model").collect()][0] == ("1abc", "B", 7, "A", "P", 1.0, -3.5, 20.0, 1)
    assert structure.first_conformers(rows).count() == 1


CIF = """data_1ABC
_entry.id 1ABC
loop_
_entity_poly.entity_id
_entity_poly.type
_entity_poly.pdbx_strand_id
1 polyribonucleotide A
2 'polydeoxyribonucleotide/polyribonucleotide hybrid' B,C
#
loop_
_atom_site.group_PDB
_atom_site.auth_asym_id
_atom_site.label_seq_id
_atom_site.label_comp_id
_atom_site.label_atom_id
_atom_site.type_symbol
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.pdbx_PDB_model_num
ATOM A 1 A P P 1 2 3 1
ATOM A 1 A P P 9 9 9 1
ATOM A 1 A "O2'" O 1 1 1 1
ATOM B 1 DA P P 4 4 4 1
ATOM B 2 U P P 5 5 5 1
ATOM B 2 U "O2'" O 5 5 6 1
ATOM A 1 A H1 H 0 0 0 1
ATOM A . HOH O O 0 0 0 1
ATOM A 1 A P P 7 7 7 2
#
loop_
_ndb_struct_na_base_pair.i_auth_asym_id
_ndb_struct_na_base_pair.i_label_seq_id
_ndb_struct_na_base_pair.j_auth_asym_id
_ndb_struct_na_base_pair.j_label_seq_id
_ndb_struct_na_base_pair.hbond_type_12
_ndb_struct_na_base_pair.hbond_type_28
A 5 A 2 1 20
A 2 A 5 3 20
A 1 B 9 1 19
A 3 A 4 ? ?
"""


def test_mmcif(spark, tmp_path):
    p = put(tmp_path / "1abc.cif.gz", gzip.compress(CIF.encode()))
    rows = archives.read_mmcif(spark, p, ["_atom_site", "_entity_poly", "_ndb_struct_na_base_pair", "_entry"]).cache()
    assert rows.where("category = '_entry'").first().fields == {"id": "1ABC"}
    entities = archives.mmcif_entities(rows)
    assert {(r.chain, r.poly_type.split("/")[0]) for r in entities.collect()} == {("A", "polyribonucleotide"), ("B", "polydeoxyribonucleotide"), ("C", "polydeoxyribonucleotide")}
    atoms = structure.first_conformers(archives.mmcif_atoms(rows))
    kept = structure.hybrid_rule(atoms, entities)
    assert sorted((r.chain, r.seq_id, r.atom, r.x) for r in kept.collect()) == [("A", 1, "O2'", 1.0), ("A", 1, "P", 1.0), ("B", 2, "O2'", 5.0), ("B", 2, "P", 5.0)]
    pairs = {(r.chain, r.i, r.j): r.lw for r in archives.base_pair_annotations(rows).collect()}
    assert pairs == {("A", 2, 5): 3, ("A", 3, 4): 0}
    assert archives.valid_entries(spark, p).first().valid in (True, False)


def test_tables(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    d = put(tmp_path / "csv" / "assay_x.csv", "﻿mutant,DMS_score\nC1G,0.5\n").rsplit("/", 1)[0]
    t = tables.read_csv_dir(spark, d).first()
    assert (t.assay, t.mutant, t.DMS_score) == ("assay_x", "C1G", "0.5")
    p = put(tmp_path / "p.csv", "sequence,experiment_type,reactivity_0001,reactivity_error_0001,reactivity_0002\nAC,DMS,0.5,9,\nGG,2A3,NaN,9,1\n")
    assert [r.reactivity for r in tables.read_probing_csv(spark, p).orderBy("sequence").collect()] == [[0.5, None], [None, 1.0]]
    i = tables.read_inventory_csv(spark, put(tmp_path / "i.csv", "pdb_id,resolution,has_rna\n1abc,2.5,True\n2abc,x,no\n"), ["resolution"]).orderBy("pdb_id").collect()
    assert [(r.resolution, r.has_rna) for r in i] == [(2.5, True), (None, False)]
    j = put(tmp_path / "j.json", json.dumps({"records": [1, 2, 3]}))
    k = put(tmp_path / "k.json", "[1, 2]")
    m = put(tmp_path / "m.json", '{"a": 1, "b": 2}')
    assert {r.path.rsplit("/")[-1]: r.n_records for r in tables.json_record_counts(spark, [j, k, m]).collect()} == {"j.json": 3, "k.json": 2, "m.json": 2}
    z = tmp_path / "a.zip"
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("in/one.csv", "mutant,score\nA1C,2\n,3\n")
    assert [(r.assay, r.row, r.fields) for r in archives.read_zip_csv(spark, f"file://{z}").collect()] == [("one", 0, {"mutant": "A1C", "score": "2"}), ("one", 1, {"score": "3"})]
    mot = put(tmp_path / "hairpin.json", json.dumps([{"motif_id": "H1", "bp_signature": "cWW-F", "num_instances": 2, "alignment": {"i1": {"1": "u"}}}]))
    r = tables.read_motif_json(spark, mot).first()
    assert (r.kind, r.motif_id, r.alignment) == ("hairpin", "H1", {"i1": {"1": "u"}})


def test_files_and_integrity(spark, tmp_path):
    put(tmp_path / "good.gz", gzip.compress(b"hello"))
    put(tmp_path / "bad.gz", b"\x1f\x8b no")
    put(tmp_path / "left.part", b"x")
    put(tmp_path / "plain.txt", b"x")
    got = {r.path.rsplit("/")[-1]: r.status for r in archives.integrity(spark, f"file://{tmp_path}").collect()}
    assert got == {"good.gz": "OK", "bad.gz": "FAIL", "left.part": "FAIL", "plain.txt": "SKIP"}
    sums = archives.checksums(spark, f"file://{tmp_path}").collect()
    assert len(sums) == 4 and all(len(r.sha256) == 64 for r in sums)


def test_sinks(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "'ACG' AS sequence", "if(id % 2 = 0, 'train', 'val') AS split")
    tables.write_sequence_shards(df.select("id", "sequence").coalesce(1), f"file://{tmp_path}/shards", 4)
    assert len([p for p in (tmp_path / "shards").iterdir() if p.suffix == ".parquet"]) == 3
    assert tables.read_sequence_parquet(spark, f"file://{tmp_path}/shards").count() == 10
    tables.write_splits(df, f"file://{tmp_path}/splits")
    assert {p.name for p in (tmp_path / "splits").iterdir() if p.is_dir()} == {"split=train", "split=val"}
    assert tables.append_run_log(spark.range(2).selectExpr("id AS step", "1.0 AS loss", "2 AS extra"), f"file://{tmp_path}/log", ["step", "loss"]) == ["extra"]
    with pytest.raises(ValueError):
        from strandline.operators.catalog import upsert_guard

        upsert_guard(df.where("id > 99"), "bulk data")


@pytest.mark.parametrize("packed", [True, False])
def test_archives_as_a_data_source(spark, tmp_path, packed):
    """Plain and gzipped tars give the same records; one cut anywhere, even between members, is told."""
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w:gz" if packed else "w") as t:
        for i in range(12):
            data = b"".join(b">r%d_%d\nACGT\n%s\n" % (i, j, b"GA" * (900 * j)) for j in range(i % 3)) + b">last%d\nUU" % i
            info = tarfile.TarInfo(f"x/{i}.fa")
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
        folder = tarfile.TarInfo("y")
        folder.type = tarfile.DIRTYPE
        t.addfile(folder)
    whole = raw.getvalue()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "whole.tar").write_bytes(whole)
    (tmp_path / "in" / "half.tar").write_bytes(whole[: len(whole) // 2])
    # A plain tar of its first member alone ends at a block, without the zeros that close it.
    (tmp_path / "in" / "first.tar").write_bytes(whole[:200] if packed else whole[:1024])
    records, status = tar_source.read_archives(spark, f"{tmp_path}/in/*.tar")
    told = {r.path.rsplit("/")[-1]: (r.records, r.truncated) for r in status.collect()}
    expect = [(f"x/{i}.fa", h, s) for i in range(12) for h, s in [*((f"r{i}_{j}", "ACGT" + "GA" * (900 * j)) for j in range(i % 3)), (f"last{i}", "UU")]]
    assert told["whole.tar"] == (len(expect), False) and told["half.tar"][1] and told["first.tar"][1]
    got = [tuple(r)[1:] for r in records.where(records.path.endswith("whole.tar")).collect()]
    assert got == expect
    half = [tuple(r)[1:] for r in records.where(records.path.endswith("half.tar")).collect()]
    assert len(half) == told["half.tar"][0] and set(half[:-1]) <= set(expect)
    one = records.where(records.path == f"{tmp_path}/in/whole.tar")
    assert one.rdd.getNumPartitions() == 1 and one.count() == len(expect)
    assert {r.path.rsplit("/")[-1] for r in tar_source.read_archives(spark, str(tmp_path / "in"))[1].collect()} == set(told)
