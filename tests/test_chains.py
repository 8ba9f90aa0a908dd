"""Assembly of chain tables on hand-made rows."""

from pyspark.sql import functions as F

from strandline.operators import chains


def test_labels_and_accessions(spark):
    c = spark.createDataFrame([("e1", "A"), ("e1", "B"), ("e2", "A")], "entry string, chain string")
    by_chain = spark.createDataFrame([("e1", "A", "tRNA")], "entry string, chain string, family string")
    by_entry = spark.createDataFrame([("e1", "RF00001")], "entry string, family string")
    got = chains.label_precedence(c, by_chain, by_entry)
    fam = spark.createDataFrame([("RF00005", "tRNA"), ("RF00001", "5S_rRNA")], "accession string, id string")
    rows = {(r.entry, r.chain): (r.family, r.accession) for r in chains.family_accession(got, fam).collect()}
    assert rows == {("e1", "A"): ("tRNA", "RF00005"), ("e1", "B"): ("RF00001", "RF00001"), ("e2", "A"): (None, None)}


def test_alignment_by_number(spark):
    s = "target string, chain string, number int, x double, y double, z double, file_pos int"
    ref = spark.createDataFrame([("t", "A", 1, 1.0, 0.0, 0.0, 1), ("t", "A", 1, 9.0, 0.0, 0.0, 2), ("t", "B", 1, 2.0, 0.0, 0.0, 3), ("u", "A", 5, 3.0, 0.0, 0.0, 1)], s)
    mod = spark.createDataFrame([("t", "A", 1, 4.0, 0.0, 0.0, 1), ("t", "A", 2, 5.0, 0.0, 0.0, 2), ("u", "X", 5, 6.0, 0.0, 0.0, 1)], s)
    assert {(r.target, r.chain, r.number, r.x, r.m_x) for r in chains.align_by_number(ref, mod).collect()} == {("t", "A", 1, 1.0, 4.0), ("u", "A", 5, 3.0, 6.0)}


def test_backbone_and_classes(spark):
    s = "entry string, chain string, seq_id int, comp string, atom string, x double, y double, z double, file_pos int"
    rows = [("e", "A", 1, "G", "P", 1, 1, 1, 1), ("e", "A", 1, "G", "P", 9, 9, 9, 2), ("e", "A", 1, "G", "N1", 2, 2, 2, 3), ("e", "A", 1, "G", "N9", 3, 3, 3, 4), ("e", "A", 2, "U", "N1", 4, 4, 4, 5), ("e", "A", 3, "XX", "N1", 5, 5, 5, 6), ("e", "A", 3, "XX", "N9", 6, 6, 6, 7)]
    atoms = spark.createDataFrame([(*r[:5], *map(float, r[5:8]), r[8]) for r in rows], s)
    parents = spark.createDataFrame([("G", "G"), ("U", "U")], "comp string, parent string")
    got = {r.seq_id: (r.px, r.cx, r.nx) for r in chains.backbone(atoms, parents).collect()}
    assert got == {1: (1.0, None, 3.0), 2: (None, None, 4.0), 3: (None, None, 6.0)}
    steps = spark.createDataFrame([("e", "A", 1), ("e", "A", 2)], "entry string, chain string, seq int")
    cls = spark.createDataFrame([("e", "A", 1, "WC", 0), ("e", "A", 1, "wobble", 1)], "entry string, chain string, seq int, pair_class string, row_no int")
    assert {r.seq: r.pair_class for r in chains.step_classes(steps, cls).collect()} == {1: "wobble", 2: None}


def test_targets_and_masks(spark):
    files = spark.createDataFrame([("a/PZ7/solution_0.pdb",), ("a/PZ7/x_1.pdb",), ("a/PZ7/readme.txt",), ("b/R1107/reference.cif",), ("a/PZ8/x.pdb",)], "path string")
    got = {r.target: (r.kind, r.competitors, r.description) for r in chains.blind_targets(files, spark.createDataFrame([("PZ7", "a switch")], "target string, description string")).collect()}
    assert got == {"PZ7": ("puzzle", 1, "a switch"), "R1107": ("casp", 0, None)}
    res = spark.createDataFrame([("e", 0, 0.5, True), ("e", 1, -7.0, False), ("f", 0, 1.0, False)], "entry string, idx int, z double, lw1 boolean")
    meta = spark.createDataFrame([("e", "X-ray diffraction", 2), ("f", "EM", 900)], "entry string, method string, n_polymer int")
    out = {(r.entry, r.idx): (r.rigid, r.loop_known, r.disorder_known) for r in chains.valid_targets(res, meta).collect()}
    assert out == {("e", 0): (True, True, True), ("e", 1): (False, True, True), ("f", 0): (False, False, False)}
    m = spark.createDataFrame([("e", "A", 40), ("g", "A", 5)], "entry string, chain string, length int")
    con = spark.range(9).select(F.lit("e").alias("entry"), F.lit("A").alias("chain"))
    bb = spark.range(40).select(F.lit("e").alias("entry"), F.lit("A").alias("chain"))
    assert [tuple(r) for r in chains.assemble_chains(m, bb, con).collect()] == [("e", "A", 40, 9, True)]
