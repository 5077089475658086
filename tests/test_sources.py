"""Formats: hand-made files, odd ones, and splits at every byte."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from quern.operators import graph as G
from quern.plans.script import Session
from quern.sources import fasta, fastq, graphs, sam
from quern.streaming import drops


@pytest.fixture
def splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}

    def to(size):
        spark.conf.set(keys[0], str(size))
        spark.conf.set(keys[1], "0")

    yield to
    for k, v in before.items():
        spark.conf.set(k, v)


def records(n):
    return [(f"@lib:{k}/1", "ACGT" * (k % 5 + 1), "+", ("@+II" if k % 2 else "+@@I") * (k % 5 + 1)) for k in range(n)]


@pytest.mark.parametrize("size", [97, 400, 1 << 20])
def test_fastq_at_every_split(spark, splits, tmp_path, size):
    want = records(60)
    (tmp_path / "a.fastq").write_text("".join("\n".join(r) + "\n" for r in want))
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as f:
        f.write("".join("\n".join(r) + "\n" for r in want[:7]))
    splits(size)
    rows = fastq.read_fastq(spark, str(tmp_path)).collect()
    for name, own in (("a.fastq", want), ("b.fastq.gz", want[:7])):
        got = sorted((r.ord, (r.header, r.seq, r.plus, r.qual)) for r in rows if r.file.endswith(name))
        assert got == list(enumerate(own))


def test_broken_fastq_is_an_error(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@a\nACGT\n-\nIIII\n")
    with pytest.raises(Exception, match="no FASTQ record"):
        fastq.read_fastq(spark, str(tmp_path)).collect()


def test_headers(spark):
    rows = ["@lib:7_1_2/1", "@T2+34|lib:7/2", "@plain", "@12|x:y"]
    df = spark.createDataFrame([(r,) for r in rows], "h string").select(*[c.alias(n) for n, c in fastq.parse_header(F.col("h")).items()])
    assert [tuple(r) for r in df.collect()] == [(None, None, "lib", "7_1_2", 1), ("T2", 34, "lib", "7", 2), (None, None, None, "plain", None), (None, 12, "x", "y", None)]
    for bad in ("", "a:b", "a|b", "a+b", "a/b"):
        with pytest.raises(ValueError):
            fastq.check_prefix(bad)


def test_read_set_and_kinds(spark, tmp_path):
    for part in ("read1", "read2", "single"):
        (tmp_path / f"x.{part}.fastq").write_text("@lib:1/1\nACGT\n+\nIIII\n")
    rows = fastq.read_set(spark, f"{tmp_path}/x").collect()
    assert {(r.part, r.read_id, r.prefix) for r in rows} == {(p, "1", "lib") for p in ("read1", "read2", "single")}
    with pytest.raises(FileNotFoundError):
        fastq.read_set(spark, f"{tmp_path}/nothing")
    mixed = spark.createDataFrame([("@T2+x:1", "ACGT"), ("@x:2", "ACGT")], "header string, seq string")
    with pytest.raises(ValueError):
        fastq.one_kind(mixed)


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text("# made by hand\n>one first contig\nACGT\nAC\n>two\nTTTT\n\n>three x\n")
    got = {r.name: (r.descr, r.seq) for r in fasta.read_fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert got == {"one": ("first contig", "ACGTAC"), "two": (None, "TTTT"), "three": ("x", "")}


def test_csfasta(spark, tmp_path):
    (tmp_path / "a.csfasta").write_text("# c\n>1_2_3_F3\nT0123.\n>1_2_4_F3\nT3210\n")
    (tmp_path / "a.qual").write_text(">1_2_3_F3\n30 31 -1 2 40\n>1_2_4_F3\n1 2 3 4\n")
    got = {r.name: (r.primer, r.seq, r.qual) for r in fasta.read_csfasta(spark, str(tmp_path / "a.csfasta"), str(tmp_path / "a.qual")).collect()}
    assert got == {"1_2_3": ("TA", "CGTN", "@!#I"), "1_2_4": ("TT", "GCA", "#$%")}
    (tmp_path / "b.qual").write_text(">1_2_3_F3\n30 31 -1 2 40\n")
    with pytest.raises(Exception, match="only in one"):
        fasta.read_csfasta(spark, str(tmp_path / "a.csfasta"), str(tmp_path / "b.qual")).collect()


def test_sam(spark, tmp_path):
    line = lambda *f: "\t".join(f)
    rest = ("37", "4M", "*", "0", "0", "ACGT", "IIII")
    text = ["@SQ\tSN:c1\tLN:100", "@SQ\tSN:c2\tLN:50\tSP:x y", line("r1/1", "0", "c1", "10", *rest, "XM:i:1", "NM:i:3", "XA:Z:c2,-5,4M,2;c1,+7,4M,1;"), line("r2", "16", "c2", "9", *rest, "NM:i:0"), line("r3", "4", "*", "0", *rest)]
    (tmp_path / "x.read2.sam").write_text("\n".join(text) + "\n")
    got = {(r.read_key, r.mate, r.seq_id, r.pos, r.ed) for r in sam.read_hits(spark, str(tmp_path)).collect()}
    assert got == {("r1", 2, "c1", 10, 1), ("r1", 2, "c2", -5, 2), ("r1", 2, "c1", 7, 1), ("r2", 2, "c2", -9, 0)}
    assert {(r.seq_id, r.seq_len, r.descr) for r in sam.read_header(spark, str(tmp_path)).collect()} == {("c1", 100, "NA"), ("c2", 50, "x y")}
    (tmp_path / "y.sam").write_text("@SQ\tSN:c1\tLN:99\n" + line("r9", "0", "c1", "1", *rest) + "\n")
    with pytest.raises(Exception, match="two lengths"):
        sam.read_header(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="no edit distance"):
        sam.read_hits(spark, str(tmp_path)).collect()


DOC = {
    "nodes": {"a": {"seq_len": 100, "cov": 2.5, "pct_gc": 0.4, "bits": 9, "seq": "ACGT"}, "b": {"seq_len": 50, "cov": 1, "bits": 3}},
    "edges": [{"n1": "a", "n2": "b", "dir": "FB", "bits": 700, "score": 650.5}],
    "removed_nodes": {"c": {"seq_len": 10, "cov": 1, "bits": 1}},
    "removed_edges": [{"n1": "b", "n2": "c", "dir": "FF", "bits": 5, "score": 1}],
    "processing": [["MADE", {}]],
}


def test_graph_files_and_scripts(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps(DOC))
    s = Session(spark)
    assert not s.script("TABLE")  # nothing is loaded
    assert s.script(f'LOAD {{"file": "{tmp_path}/g.json"}}\n# a comment\nSTASH\nEDGFLT {{"thresh": 800}}\nTABLE\nGC\nDOT {{"detail": true}}\nDUMP {{"file": "{tmp_path}/@.json"}}\nUNSTASH', tag="out")
    table, stats, text = s.output
    assert {(r.id, r.pct_gc) for r in table.collect()} == {("a", "0.4"), ("b", "NA")}
    assert stats.first().total_len == 150 and '"a" [label="a\\n100"];' in text and "->" not in text
    assert s.graph.live_edges().count() == 1  # as it was stashed
    again = graphs.load(spark, f"{tmp_path}/out.json")
    assert again.live_edges().count() == 0 and again.edges.count() == 2 and len(again.history) == 2
    with pytest.raises(ValueError):
        s.run("NOSUCH")
    s.run("HELP")
    assert "MST" in s.output[-1]
    with pytest.raises(ValueError):
        graphs.load(spark, f"{tmp_path}/g.json", f"{tmp_path}/g.json")


def test_chain_of_commands(spark):
    nodes = spark.createDataFrame([(k, 100, 10.0, 0.5) for k in range(1, 13)], "id long, seq_len long, cov double, pct_gc double")
    edges = spark.createDataFrame([(k, k + 1, "FB", 900.0, 9.0) for k in range(1, 12)] + [(1, 3, "FB", 600.0, 1.0)], "n1 long, n2 long, dir string, bits double, score double")
    s = Session(spark, G.new_graph(nodes, edges))
    assert s.script("MST\nPLUCK\nPUSH\nPRUNE\nSCAFF")
    assert [list(r.nodes) for r in s.graph.scaffolds.collect()] in ([[*range(1, 13)]], [[*range(12, 0, -1)]])
    assert len(s.graph.history) == 5


def test_output_names():
    assert graphs.output_name("x_@@_##.fa", {"x_t_00.fa"}, "t") == "x_t_01.fa"
    assert graphs.output_name("plain", set()) == "plain"
    with pytest.raises(FileExistsError):
        graphs.output_name("#", {str(k) for k in range(10)})


def test_dropped_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.fastq").write_text("@a\nACGT\n+\nIIII\n@b\nAC\n+\nII\n")
    seen = []
    drops.watch(spark, str(tmp_path / "in"), str(tmp_path / "check"), lambda df, n: seen.extend((r.reads, r.bases) for r in drops.base_counts(df).collect()), once=True).awaitTermination()
    assert seen == [(2, 6)]
