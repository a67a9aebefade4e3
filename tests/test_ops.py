"""Operators on DataFrames: known pairs, partitions, options, SQL, streams, command line."""

import gzip
import io
import os
import random
import subprocess
import sys

import pytest
from conftest import ROOT

from ringseq import cli
from ringseq.functions import exprs, kernels, sql
from ringseq.operators import ops
from ringseq.sources import fasta
from ringseq.streaming import streams


def frame(spark, *seqs):
    return spark.createDataFrame([(i, f"s{i} x", s) for i, s in enumerate(seqs)], "ord long, head string, seq string")


def got(df):
    return {r["head"]: r["seq"] for r in df.collect()}


def test_maps(spark):
    df = frame(spark, "ACGTN", "", "acgu", None)
    assert list(got(ops.cat(df)).values()) == ["ACGTNACGTN", "", "acguacgu", None]
    assert list(got(ops.decat(df)).values()) == ["AC", "", "ac", None]
    assert list(got(ops.decat(ops.cat(df))).values()) == ["ACGTN", "", "acgu", None]
    assert list(got(ops.rotate(df, bases=1)).values()) == ["NACGT", "", "uacg", None]
    assert list(got(ops.rotate(df, bases=-7)).values()) == ["GTNAC", "", "uacg", None]
    assert list(got(ops.rotate(df, percent=0.5)).values()) == ["TNACG", "", "guac", None]
    assert list(got(ops.rotate(df, percent=-0.5)).values()) == ["TNACG", "", "guac", None]
    assert list(got(ops.normalize(frame(spark, "aCgU.~-N n\tRy\n"))).values()) == ["ACGT---NNNN"]


def test_rotation_options():
    for bad in ({}, {"bases": 1, "percent": 0.5}, {"bases": 0}, {"percent": 0.0}):
        with pytest.raises(ValueError):
            ops.rotate(None, **bad)


def test_canonical_and_native_form(spark):
    seqs = ["GATTACA", "TTTT", "", "ACGTNACG", "TAA"]
    df = frame(spark, *seqs)
    assert list(got(ops.canonicalize(df)).values()) == [kernels.canonicalize(s.encode()).decode() for s in seqs]
    native = df.select("head", exprs.least_rotation(df["seq"]).alias("seq"))
    assert list(got(native).values()) == [kernels.lmsr(s.encode()).decode() for s in seqs]


@pytest.mark.parametrize("parts", [1, 2, 4, 8])
def test_uniq(spark, parts):
    df = frame(spark, "GATTACAC", "ATTACACG", "gauuacac", "GTGTAATC", "AAAA", "AAAA", None, None).repartition(parts)
    assert got(ops.uniq(df)) == {"s0 x": "GATTACAC", "s4 x": "AAAA", "s6 x": None}
    assert got(ops.uniq(df, canonicalize=True))["s0 x"] == kernels.canonicalize(b"GATTACAC").decode()
    assert sorted(map(tuple, ops.uniq_table(df).collect())) == [("s0", "s1"), ("s0", "s2"), ("s0", "s3"), ("s4", "s5"), ("s6", "s7")]


def test_monomerize(spark):
    mono = "ACGTTGCAAGGTCCATTGAC"
    df = frame(spark, mono * 2, mono + mono[:12], mono, "ACG", None, mono.lower() * 3)
    assert got(ops.monomerize(df)) == {"s0 x": mono, "s1 x": mono, "s5 x": mono.lower()}
    assert got(ops.monomerize(df, min_overlap=15)) == {"s0 x": mono, "s5 x": mono.lower()}
    assert got(ops.monomerize(df, min_overlap_percent=1.5)) == {"s5 x": mono.lower()}
    assert got(ops.monomerize(df, max_length=19)) == {}
    assert got(ops.monomerize(df, min_length=21)) == {}
    kept = ops.monomerize_table(df, keep_all=True, min_overlap=15).where("id < 's4'").collect()
    assert [tuple(r) for r in sorted(kept)] == [("s0 x", 40, 20), ("s1 x", 32, 32), ("s2 x", 20, 20), ("s3 x", 3, 3)]
    for bad in ({"seed_length": 64}, {"max_mismatch": 1, "min_identity": 0.9}, {"min_length": -1}):
        with pytest.raises(ValueError):
            ops.monomerize(df, **bad)


def test_orfs(spark):
    df = frame(spark, "GCATAAGCAATG", "aaaaugCCCCCCCCCUAA", "ATG", None, "")
    assert got(ops.orfs(df, min_length=0, strand="forward")) == {"s0 x_ORF9": "ATGGCA", "s1 x_ORF3": "augCCCCCCCCC"}
    assert got(ops.orfs(df, min_length=0, strand="forward", include_stop=True))["s1 x_ORF3"] == "augCCCCCCCCCUAA"
    rows = {r["orf_id"]: r for r in ops.orfs_table(df, min_length=0, strand="forward", no_stop_required=True).collect()}
    assert tuple(rows["s0 x_ORF9"])[1:] == ("s0 x", 9, 3, 6, 1, 0.75)
    assert rows["s2 x_ORF0"]["stop"] is None and rows["s2 x_ORF0"]["length"] == 0
    assert ops.orfs(df, min_length=75).count() == 0
    back = frame(spark, kernels.revcomp(b"AAAATGCCCCCCCCCTAA").decode())
    assert [tuple(r) for r in ops.orfs_table(back, min_length=0, strand="reverse").collect()] == [("s0 x_RC_ORF3", "s0 x", 14, 2, 12, 0, 15 / 18)]
    both = frame(spark, "AAAATGCCCCCCCCCTAA")
    assert ops.orfs(both, min_length=0, strand="reverse").count() == 0
    assert ops.orfs(both, min_length=0, strand="reverse", reference_compat=True).count() == 1
    assert ops.find_orfs(both, strand="both").count() == 1
    with pytest.raises(ValueError):
        ops.orfs(df, strand="up")


def test_uniq_lists_what_it_removes(spark):
    """Equal records, and records without a place of their own."""
    rows = [("a x", "GATTACAC"), ("a x", "GATTACAC"), ("a x", "ATTACACG"), ("b", "AAAA"), ("c", None), ("c", None)]
    df = spark.createDataFrame(rows, "head string, seq string")
    assert sorted(map(tuple, ops.uniq_table(df.repartition(3)).collect())) == [("a", "a"), ("a", "a"), ("c", "c")]
    assert got(ops.uniq(df.repartition(3))) == {"a x": "ATTACACG", "b": "AAAA", "c": None}  # of equal heads, the least sequence
    kept, table = ops.uniq_and_table(df, canonicalize=True)
    assert kept.columns == df.columns and kept.count() + table.count() == len(rows)
    assert got(kept)["a x"] == kernels.canonicalize(b"GATTACAC").decode()
    plan = ops.uniq_table(df)._jdf.queryExecution().toString()
    assert "ArrowEval" not in plan  # the kernel has run once, before


def test_known_commands(spark, tmp_path):
    """Cases of the command line: a blank line in a body, turns longer than a record, overlaps at their limits."""
    def run(records, *args):
        (tmp_path / "in.fa").write_text("".join(f">{h}\n{s}\n" for h, s in records))
        assert cli.main([args[0], str(tmp_path / "in.fa"), *args[1:], "-o", str(tmp_path / "out.fa")]) == 0
        return got(fasta.read_fasta(spark, str(tmp_path / "out.fa")))

    a = "ACGTTGCATTAGCCNA"
    assert run([("a", f"{a[:7]}\n\n{a[7:]}"), ("b c", "A")], "cat") == {"a": a + a, "b c": "AA"}
    assert run([("a", f"{a[:5]}\n{a[5:]}{a[:9]}\n\n{a[9:]}\n"), ("b", "ACG")], "decat") == {"a": a, "b": "A"}
    short = [("a", a), ("four", "ACGT"), ("five", "AACGT")]
    assert run(short, "rotate", "--bases", "5") == {"a": a[-5:] + a[:-5], "four": "TACG", "five": "AACGT"}
    assert run(short, "rotate", "--bases", "-5") == {"a": a[5:] + a[:5], "four": "CGTA", "five": "AACGT"}
    assert run(short, "rotate", "--percent", "0.25") == {"a": a[-4:] + a[:-4], "four": "TACG", "five": "TAACG"}
    assert run(short, "rotate", "--percent", "0.5") == {"a": a[-8:] + a[:-8], "four": "GTAC", "five": "GTAAC"}
    r = random.Random(4)
    m80, m81, m260 = ("".join(r.choices("ACGT", k=n)) for n in (80, 81, 260))
    many = [("w", m260 * 2), ("x", m80 * 2), ("y", m81 * 2)]
    assert run(many, "monomerize", "--min-overlap", "81") == {"w": m260, "y": m81}
    many = [("w", m260 * 2), ("three", m80 * 3), ("two", m80 * 2), ("half", m80 + m80[:40]), ("more", m80 + m80[:41]), ("none", "".join(r.choices("ACGT", k=100)))]
    assert run(many, "monomerize", "--min-overlap-percent", "0.51") == {"w": m260, "three": m80, "two": m80, "more": m80}
    assert run(many, "monomerize", "--min-overlap-percent", "1.0") == {"w": m260, "three": m80, "two": m80}
    assert run(many, "monomerize", "--min-overlap-percent", "1.5") == {"three": m80}
    turned = [("a x", "GATTACAC"), ("b", "ACGATTAC"), ("c", "gauuacac"), ("d", "GUGUAAUC"), ("e", "gtgtaatc")]
    form = kernels.canonicalize(b"GATTACAC").decode()
    assert run(turned, "canonicalize") == dict.fromkeys(("a x", "b", "c", "d", "e"), form)
    assert run(turned, "uniq", "-c") == {"a x": form} and run(turned, "uniq", "--canon") == {"a x": form}
    frame = [("a", "AAAATGCCCCCCCCCTAA")]
    assert run(frame, "orfs", "-m", "0", "--strand", "reverse") == {}
    assert run(frame, "orfs", "-m", "0", "--strand", "reverse", "--reference-compat") == {"a_ORF3": "ATGCCCCCCCCC"}


def test_standard_input_and_output(tmp_path):
    """A process of its own, away from the repository: FASTA in a pipe, records out, and nothing else; also compressed input."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": str(ROOT)}
    run = lambda data, *args: subprocess.run([sys.executable, "-m", "ringseq.cli", *args], input=data, capture_output=True, cwd=tmp_path, env=env)
    done = run(gzip.compress(b">a b\nAC\nGT\n>c\nTT\n"), "cat", "-t", "2", "-q")
    assert (done.returncode, done.stdout) == (0, b">a b\nACGTACGT\n>c\nTTTT\n")
    assert run(b"", "cat", "-t", "0").returncode == 2
    bad = run(b"ACGT\n", "decat", "-v", "--threads", "1")
    assert bad.returncode == 1 and bad.stdout == b"" and b"expected '>'" in bad.stderr


@pytest.mark.parametrize("form", ["", "gz", "bz2", "xz", "zst"])
def test_streams_tell_forms_by_content(spark, tmp_path, form):
    (tmp_path / "in/deep").mkdir(parents=True)
    with open(tmp_path / "in/a.data", "wb") as raw:
        out = fasta.encoded(raw, form)
        out.write(FASTA)
        if out is not raw:
            out.close()
    stream = streams.read_fasta_stream(spark, str(tmp_path / "in"))
    name = f"told_{form or 'plain'}"
    q = stream.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table(name).orderBy("ord").select("head", "id", "seq").collect()] == READ


def test_fasta_files_below_folders(spark, tmp_path):
    """Hidden names don't count; a compressed file without the name of one is read once, however it is split; a failed job leaves nothing."""
    (tmp_path / "in/deep/.hidden").mkdir(parents=True)
    (tmp_path / "in/a.fa").write_text(">a\nAC\n")
    (tmp_path / "in/deep/b.fa").write_bytes(gzip.compress(b">b\n" + b"ACGT" * 5000 + b"\n>c\nA\n"))
    (tmp_path / "in/deep/.hidden/c.fa").write_text(">no\nA\n")
    (tmp_path / "in/_d.fa").write_text(">no\nA\n")
    fasta.register(spark)
    rows = spark.read.format("fasta").option("splitbytes", 7).load(str(tmp_path / "in")).collect()
    assert sorted((r["head"], len(r["seq"])) for r in rows) == [("a", 2), ("b", 20000), ("c", 1)]
    bad = spark.range(4, numPartitions=4).selectExpr("string(id) head", "if(id = 3, raise_error('no'), 'ACGT') seq")
    with pytest.raises(Exception, match="no"):
        bad.write.format("fasta").mode("append").save(str(tmp_path / "out"))
    assert not [p for p in (tmp_path / "out").rglob("*") if p.is_file()]


def test_sql_names(spark):
    sql.register(spark)
    row = spark.sql("SELECT revcomp('AACg') a, normalize_dna('ac gu~R') b, rotate_bases('ACGT', -1) c, rotate_percent('ACGT', 0.5D) d, cat_seq('AC') e, decat_seq('ACG') f, lmsr('TAA') g, lmsr_index('TAA') h, canonicalize_dna('ATT') i, monomer_end('ATGCATGC', 4, 0) j, fasta_id('a b') k").first()
    assert tuple(row) == ("cGTT", "ACGT-N", "CGTA", "GTAC", "ACAC", "A", "AAT", 1, "AAT", 4, "a")
    assert [tuple(r) for r in spark.sql("SELECT inline(find_orfs('GCATAAGCAATG'))").collect()] == [(9, 3, 1, 9)]
    assert spark.sql("SELECT orf_seq('GCATAAGCAATG', 9, 9) s").first()["s"] == "ATGGCATAA"


FASTA = b"\n>a first\r\nACG\r\nT\r\n\r\n>b\nAC\n\nGT\n>c\n>d e f\nTT"
READ = [("a first", "a", "ACGT"), ("b", "b", "ACGT"), ("c", "c", ""), ("d e f", "d", "TT")]


@pytest.mark.parametrize("form", ["", "gz", "bz2", "xz", "zst"])
def test_fasta_forms(spark, tmp_path, form):
    path = tmp_path / "in.data"  # the form is told by content
    with open(path, "wb") as raw:
        out = fasta.encoded(raw, form)
        out.write(FASTA)
        if out is not raw:
            out.close()
    df = fasta.read_fasta(spark, str(path))
    assert [tuple(r) for r in df.orderBy("ord").select("head", "id", "seq").collect()] == READ
    assert df.where("id = 'b'").first()["raw_seq"] == "AC\n\nGT"
    to = str(tmp_path / f"out.fasta{'.' * bool(form)}{form}")
    fasta.write_fasta(df.orderBy("ord"), to)
    assert fasta.form_of(open(to, "rb").read(6)) == form
    assert sorted(tuple(r) for r in fasta.read_fasta(spark, to).select("head", "id", "seq").collect()) == READ
    fasta.write_fasta(df, str(tmp_path / "parts"), single_file=False, compression=form)
    assert sorted(tuple(r) for r in fasta.read_fasta(spark, str(tmp_path / "parts")).select("head", "id", "seq").collect()) == READ


@pytest.mark.parametrize("split", [1, 3, 7, 50, 10**6])
def test_fasta_splits(spark, tmp_path, split):
    seqs = [("ACGT" * (i % 5), i) for i in range(40)]
    text = "".join(f">r{i} x\n" + "".join(f"{s[j : j + 6]}\n" for j in range(0, len(s), 6)) for s, i in seqs)
    (tmp_path / "x.fa").write_text(text)
    fasta.register(spark)
    rows = spark.read.format("fasta").option("splitbytes", split).load(str(tmp_path / "x.fa")).orderBy("ord").collect()
    assert [(r["head"], r["seq"]) for r in rows] == [(f"r{i} x", s) for s, i in seqs]


def test_fasta_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="No such file or directory"):
        fasta.read_fasta(spark, str(tmp_path / "none.fa"))
    with pytest.raises(IsADirectoryError):
        fasta.write_fasta(frame(spark, "A"), str(tmp_path))
    (tmp_path / "bad.fa").write_text("ACGT\n>a\nA\n")
    with pytest.raises(Exception, match="expected '>'"):
        fasta.read_fasta(spark, str(tmp_path / "bad.fa")).collect()
    (tmp_path / "empty.fa").write_text("")
    assert fasta.read_fasta(spark, str(tmp_path / "empty.fa")).count() == 0
    assert fasta.read_stdin(spark, io.BytesIO(FASTA)).count() == 4


def test_table_sink(spark, tmp_path):
    df = spark.createDataFrame([("a", None, 0.5)], "id string, stop long, ratio double")
    for name, text in (("t.csv", "id,stop,ratio\na,,0.5\n"), ("t.tsv", "id\tstop\tratio\na\t\t0.5\n"), ("t.tsv.gz", "id,stop,ratio\na,,0.5\n")):
        fasta.write_table(df, str(tmp_path / name))
        assert (tmp_path / name).read_text() == text
    fasta.write_table(df.where("false"), str(tmp_path / "none.csv"))
    assert (tmp_path / "none.csv").read_text() == ""


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.fa").write_text(">a x\nGATT\nACAC\n>b\nATTACACG\n>c\nAAAA\n")
    stream = streams.read_fasta_stream(spark, str(tmp_path / "in"))
    q = ops.rotate(ops.cat(stream), bases=2).select("head", "seq").writeStream.format("memory").queryName("turned").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = fasta.read_fasta(spark, str(tmp_path / "in"))
    assert got(spark.table("turned")) == got(ops.rotate(ops.cat(batch), bases=2))
    q = streams.write_stream(streams.uniq_stream(stream, canonicalize=True), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination()
    assert sorted(got(streams_text(spark, tmp_path)).values()) == sorted(kernels.canonicalize(s).decode() for s in (b"GATTACAC", b"AAAA"))


def streams_text(spark, tmp_path):
    return fasta.read_fasta(spark, str(tmp_path / "out/part-*"))


def test_command_line(spark, tmp_path, capsys):
    src, out = tmp_path / "in.fa", tmp_path / "out.fa.gz"
    src.write_text(">a x\nGATT\nACAC\n>b y\nATTACACG\n")
    assert cli.main(["uniq", str(src), "-c", "-o", str(out), "--table", str(tmp_path / "t.csv")]) == 0
    assert got(fasta.read_fasta(spark, str(out))) == {"a x": kernels.canonicalize(b"GATTACAC").decode()}
    assert (tmp_path / "t.csv").read_text() == "id,duplicate_id\na,b\n"
    assert cli.main(["uniq", str(src), "-o", str(tmp_path / "raw.fa")]) == 0
    assert (tmp_path / "raw.fa").read_text() == ">a x\nGATT\nACAC\n"
    assert cli.main(["rotate", str(src), "-b", "0"]) == 1
    assert cli.main(["cat", str(tmp_path / "none.fa")]) == 1
    assert "No such file or directory" in capsys.readouterr().err
    for args in (["orfs", "-m", "0"], ["monomerize", "-k"]):
        assert cli.main([args[0], str(src), *args[1:], "-o", str(tmp_path / "o.fa"), "--table", str(tmp_path / "o.tsv")]) == 0
    assert (tmp_path / "o.tsv").read_text().startswith("id\toriginal_length\tmonomer_length\na x\t8\t8\n")
