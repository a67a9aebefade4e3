"""The operators: records (head, seq, and where given id, file, ord, raw_seq) in, a lazy DataFrame out.

Each can be used as df.transform(op, ...). All but uniq work within a row, without a shuffle. Null sequences stay null and
have no frames and no monomer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringseq.deploy import save, ship
from ringseq.functions import exprs, udfs

from .options import MonomerizeOptions, OrfOptions, rotation


def cat(df: DataFrame) -> DataFrame:
    """Each sequence twice in a row."""
    return df.withColumn("seq", exprs.cat_seq(F.col("seq")))


def decat(df: DataFrame) -> DataFrame:
    """The first half of each sequence."""
    return df.withColumn("seq", exprs.decat_seq(F.col("seq")))


def rotate(df: DataFrame, bases: int | None = None, percent: float | None = None) -> DataFrame:
    """Move the origin by a number of bases, or a share of the length; to the right, or left if negative."""
    rotation(bases, percent)
    seq = F.col("seq")
    return df.withColumn("seq", exprs.rotate_right(seq, F.lit(bases)) if bases is not None else exprs.rotate_share(seq, percent))


def normalize(df: DataFrame) -> DataFrame:
    return df.withColumn("seq", exprs.normalize_dna(F.col("seq")))


def canonicalize(df: DataFrame) -> DataFrame:
    """Normalized, and rotated and turned to the least of all rotations of both polarities."""
    ship(df.sparkSession)
    return df.withColumn("seq", udfs.canonical(exprs.normalize_dna(F.col("seq"))))


def _order(df: DataFrame) -> list[Column]:
    """Order of the input: file and ord where the source gives them, then the header, and the sequence of records that share all that."""
    place = [F.col(c) for c in ("file", "ord") if c in df.columns]
    return [*place, F.col("head")] if len(place) == 2 else [*place, F.col("head"), F.col("seq")]


def _id(df: DataFrame) -> Column:
    return F.col("id") if "id" in df.columns else exprs.fasta_id(F.col("head"))


def _keyed(df: DataFrame) -> DataFrame:
    ship(df.sparkSession)
    return df.withColumn("canonical_form", udfs.canonical(exprs.normalize_dna(F.col("seq"))))


def _first(keyed: DataFrame, df: DataFrame, canonicalize: bool) -> DataFrame:
    carried = [c for c in df.columns if not (canonicalize and c == "seq")]  # the form stands for the sequence: it is shuffled once
    hashed = F.xxhash64("canonical_form").alias("form_hash")  # before the form: rows are sorted by it, and forms seldom compared
    kept = keyed.groupBy(hashed, "canonical_form").agg(F.min_by(F.struct(*carried), F.struct(*_order(df))).alias("kept")).select("canonical_form", "kept.*")
    return (kept.withColumnRenamed("canonical_form", "seq") if canonicalize else kept).select(*df.columns)


def _duplicates(rows: DataFrame) -> DataFrame:
    """rows: saved, with own_id, place, row (a number) and canonical_form. The first of each form is written before it is joined
    back, so both sides are exchanges of their own and adaptive execution can split a form that very many records share."""
    first = rows.groupBy("canonical_form").agg(F.min(F.struct("place", "row", "own_id")).alias("kept"), F.count("*").alias("n")).where("n > 1")
    first = save(first.select(F.col("canonical_form").alias("form"), F.col("kept.row").alias("first"), F.col("kept.own_id").alias("id")), "first")
    return rows.select("own_id", "row", "canonical_form").join(first, F.col("canonical_form").eqNullSafe(F.col("form"))).where("row <> first").select("id", F.col("own_id").alias("duplicate_id"))


def uniq(df: DataFrame, canonicalize: bool = False) -> DataFrame:
    """The first record of each circular sequence, compared by canonical form; with canonicalize, its sequence in that form.

    The first of each group is an aggregate (partial before the shuffle), so a form that very many records share costs no
    task more than its neighbours.
    """
    return _first(_keyed(df), df, canonicalize)


def uniq_table(df: DataFrame) -> DataFrame:
    """Removed records: id of the one kept, id of the duplicate. Equal records, and those of an equal place, are listed as often as they are removed."""
    rows = _keyed(df).select(_id(df).alias("own_id"), F.struct(*_order(df)).alias("place"), F.monotonically_increasing_id().alias("row"), "canonical_form")
    return _duplicates(save(rows, "forms"))


def uniq_and_table(df: DataFrame, canonicalize: bool = False) -> tuple[DataFrame, DataFrame]:
    """What uniq and uniq_table give, from one pass of the kernel: forms are written once."""
    rows = _keyed(df).select("*", _id(df).alias("own_id"), F.struct(*_order(df)).alias("place"), F.monotonically_increasing_id().alias("row"))
    rows = save(rows, "forms")
    return _first(rows, df, canonicalize), _duplicates(rows)


def _ends(df: DataFrame, o: MonomerizeOptions) -> DataFrame:
    """df with monomer_end: null if there is no monomer within the limits."""
    ship(df.sparkSession)
    norm, full = exprs.normalize_dna(F.col("seq")), F.length("seq")
    gate = F.length(norm) >= max(o.seed_length, o.min_length)
    end = udfs.monomer_end(o.kernel(), o.sensitive)(F.when(gate, norm))
    df = df.withColumn("monomer_end", end)
    e = F.col("monomer_end")
    ok = e >= o.min_length
    if o.max_length is not None:
        ok &= e <= o.max_length
    if o.min_overlap is not None:
        ok &= full - e >= o.min_overlap
    if o.min_overlap_percent is not None:
        ok &= F.when(e > 0, (full - e) / e >= o.min_overlap_percent).otherwise(True)
    df = df.withColumn("monomer_end", F.when(ok, e))
    return df if o.keep_all else df.where(F.col("monomer_end").isNotNull())


def monomerize(df: DataFrame, **options) -> DataFrame:
    """Trim multimers to a monomer; records without one are left out, or kept as they are with keep_all."""
    found = _ends(df, MonomerizeOptions(**options))
    cut = F.substring("seq", F.lit(1), F.coalesce("monomer_end", F.length("seq")))
    return found.withColumn("seq", cut).select(*df.columns)


def monomerize_table(df: DataFrame, **options) -> DataFrame:
    full = F.length("seq")
    return _ends(df, MonomerizeOptions(**options)).select(F.col("head").alias("id"), full.cast("long").alias("original_length"), F.coalesce("monomer_end", full).cast("long").alias("monomer_length"))


def _frames(df: DataFrame, o: OrfOptions, longest: bool, filtered: bool = True) -> DataFrame:
    """A row for each frame: df's columns, norm (normalized, forward), strand, orf. Both strands are read in one pass over the bases."""
    ship(df.sparkSession)
    limits = dict(min_length=o.min_length, stop_required=not o.no_stop_required, min_wraps=o.min_wraps, max_wraps=o.max_wraps, min_ratio=o.min_ratio) if filtered else {}
    strands = {"forward": "+", "reverse": "+-" if o.reference_compat else "-", "both": "+-"}[o.strand]
    f = udfs.reading_frames(o.start_codons, o.stop_codons, strands, longest=longest, **limits)
    found = df.withColumn("norm", exprs.normalize_dna(F.col("seq"))).withColumn("orf", F.explode(f(F.col("norm"))))
    return found.withColumn("strand", F.when(F.col("orf.reverse"), "-").otherwise("+"))


_FRAME = ["strand", "orf.start", "orf.stop", "orf.wraps", "orf.length"]


def find_orfs(df: DataFrame, **options) -> DataFrame:
    """Every reading frame, without filters: df's columns, strand, start, stop, wraps, length (stop codon included)."""
    return _frames(df, OrfOptions(**options), False, filtered=False).select(*df.columns, *_FRAME)


def longest_orfs(df: DataFrame, **options) -> DataFrame:
    """The longest frame of each stop after the filters; columns as find_orfs."""
    return _frames(df, OrfOptions(**options), True).select(*df.columns, *_FRAME)


def codon_positions(df: DataFrame, **options) -> DataFrame:
    """df with the arrays starts and stops: where codons begin on the circle, as read."""
    ship(df.sparkSession)
    o = OrfOptions(**options)
    return df.withColumn("codons", udfs.codon_positions(o.start_codons, o.stop_codons)(exprs.normalize_dna(F.col("seq")))).select(*df.columns, "codons.starts", "codons.stops")


def _named(found: DataFrame) -> Column:
    return F.concat("head", F.when(F.col("strand") == "+", "_ORF").otherwise("_RC_ORF"), F.col("orf.start").cast("string"))


def orfs(df: DataFrame, **options) -> DataFrame:
    """Names and sequences of the longest frames: head, seq. Forward ones are cut from the sequence as read, others from its normalized reverse complement."""
    o = OrfOptions(**options)
    found = _frames(df, o, True)
    source = F.when(F.col("strand") == "+", F.col("seq")).otherwise(exprs.revcomp(F.col("norm")))
    return found.select(_named(found).alias("head"), exprs.orf_seq(source, F.col("orf.start"), F.col("orf.length"), o.include_stop).alias("seq"))


def orfs_table(df: DataFrame, **options) -> DataFrame:
    """Metadata of the longest frames. On the reverse strand start and stop are turned to forward coordinates."""
    o = OrfOptions(**options)
    found = _frames(df, o, True)
    turned = lambda c: F.when(F.col("strand") == "+", c).otherwise(F.length("norm") - 1 - c).cast("long")
    return found.select(
        _named(found).alias("orf_id"),
        F.col("head").alias("seq_id"),
        turned(F.col("orf.start")).alias("start"),
        turned(F.col("orf.stop")).alias("stop"),
        (F.col("orf.length") - (0 if o.include_stop else 3)).cast("long").alias("length"),
        F.col("orf.wraps").cast("long").alias("wraps"),
        (F.col("orf.length") / F.length("seq")).alias("ratio"),
    )
