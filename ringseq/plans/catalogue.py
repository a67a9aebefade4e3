"""Named queries over the sequence views, and the same in SQL.

Each query runs over a whole view. The SQL of a least rotation tries all of a short sequence's; of a long one, those that
begin with its least 64 bases.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringseq.deploy import drop_at_end, new_dir, ship
from ringseq.functions import exprs, udfs
from ringseq.operators import ops
from ringseq.sources import fasta

from .views import SQL, VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, view: str, f: Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(VIEWS[view](spark, sf_dir))

    query.__name__ = name
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql.replace("{view}", f"({SQL[view]})")


# expressions in SQL

_NORM = "regexp_replace(translate(regexp_replace(seq, '[ \\t\\r\\n]', '', 'g'), 'acgtuU.~', 'ACGTTT--'), '[^ACGTN-]', 'N', 'g')"


def _rc(s: str) -> str:
    return f"translate(reverse({s}), '{exprs.COMPLEMENT_FROM}', '{exprs.COMPLEMENT_TO}')"


def _lmsr(s: str) -> str:
    return f"list_min(list_transform(range(length({s})), lambda i: {s}[i + 1:] || {s}[:i]))"


def _rotated(n: str) -> str:
    return f"substr(seq || seq, CAST(((-({n})) % length(seq) + length(seq)) % length(seq) + 1 AS BIGINT), length(seq))"


_HEAD_SEQ = lambda df: df.select("head", "seq")

for view in ("documents", "orders"):
    on = "" if view == "orders" else "_documents"
    _add(f"normalize_dna{on}", view, lambda d: _HEAD_SEQ(ops.normalize(d)), f"SELECT head, {_NORM} AS seq FROM {{view}}")
    _add(f"revcomp{on}", view, lambda d: d.select("head", exprs.revcomp(F.col("seq")).alias("seq")), f"SELECT head, {_rc('seq')} AS seq FROM {{view}}")
    _add(f"cat{on}", view, lambda d: _HEAD_SEQ(ops.cat(d)), "SELECT head, seq || seq AS seq FROM {view}")
    _add(f"decat{on}", view, lambda d: _HEAD_SEQ(ops.decat(d)), "SELECT head, substr(seq, 1, length(seq) // 2) AS seq FROM {view}")
    _add(f"cat_decat_roundtrip{on}", view, lambda d: _HEAD_SEQ(ops.decat(ops.cat(d))), "SELECT head, seq FROM {view}")
    for name, how, n in (("rotate_bases_right", {"bases": 5}, "5"), ("rotate_bases_left", {"bases": -7}, "-7"), ("rotate_percent", {"percent": 0.25}, "CAST(floor(length(seq) * 0.25) AS BIGINT)"), ("rotate_percent_left", {"percent": -0.5}, "CAST(floor(length(seq) * -0.5) AS BIGINT)")):
        _add(f"{name}{on}", view, lambda d, how=how: _HEAD_SEQ(ops.rotate(d, **how)), f"SELECT head, CASE WHEN length(seq) = 0 THEN seq ELSE {_rotated(n).replace('% length(seq)', '% greatest(length(seq), 1)')} END AS seq FROM {{view}}")

_add("fasta_id", "documents", lambda d: d.select("ord", exprs.fasta_id(F.col("head")).alias("id")), "SELECT ord, split_part(head, ' ', 1) AS id FROM {view}")
_add("fasta_format", "documents", lambda d: d.select("ord", exprs.fasta_record(F.col("head"), F.col("seq")).alias("record")), "SELECT ord, '>' || head || chr(10) || seq AS record FROM {view}")
_add("lmsr", "orders", lambda d: d.select("head", udfs.lmsr(F.col("seq")).alias("seq")), f"SELECT head, {_lmsr('seq')} AS seq FROM {{view}}")
_add("lmsr_index", "orders", lambda d: d.select("head", udfs.lmsr_index(F.col("seq")).alias("i")), f"SELECT head, CAST(list_position(list_transform(range(length(seq)), lambda i: seq[i + 1:] || seq[:i]), {_lmsr('seq')}) - 1 AS INTEGER) AS i FROM {{view}}")
_CANON = f"SELECT ord, head, seq, least({_lmsr('n')}, {_lmsr('r')}) AS canon FROM (SELECT ord, head, seq, n, {_rc('n')} AS r FROM (SELECT ord, head, seq, {_NORM} AS n FROM {{view}}))"
_add("canonicalize", "orders", lambda d: _HEAD_SEQ(ops.canonicalize(d)), f"SELECT head, canon AS seq FROM ({_CANON})")
_add("canonicalize_rotated", "rotated", lambda d: _HEAD_SEQ(ops.canonicalize(d)), f"SELECT head, canon AS seq FROM ({_CANON})")


def _long_lmsr(s: str, low: str) -> str:
    return f"CASE WHEN length({s}) = 0 THEN {s} ELSE list_min(list_transform(list_filter(range(length({s})), lambda i: substr({s} || {s}, i + 1, 64) = {low}), lambda i: {s}[i + 1:] || {s}[:i])) END"


_LOW = lambda s: f"list_min(list_transform(range(length({s})), lambda i: substr({s} || {s}, i + 1, 64)))"
_LONG_CANON = f"""SELECT ord, head, seq, least({_long_lmsr('n', 'n_low')}, {_long_lmsr('r', 'r_low')}) AS canon
  FROM (SELECT *, {_LOW('n')} AS n_low, {_LOW('r')} AS r_low FROM (SELECT ord, head, seq, n, {_rc('n')} AS r FROM (SELECT ord, head, seq, {_NORM} AS n FROM {{view}})))"""
_add("canonicalize_documents", "documents", lambda d: _HEAD_SEQ(ops.canonicalize(d)), f"SELECT head, canon AS seq FROM ({_LONG_CANON})")
for view in ("rotated", "documents"):
    on, sql = ("", str) if view == "rotated" else ("_documents", lambda s: s.replace(_CANON, _LONG_CANON))
    _add(f"uniq{on}", view, lambda d: ops.uniq(d), sql(f"SELECT ord, head, seq FROM ({_CANON}) QUALIFY row_number() OVER (PARTITION BY canon ORDER BY ord, head) = 1"))
    _add(f"uniq_canonical{on}", view, lambda d: ops.uniq(d, canonicalize=True), sql(f"SELECT ord, head, canon AS seq FROM ({_CANON}) QUALIFY row_number() OVER (PARTITION BY canon ORDER BY ord, head) = 1"))
    _add(f"uniq_table{on}", view, lambda d: ops.uniq_table(d), sql(f"SELECT id, duplicate_id FROM (SELECT split_part(first_value(head) OVER w, ' ', 1) AS id, split_part(head, ' ', 1) AS duplicate_id, row_number() OVER w AS n FROM ({_CANON}) WINDOW w AS (PARTITION BY canon ORDER BY ord, head)) WHERE n > 1"))

# monomers


def _first_end(s: str, k: int, allowed: str) -> str:
    """End that remains after one overlap is cut off {s}, null if there is none."""
    n = f"length({s})"
    return (
        f"({n} - list_min(list_filter(range({k}, {n} - {k} + 1), lambda m: substr({s}, CAST(m - {k} + 1 AS BIGINT), {k}) = substr({s}, {n} - {k} + 1, {k}) "
        f"AND hamming(substr({s}, 1, CAST(m AS BIGINT)), substr({s}, CAST({n} - m + 1 AS BIGINT), CAST(m AS BIGINT))) <= {allowed})))"
    )


def _monomers(columns: str, where: str = "e IS NOT NULL", k: int = 10, allowed: str = "0", low: int = 0, ok: str = "TRUE", sensitive: bool = False) -> str:
    gate = max(k, low)
    start = f"SELECT head, seq, {_NORM} AS s FROM {{view}}"
    last = "CASE WHEN max(step) > 0 THEN arg_max(e, step) END"
    found = f"""WITH RECURSIVE v AS ({start}),
r(head, s, e, step) AS (SELECT head, s, length(s), 0 FROM v WHERE length(s) >= {gate}
  UNION ALL SELECT head, s, next, step + 1 FROM (SELECT head, s, step, {_first_end('p', k, allowed)} AS next FROM (SELECT *, substr(s, 1, e) AS p FROM r) WHERE length(p) > {k}) WHERE next IS NOT NULL),
f AS (SELECT head, {last} AS e FROM r GROUP BY head)"""
    source = "SELECT v.head, v.seq, v.s, f.e AS e0 FROM v LEFT JOIN f USING (head)"
    if sensitive:
        mono = _rc("substr(s, 1, coalesce(e0, length(s)))")
        source = f"SELECT head, seq, s, CASE WHEN length(s) >= {gate} AND length(c) > {k} THEN coalesce({_first_end('c', k, allowed)}, e0) ELSE e0 END AS e0 FROM (SELECT *, {mono} AS c FROM ({source}))"
    return f"{found} SELECT {columns} FROM (SELECT head, seq, CASE WHEN {ok} THEN e0 END AS e FROM ({source})) WHERE {where}"


_CUT = "head, substr(seq, 1, coalesce(e, length(seq))) AS seq"
_ROWS = "head AS id, CAST(length(seq) AS BIGINT) AS original_length, CAST(coalesce(e, length(seq)) AS BIGINT) AS monomer_length"
_IDENTITY = "m - CAST(floor(m * CAST({} AS DOUBLE)) AS BIGINT)"
for name, options, sql in (
    ("exact", {}, {}),
    ("max_mismatch", {"max_mismatch": 2}, {"allowed": "2"}),
    ("min_identity", {"min_identity": 0.9, "seed_length": 8}, {"k": 8, "allowed": _IDENTITY.format(0.9)}),
    ("min_overlap", {"max_mismatch": 1, "min_overlap": 30}, {"allowed": "1", "ok": "length(seq) - e0 >= 30"}),
    ("min_overlap_percent", {"max_mismatch": 1, "min_overlap_percent": 1.0}, {"allowed": "1", "ok": "(length(seq) - e0) / e0 >= 1.0"}),
    ("length_range", {"max_mismatch": 1, "min_length": 25, "max_length": 45}, {"allowed": "1", "low": 25, "ok": "e0 BETWEEN 25 AND 45"}),
    ("keep_all", {"max_mismatch": 1, "keep_all": True, "max_length": 45}, {"allowed": "1", "ok": "e0 <= 45", "where": "TRUE"}),
    ("sensitive", {"min_identity": 0.95, "sensitive": True}, {"allowed": _IDENTITY.format(0.95), "sensitive": True}),
):
    _add(f"monomerize_{name}", "multimers", lambda d, o=options: _HEAD_SEQ(ops.monomerize(d, **o)), _monomers(_CUT, **sql))
    _add(f"monomerize_table_{name}", "multimers", lambda d, o=options: ops.monomerize_table(d, **o), _monomers(_ROWS, **sql))
_add("monomerize_documents", "documents", lambda d: ops.monomerize_table(d, max_mismatch=1, keep_all=True), _monomers(_ROWS, allowed="1", where="TRUE"))

# reading frames


def _frames(columns: str, starts: str = "'ATG'", stops: str = "'TAA', 'TAG', 'TGA'", where: str = "TRUE", longest: bool = True, strands: str = "+-") -> str:
    both = " UNION ALL ".join({"+": "SELECT head, '+' AS strand, seq, n AS s FROM v", "-": f"SELECT head, '-' AS strand, seq, {_rc('n')} AS s FROM v"}[x] for x in strands)
    one = " QUALIFY row_number() OVER (PARTITION BY head, strand, stop ORDER BY length DESC, start % 3 DESC, start DESC) = 1" if longest else ""
    return f"""WITH v AS (SELECT head, seq, {_NORM} AS n FROM {{view}}), st AS ({both}),
pos AS (SELECT *, substr(s || substr(s, 1, 2), i + 1, 3) AS codon FROM (SELECT head, strand, s, length(s) AS n, unnest(range(length(s))) AS i FROM st WHERE length(s) >= 2)),
a AS (SELECT head, strand, n, i FROM pos WHERE codon IN ({starts})),
b AS (SELECT head, strand, i FROM pos WHERE codon IN ({stops}) AND (codon NOT IN ({starts}) OR i >= n - 2)),
d AS (SELECT a.head, a.strand, a.n, a.i AS start, b.i AS t, ((b.i - a.i) % a.n + a.n) % a.n AS d FROM a LEFT JOIN b USING (head, strand)),
g AS (SELECT *, CASE WHEN n % 3 = 0 THEN CASE WHEN d % 3 = 0 AND d <> 0 THEN d END ELSE d + n * (((d % 3) * CASE WHEN n % 3 = 1 THEN 2 ELSE 1 END) % 3) END AS far FROM d),
m AS (SELECT head, strand, n, start, min(far) AS far, arg_min(t, far) FILTER (WHERE far IS NOT NULL) AS stop FROM g GROUP BY ALL),
o AS (SELECT head, strand, CAST(n AS INTEGER) AS n, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop,
  CAST(CASE WHEN far IS NOT NULL THEN (start + far + 2) // n WHEN n % 3 = 0 THEN 1 ELSE 3 END AS INTEGER) AS wraps,
  CAST(CASE WHEN far IS NOT NULL THEN far + 3 WHEN n % 3 = 0 THEN n ELSE 3 * n END AS INTEGER) AS length FROM m),
kept AS (SELECT * FROM o WHERE {where}{one})
SELECT {columns} FROM kept JOIN st USING (head, strand)"""


_FRAME = "head, strand, start, stop, wraps, length"
_AS_FRAME = lambda d: d.select("head", "strand", "start", "stop", "wraps", "length")
_NAME = "head || CASE WHEN strand = '+' THEN '_ORF' ELSE '_RC_ORF' END || start"


def _sequence(less: int) -> str:
    return f"{_NAME} AS head, substr(repeat(CASE WHEN strand = '+' THEN seq ELSE s END, 5), start + 1, length - {less}) AS seq"


def _table(less: int) -> str:
    turned = lambda c: f"CAST(CASE WHEN strand = '+' THEN {c} ELSE n - 1 - {c} END AS BIGINT) AS {c}"
    return f"{_NAME} AS orf_id, head AS seq_id, {turned('start')}, {turned('stop')}, CAST(length - {less} AS BIGINT) AS length, CAST(wraps AS BIGINT) AS wraps, length / length(seq) AS ratio"


_DEFAULT = "length - 3 >= 75 AND stop IS NOT NULL"
_PLACES = "SELECT head, CAST(row_number() OVER (PARTITION BY head ORDER BY i) - 1 AS INTEGER) AS i, CAST(i AS INTEGER) AS position FROM (SELECT head, seq, unnest(range(length(seq))) AS i FROM {view}) WHERE substr(seq || substr(seq, 1, 2), i + 1, 3) IN "
for kind, codons in (("starts", "('ATG')"), ("stops", "('TAA', 'TAG', 'TGA')")):
    _add(f"codon_positions_{kind}", "orders", lambda d, k=kind: ops.codon_positions(d).select("head", F.posexplode(k).alias("i", "position")), _PLACES + codons)
_add("find_orfs_all", "orders", lambda d: _AS_FRAME(ops.find_orfs(d)), _frames(_FRAME, longest=False))
for name, options, sql in (
    ("longest_forward", {"strand": "forward"}, {"strands": "+", "where": _DEFAULT}),
    ("longest_reverse", {"strand": "reverse"}, {"strands": "-", "where": _DEFAULT}),
    ("both_strands", {}, {"where": _DEFAULT}),
    ("linear_only", {"max_wraps": 0, "min_length": 30}, {"where": "length - 3 >= 30 AND stop IS NOT NULL AND wraps <= 0"}),
    ("wrapped_only", {"min_wraps": 1, "min_length": 30}, {"where": "length - 3 >= 30 AND stop IS NOT NULL AND wraps >= 1"}),
    ("min_ratio", {"min_ratio": 0.5, "min_length": 0}, {"where": "stop IS NOT NULL AND length / n >= 0.5"}),
    ("partial", {"no_stop_required": True}, {"where": "length - 3 >= 75"}),
    ("custom_codons", {"start_codons": "ATG,CTG,TTG", "stop_codons": "TAA,CTG"}, {"starts": "'ATG', 'CTG', 'TTG'", "stops": "'TAA', 'CTG'", "where": _DEFAULT}),
):
    _add(f"orfs_{name}", "orders", lambda d, o=options: _AS_FRAME(ops.longest_orfs(d, **o)), _frames(_FRAME, **sql))
for name, options, less in (("", {}, 3), ("_include_stop", {"include_stop": True}, 0)):
    _add(f"orfs_fasta_sequence{name}", "orders", lambda d, o=options: ops.orfs(d, **o), _frames(_sequence(less), where=_DEFAULT))
    _add(f"orfs_table{name}", "orders", lambda d, o=options: ops.orfs_table(d, **o), _frames(_table(less), where=_DEFAULT))
_add("orfs_documents", "documents", lambda d: ops.orfs_table(d, min_length=30), _frames(_table(3), where="length - 3 >= 30 AND stop IS NOT NULL"))


def fasta_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' sequences written as compressed FASTA by the data source, and read again."""
    path = new_dir(spark, "fasta")
    fasta.write_fasta(VIEWS["documents"](spark, sf_dir), path, single_file=False, compression="zst")
    drop_at_end(spark, path)
    return fasta.read_fasta(spark, path).select("head", "seq")


QUERIES["fasta_roundtrip"] = fasta_roundtrip
ORACLE_SQL["fasta_roundtrip"] = f"SELECT head, seq FROM ({SQL['documents']})"
