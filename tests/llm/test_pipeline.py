"""The pipeline against plain versions of its stages; the queries on odd ids, against their SQL, and from another folder."""

import os
import re
import subprocess
import sys
import zlib

import duckdb
import numpy as np
import pytest
from conftest import ROOT
from test_text import BAD, GOOD, TOKENIZER, plain_components, plain_mix, plain_print

import corpus_pipeline as cp
from ringseq.llm import mixing, quality, queries
from ringseq.llm.common import save

BIG = 2**53 + 1
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, score double, rid long, row int, `odd.map` map<string,int>"


def rows():
    """Good and bad documents, copies, near copies, nulls, empty and very long texts, ties, repeated rows, a null id among large ones."""
    out = [(i, (GOOD if i % 3 else BAD) + f"\nThis is the line of number {i}, and {i * 7} follows it.", "xyz"[i % 3] if i % 5 else None) for i in range(60)]
    long, other, third = (" ".join(f"{'Aword'[i % 5:]}{i * k % 101} is of {k} uses." for i in range(n)) for k, n in ((37, 20_000), (41, 15_000), (43, 10_000)))
    out += [(BIG, long, "x"), (BIG + 2, long, "y"), (BIG + 4, long + " More.", "x"), (BIG + 6, other, "y"), (BIG + 8, third, "z"), (None, GOOD, "x"), (None, None, "y"), (70, None, None), (71, "", "x"), (72, " \n\t", "z"), (73, "one", "y")]
    out += [(80, GOOD + "\nIt comes again.", "z")] * 3 + [(81, GOOD + "\nIt comes again.", "z")]
    return [(i, t, "en", s, None, "f", 0.5, 1, 1, {"k": 1}) for i, t, s in out]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def listed(df):
    return sorted(map(str, df.collect()))


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    (_, good), (_, one), (_, mix), (_, pack) = cp.STAGES

    field = quality.train(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    kept = save(good(spark, docs, tables), "kept")
    assert kept.columns == docs.columns
    assert listed(kept) == sorted(str(r) for r in docs.collect() if field.score(r["text"]) >= queries.GOOD)
    held = [r for r in docs.collect() if r["doc_id"] is not None and r["doc_id"] < 60]
    assert 30 < sum(field.score(r["text"]) >= queries.GOOD for r in held) < 50

    single, all_ = save(one(spark, kept, tables), "single"), kept.collect()
    lab = plain_components([plain_print(r["text"]) for r in all_], 4)
    want = {}
    for r, k in zip(all_, lab):
        rank = (r["doc_id"] is None, r["doc_id"] or 0)
        want[k] = min(want.get(k, (rank, r)), (rank, r), key=lambda x: x[0])
    assert single.columns == docs.columns and single.count() == len(want) < len(all_)
    ids = lambda found: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in found)
    assert ids(single.collect()) == ids(r for _, r in want.values())

    mixed = save(mix(spark, single, tables), "mixed")
    ranked, due = mixing.ranked(single, queries.MIX_WEIGHTS)
    copies = plain_mix(ranked.collect(), due)
    assert mixed.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["source"] or "") for r in mixed.collect()) == sorted((i, s or "") for i, _, s, n in copies for _ in range(n))
    assert set(listed(mixed)) <= set(listed(single))
    assert {k for *_, k in copies} >= {0, 1, 3}

    check_packed(mixed.collect(), pack(spark, mixed, tables).collect())
    assert listed(cp.run(spark, tables)) == listed(pack(spark, mixed, tables))


def check_packed(docs, got):
    """Pieces of rows with doc_id and text, against the tokenizer's own ids."""
    from tokenizers import Tokenizer

    slow, want, own = Tokenizer.from_file(TOKENIZER), {}, {}
    for r in docs:
        ids = (*slow.encode(r["text"] or "", add_special_tokens=False).ids, 1)
        want.setdefault((r["doc_id"], len(ids)), []).append(ids)
    for r in got:
        own.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    assert want.keys() == own.keys()
    for key, texts in want.items():
        pieces = own[key]
        assert sorted(x for r in pieces for x in range(r["start"], r["start"] + r["length"])) == sorted([*range(key[1])] * len(texts))
        for r in pieces:
            assert r["ids_crc32"] in {zlib.crc32(np.array(t[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for t in texts}
    spans = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    ends = {}
    for s, at, n in spans:
        assert at == ends.get(s, 0)
        ends[s] = at + n
    assert sorted(ends) == list(range(len(ends))) and all(n <= 2048 for n in ends.values()) and sum(n < 2048 for n in ends.values()) <= 1


def test_stages_of_an_empty_table(spark, tables, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{tables}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in cp.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_queries_on_odd_rows(spark, tables):
    """The queries over documents, whole: every row once, ids exact, equal texts alike."""
    docs = rows()
    ids = sorted(str(r[0]) for r in docs)
    text = {}
    for r in docs:
        text.setdefault(str(r[0]), []).append(r[1])
    run = {n: queries.QUERIES[n](spark, tables).collect() for n in ("op1_quality", "op2_mixing", "op4_sharding", "op6_media", "op7_simhash", "op9_packing")}
    for name, got in run.items():
        if name != "op9_packing":
            assert sorted(str(r["doc_id"]) for r in got) == ids, name
    for r in run["op1_quality"]:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for r in run["op2_mixing"]:
        assert r["size"] in {size(t) for t in text[str(r["doc_id"])]} and 0 <= r["taken"] <= 3 * r["size"]
    for r in run["op4_sharding"]:
        assert (r["size"], r["text_crc32"]) in {(len(b) + 8, zlib.crc32(b)) for b in ((t or "").encode() for t in text[str(r["doc_id"])])}
        assert 0 <= r["shard"] < 24 and r["law"] == "bytes" and r["grown_shard"] is None
    for r in run["op7_simhash"]:
        assert int(r["fingerprint"], 16) in {plain_print(t) for t in text[str(r["doc_id"])]} and len(r["fingerprint"]) == 16
    prints = [plain_print(r[1]) for r in docs]
    lab = plain_components(prints, 4)
    least = [min((x[0] for x, k in zip(docs, lab) if k == own and x[0] is not None), default=None) for own in lab]
    assert sorted(str((r["doc_id"], r["component_id"])) for r in run["op7_simhash"]) == sorted(str((r[0], m)) for r, m in zip(docs, least))
    check_packed([{"doc_id": r[0], "text": r[1]} for r in docs], run["op9_packing"])


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_as_in_sql(spark, name):
    sf, duck = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, sf), duck.sql(queries.ORACLE_SQL[name])
    at = sorted(theirs.columns)
    assert sorted(ours.columns) == at
    order = [theirs.columns.index(c) for c in at]
    assert sorted(str(tuple(r[c] for c in at)) for r in ours.collect()) == sorted(str(tuple(r[i] for i in order)) for r in theirs.fetchall())


ALONE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
queries = e.queries()
for name in {names!r}:
    spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.log.level", "OFF").config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", {path!r}).getOrCreate()
    before = {{r.key: r.value for r in spark.sql("SET").collect()}}
    n = queries[name](spark, "/root/testdata/sf0.001").count()
    assert {{r.key: r.value for r in spark.sql("SET").collect()}} == before, name
    print(name, n, flush=True)
    spark.stop()
"""


def test_queries_from_another_folder(tmp_path):
    """Each in an application of its own, first of all, without the package on the workers' path; settings stay as they are."""
    names = [*queries.QUERIES, "pipeline"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = ALONE.format(root=str(ROOT), names=names, path=str(tmp_path / "shared"))
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-2000:]
    assert [x.split()[0] for x in done.stdout.splitlines() if x.split()[0] in names] == names
    assert not list((tmp_path / "shared").glob("ringseq-*"))  # tables go when an application ends
