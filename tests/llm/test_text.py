"""Quality, mixing, sharding, SimHash and packing: plain definitions, and nulls, empty texts, ties, repeats, empty tables, clashing columns."""

import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ringseq.llm import mixing, packing, quality, sharding, simhash
from ringseq.llm.graph import components

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, score double, size long, cell int, root long, rank int, u double, copies int"
GOOD = "The lines of this page are plain.\nThey end with a stop, as lines do, and no word comes twice in a row.\nIt is so."
BAD = "BUY!! NOW!! BUY!! NOW!! BUY!! NOW!!\nas as as as as as as as as as as\nfoo | bar | baz | foo | bar | baz"


def docs(spark, rows):
    """rows: (doc_id, text, source); with columns that clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, None, "x", 1.0, 7, 7, 7, 7, 0.5, 9) for i, t, s in rows], SCHEMA)


ODD = [(1, None, "a"), (2, "", "a"), (3, GOOD, None), (3, GOOD, None), (4, GOOD, "b"), (None, "one", "a"), (5, " \t\n", "b"), (6, "word " * 60000, "a"), (7, "é ü \x1c x", "c"), (8, BAD, "b")]


# quality


def test_marginals_are_exact():
    rng = np.random.default_rng(0)
    f = quality.Field(rng.normal(size=quality.WIDTH), rng.normal(size=(2, 2)))
    x = rng.normal(size=(6, quality.WIDTH))
    e = x @ f.weights
    total, good = 0.0, np.zeros(6)
    for bits in range(64):
        y = [bits >> t & 1 for t in range(6)]
        p = math.exp(sum(e[t] * y[t] for t in range(6)) + sum(f.table[a, b] for a, b in zip(y, y[1:])))
        total += p
        good += p * np.array(y)
    assert np.allclose(f.marginals(x), good / total)
    for text in (GOOD, BAD, "", "one"):
        own, _ = quality.own_features(text)
        assert np.allclose(f.evidence(own), quality.with_neighbours(own) @ f.weights)


def test_gradient_of_the_field():
    rng = np.random.default_rng(1)
    seqs = quality._padded([(rng.normal(size=(n, quality.WIDTH)), rng.integers(0, 2, n).astype(float)) for n in (1, 3, 5)])
    w, table, step = rng.normal(size=quality.WIDTH) * 0.1, rng.normal(size=(2, 2)), 1e-5

    def likelihood(w, table):
        out = 0.0
        for x, y in seqs:
            for u, v in zip(x, y):
                v = v[v >= 0]
                e = u[: len(v)] @ w
                score = lambda z: sum(e[t] * z[t] for t in range(len(z))) + sum(table[int(a), int(b)] for a, b in zip(z, z[1:]))
                every = [score([b >> t & 1 for t in range(len(v))]) for b in range(1 << len(v))]
                out += score(v) - np.logaddexp.reduce(every)
        return out

    gw, gt = quality._gradient(seqs, w, table, 0.0)
    for k in (0, 5, quality.WIDTH - 1):
        d = np.zeros_like(w)
        d[k] = step
        assert abs((likelihood(w + d, table) - likelihood(w - d, table)) / (2 * step) - gw[k]) < 1e-3
    for a, b in ((0, 1), (1, 1)):
        d = np.zeros((2, 2))
        d[a, b] = step
        assert abs((likelihood(w, table + d) - likelihood(w, table - d)) / (2 * step) - gt[a, b]) < 1e-3


def test_quality(spark):
    rows = [(i, (GOOD if i % 2 else BAD) + f"\nline number {i} here.", "a") for i in range(80)]
    d = docs(spark, rows + ODD[:3])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)] + [(1, None, 0), (3, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    field = quality.train(d, labels)
    out = quality.scored(d, field).collect()
    assert len(out) == 83 and all(0 <= r["score"] <= 1 for r in out)
    assert all((r["score"] >= 0.3) == bool(r["doc_id"] % 2) for r in out[:80])
    again = quality.train(d.repartition(3), labels)
    assert np.array_equal(field.weights, again.weights)
    empty = quality.train(d.where("false"), labels.where("false"))
    assert {r["score"] for r in quality.scored(d, empty).collect()} == {0.5}
    assert quality.scored(d.where("false"), field).count() == 0
    often = quality.train(d.union(d.where("doc_id = 5")).union(d.where("doc_id = 5")), labels)
    assert np.array_equal(field.weights, often.weights)  # a document that comes again is one
    bound = quality.train(d, labels, total_lines=16)
    assert bound.weights.any() and not np.array_equal(field.weights, bound.weights)
    assert d.select(quality.held_out(F.lit(None).cast("long")).alias("h")).first()["h"] is False
    assert d.select(quality.held_out(F.col("doc_id")).alias("h"), "doc_id").where("doc_id = 7").first()["h"] == (zlib.crc32(b"7") % 5 == 0)


def test_quality_of_held_out_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = quality.scored(d, quality.train(d, labels)).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).select("score", "quality").collect()
    assert len(found) > 30 and sum((r["score"] >= 0.3) == (r["quality"] == 1) for r in found) >= 0.95 * len(found)


# mixing


@given(st.dictionaries(st.one_of(st.none(), st.text("abc", max_size=3)), st.integers(0, 1000), max_size=8))
def test_targets(sizes):
    due = mixing.targets(sizes, [5.0, 2.0, 1.0])
    assert due.keys() == sizes.keys() and all(-1e-9 <= due[s] <= 3 * sizes[s] + 1e-9 for s in sizes)
    if sizes:
        assert abs(sum(due.values()) - sum(sizes.values())) < 1e-6 * (1 + sum(sizes.values()))


def test_mixing(spark):
    rows = [(i, "w " * (1 + i * 7 % 50), "xyz"[i % 3] if i % 4 else "x") for i in range(600)]
    d = docs(spark, rows + [r for r in ODD if r[0] != 6])
    out = mixing.mix(d, [5.0, 2.0, 1.0], carry=["fp", "copies"])
    got = out.collect()
    assert len(got) == len(rows) + len(ODD) - 1
    text = {i: t for i, t, _ in rows}
    for r in got:
        if r["doc_id"] in text and r["doc_id"] > 8:
            assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text[r["doc_id"]]))
        assert 0 <= r["taken"] <= 3 * r["size"]
    for s in "xyz":
        own = [r for r in got if r["source"] == s]
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 10
    key = lambda rows: sorted(map(str, rows))
    assert key(got) == key(mixing.mix(d.repartition(7), [5.0, 2.0, 1.0], carry=["fp", "copies"]).collect())
    assert mixing.mix(d.where("false"), [1.0]).count() == 0
    assert mixing.mix(docs(spark, [(1, None, "a"), (2, "", None)]), [1.0]).agg(F.sum("taken")).first()[0] == 0


def plain_mix(rows, due):
    """Copies of each document by Pareto's order, drawn one by one: (doc_id, size, source, copies)."""
    out = []
    for source in {r["source"] for r in rows}:
        left = due.get(source, 0.0)
        for r in sorted((r for r in rows if r["source"] == source), key=lambda r: (r["rank"] is None, r["rank"], r["k"], r["no"])):
            hit = r["rank"] is not None and r["size"] <= left
            left -= r["size"] * hit
            out.append((str(r["doc_id"]), r["size"], source, r["whole"] + hit if r["size"] else 0))
    return sorted(out, key=str)


def mixed(got):
    return sorted(((str(r["doc_id"]), r["size"], r["source"], r["copies"]) for r in got), key=str)


@pytest.mark.parametrize("grid, zone", [(65536, 4096), (64, 8), (4, 1)])
def test_mixing_is_a_draw_by_rank(spark, grid, zone):
    big = 2**53 + 1
    rows = [(big + i, "w " * (20000 if i % 500 == 0 else 1 + i * 7 % 300), "xyz"[i % 3]) for i in range(3000)]
    rows += [(7, "one row very often, " * 9, "x")] * 400 + [(None, f"null {i} " * (i % 5), "y") for i in range(50)] + [(1, "w " * 400, None)] * 30 + [r for r in ODD if r[0] != 6]
    d = docs(spark, rows)
    ranked, due = mixing.ranked(d, [5.0, 2.0, 1.0])
    ranked = ranked.collect()
    want = plain_mix(ranked, due)
    assert mixed(mixing.mix(d, [5.0, 2.0, 1.0], grid=grid, zone=zone).collect()) == want
    assert mixed(mixing.mix(d.repartition(5), [5.0, 2.0, 1.0], grid=grid, zone=zone).collect()) == want  # reruns agree
    assert {i for i, *_ in want} == {str(r[0]) for r in rows}  # ids beyond 2 ** 53, beside nulls
    again = [r["rank"] for r in ranked if r["doc_id"] == 7 and r["size"] == 36]
    assert len(again) == len(set(again)) == 400 or again[0] is None
    for s in ("x", "y", "z", None):
        own = [r for r in ranked if r["source"] == s and r["size"]]
        words = sum((r["whole"] + r["p"]) * r["size"] for r in own)
        assert words == pytest.approx(own[0]["target"]) and sum(r["p"] * r["size"] for r in own) == pytest.approx(due[s], abs=1e-6)
        per = {(r["whole"] + r["p"]) / 2 ** (0.125 * (r["size"].bit_length() - 1)) for r in own if r["whole"] < 3}
        assert not per or max(per) == pytest.approx(min(per))
        assert own[0]["whole"] == 3 or len({r["p"] for r in own}) > (s is not None)  # unequal within a source


def test_chances_of_a_draw(spark):
    """Ranks come from even random numbers: those below 1 are about the share p of their class."""
    d = spark.range(20_000).selectExpr("id as doc_id", "repeat('w ', int(1 + id % 40)) as text", "'a' as source")
    rows, _ = mixing.ranked(d, [1.0], total=200_000)
    for r in rows.groupBy("class", "p").agg(F.avg((F.col("rank") <= 1).cast("double")).alias("got"), F.count("*").alias("n")).collect():
        assert abs(r["got"] - r["p"]) < 5 * math.sqrt(r["p"] * (1 - r["p"]) / r["n"])


@pytest.mark.parametrize("seed", [2, 3, 4])
def test_mixing_passes_over_a_very_long_document(spark, seed):
    sizes = [100_000 if i == 0 else 20 if i % 7 else 1 + i % 50 for i in range(10_000)]
    d = spark.range(10_000).selectExpr("id as doc_id", "repeat('w ', if(id = 0, 100000, if(id % 7 > 0, 20, 1 + int(id % 50)))) as text", "'a' as source")
    got = mixing.mix(d, [1.0], total=sum(sizes) / 2 + 0.5, seed=seed).collect()
    assert sorted((r["doc_id"], r["size"]) for r in got) == list(enumerate(sizes))
    left = got[0]["target"] - sum(r["taken"] for r in got)
    assert 0 <= left < min([r["size"] for r in got if not r["copies"]])


def test_mixing_goes_on_after_a_cell_where_nothing_fits(spark):
    cell = mixing.PLACES // 4
    rows = [(None, 5, 1), (None, 8, cell + 1), (None, 8, cell + 2), (None, 9, cell + 3), (None, 5, 2 * cell + 1), (None, 1, 3 * cell)]
    table = spark.createDataFrame([(s, n, float(at), at, i, i, 0) for i, (s, n, at) in enumerate(rows)], "source string, size long, rank double, place long, rid long, k long, no long")
    spans, _, hits, _ = mixing._select(table, {None: 10.0}, 4, 1)
    within = [i for i, (_, n, at) in enumerate(rows) if any(r["lo"] <= at < r["hi"] and n <= r["fits"] for r in spans.collect())]
    assert sorted(within + [r["rid"] for r in hits.collect()]) == [0, 4]


def test_copies_due():
    due = mixing.copies_due({0: 10, 3: 100, 8: 1000}, 1500.0, 3.0, 0.125)
    assert sum(n * due[c] for c, n in {0: 10, 3: 100, 8: 1000}.items()) == pytest.approx(1500) and due[8] / due[0] == pytest.approx(2)
    assert mixing.copies_due({0: 10, 8: 10}, 59.0, 3.0, 0.125) == pytest.approx({0: 2.9, 8: 3.0})
    assert mixing.copies_due({2: 5}, 15.0, 3.0, 0.125) == {2: 3.0} and mixing.copies_due({2: 5}, 0.0, 3.0, 0.125) == {2: 0.0}


# sharding


def check_shards(rows, got, shards):
    """Slots, sizes and checksums of shards of rows (doc_id, text, source); the sizes of the shards."""
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(i), len(b := (t or "").encode()) + 8, zlib.crc32(b)) for i, t, _ in rows)
    for s in range(shards):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    return [sum(r["size"] for r in got if r["shard"] == s) for s in range(shards)]


def test_sharding(spark):
    rows = ODD[:5] + [(100 + i, f"text {i} " * (1 + i % 9), "a") for i in range(500)] + [(1000 + i, "hot copy", "a") for i in range(400)]
    got = sharding.shard(docs(spark, rows), shards=4).collect()
    sizes = check_shards(rows, got, 4)
    assert max(sizes) < 1.02 * min(sizes)
    small = {}
    for r in got:
        if r["text_crc32"] != zlib.crc32(b"hot copy"):
            small.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in small.values())
    assert sharding.shard(docs(spark, ODD).where("false")).count() == 0


@pytest.mark.parametrize("share", [0.2, 0.24])
def test_a_group_that_fits_a_shard_stays_whole(spark, share):
    rows = [(i, "a group of its own, eight words of them", "a") for i in range(int(1000 * share))] + [(i, f"text {i}", "a") for i in range(1000 - int(1000 * share))]
    got = sharding.shard(docs(spark, rows), shards=4, fine=2).collect()
    check_shards(rows, got, 4)
    hot = zlib.crc32(rows[0][1].encode())
    large = sum(r["size"] for r in got if r["text_crc32"] == hot) * 4 > sum(r["size"] for r in got)
    assert (len({r["shard"] for r in got if r["text_crc32"] == hot}) > 1) == large


@pytest.mark.parametrize("doc_id", [None, 2**53 + 1])
def test_a_large_group_is_split_whatever_its_ids(spark, doc_id):
    rows = [(doc_id, "same", "a")] * 20_000 + [(i, f"text {i}", "a") for i in range(20_000)]
    got = sharding.shard(docs(spark, rows).repartition(8)).collect()
    sizes = check_shards(rows, got, 24)
    assert max(sizes) < 1.02 * min(sizes)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 50)] * 3), max_size=40), st.integers(1, 6))
def test_placing_by_definition(items, shards):
    """One item at a time, largest share first, where the dot product with the room that is left is highest among shards that have room."""
    total = [max(1, sum(x[d] for x in items)) for d in range(3)]
    load = [[x[d] / total[d] for d in range(3)] for x in items]
    room, want = [[1 / shards] * 3 for _ in range(shards)], {}
    for i in sorted(range(len(items)), key=lambda i: (-max(load[i]), i)):
        fit = [s for s in range(shards) if all(room[s][d] >= load[i][d] - 1e-15 for d in range(3))]
        dot = lambda s: sum(room[s][d] * load[i][d] for d in range(3)) if fit else room[s][0]  # noqa: B023, E731
        best = max(map(dot, fit or range(shards)))
        want[i] = [s for s in fit or range(shards) if dot(s) >= best - 1e-12]
        got = int(sharding.place(np.array(items, float).reshape(-1, 3), shards)[i])
        assert got in want[i]
        room[got] = [room[got][d] - load[i][d] for d in range(3)]


def test_placing_uses_room():
    items = np.array([[4, 1, 1], [1, 4, 1], [1, 1, 4], [4, 1, 1], [1, 4, 1], [1, 1, 4]], float)
    of = sharding.place(items, 2)
    assert sorted(of.tolist()) == [0, 0, 0, 1, 1, 1] and (items[of == 0].sum(axis=0) == 6).all()


# SimHash


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    import xxhash

    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@given(st.text("aA bé\t\x1c .", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_print(text)


def plain_components(prints, radius):
    lab = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = lab[i], lab[j]
                lab = [min(a, b) if x in (a, b) else x for x in lab]
    return lab


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=4), st.lists(st.tuples(st.integers(0, 3), st.lists(st.integers(0, 63), max_size=6)), min_size=1, max_size=90), st.integers(0, 6))
def test_bit_slices(bases, changes, radius):
    fp = np.array(sorted({bases[i % len(bases)] ^ sum(1 << b for b in set(bits)) for i, bits in changes}), np.uint64)
    want = plain_components(fp.tolist(), radius)
    for a, b in (simhash._small(fp, np.zeros(len(fp), np.int64), radius), simhash._large(fp, radius, at_once=3)):
        at = {int(x): i for i, x in enumerate(fp)}
        lab = simhash._local(len(fp), np.array([at[int(x)] for x in a], int), np.array([at[int(x)] for x in b], int))
        assert lab.tolist() == want


def test_near_duplicates(spark):
    base = [f"w{i * 31 % 97}{i}" for i in range(300)]
    rows = [(50, " ".join(base), "a"), (40, " ".join(base), "a"), (60, " ".join([*base[:299], "changed"]), "a"), (70, "quite another text of a few words", "a"), (80, "Quite ANOTHER text of a few words", "b")]
    d = docs(spark, rows + ODD)
    got = simhash.simhash_components(d).collect()
    assert len(got) == len(rows) + len(ODD)
    texts = [t for _, t, _ in rows + ODD]
    prints = [plain_print(t) for t in texts]
    lab = plain_components(prints, 4)
    ids = [i for i, _, _ in rows + ODD]
    want = sorted((str(i), str(min((x for x, g in zip(ids, lab) if g == k and x is not None), default=None))) for i, k in zip(ids, lab))
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == want
    kept = simhash.keep_one(d)
    assert kept.columns == d.columns and kept.count() == len(set(lab))
    assert simhash.simhash_components(d.where("false")).count() == 0 and simhash.keep_one(d.where("false")).count() == 0


@pytest.mark.parametrize("split_at", [1, 3, 20])
def test_keys_of_many_fingerprints_are_split(spark, split_at):
    """Links are the same however often keys are split; three splits use 50 bits at least."""
    rng = np.random.default_rng(split_at)
    prints = sorted({int(b) ^ sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 6), replace=False)) for b in rng.integers(0, 2**63, 6) for _ in range(40)})
    table = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    links = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.link_classes(table, split_at=split_at).collect()]
    lab = {p: i for i, p in enumerate(prints)}
    assert all((a ^ b).bit_count() <= 64 for a, b in links)
    got = simhash._local(len(prints), np.array([lab[a] for a, _ in links]), np.array([lab[b] for _, b in links]))
    assert got.tolist() == plain_components(prints, 4)
    used = 0
    for _ in range(4):
        used |= min(simhash._bands_of(used, 6, 4), key=int.bit_count)
    assert used.bit_count() >= 50


def test_keeping_one_of_rows_with_maps(spark):
    d = spark.createDataFrame([(1, "a b c d e", {"x": 1}), (1, "a b c d e", {"x": 1}), (None, "a b c d e", {"y": 2}), (2, "other words of a text", None)], "doc_id long, text string, `odd.name` map<string,int>")
    assert sorted(map(str, simhash.keep_one(d).collect())) == sorted(map(str, [d.collect()[0], d.collect()[3]]))


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7), (None, 3)]
    lab = {x: x for p in pairs if None not in p and p[0] != p[1] for x in p}
    for _ in range(99):
        for a, b in pairs:
            if a in lab and b in lab and a != b:
                lab[a] = lab[b] = min(lab[a], lab[b])
    got = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == lab and len(got) == len(lab)


# packing


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.integers(1, 32), st.integers(1, 40)), max_size=25))
def test_plan(lengths):
    counts = np.zeros(33, np.int64)
    for n, k in lengths:
        counts[n] += k
    places, made = packing.plan(counts, 32)
    spans = {}
    for n in range(1, 33):
        for rank in range(counts[n]):
            own = [p for p in places[n].tolist() if p[0] <= rank < p[1]]
            assert sorted(x for p in own for x in range(p[2], p[2] + p[3])) == list(range(n))
            for p in own:
                spans.setdefault(p[4] + rank - p[0], []).append((p[5], p[3]))
    assert sorted(spans) == list(range(made))
    for own in spans.values():
        end = 0
        for offset, n in sorted(own):
            assert offset == end
            end += n
        assert end <= 32
    assert made == -(-int((counts * np.arange(33)).sum()) // 32)


def test_least_squares():
    counts = np.array([0, 4, 2, 6, 0], float)
    columns = [(3, 1), (2, 2), (2, 1, 1)]
    x = packing.nonnegative(columns, counts, sweeps=500)
    a = np.zeros((5, 3))
    for j, c in enumerate(columns):
        for i in c:
            a[i, j] += 1
    rest = a.T @ (counts - a @ x)
    assert (x >= 0).all() and (rest < 1e-2).all() and abs(rest @ x) < 1e-1
    assert set(packing.combinations_filling(np.array([1, 2, 3]), 4)) == {(3, 1), (2, 2), (2, 1, 1)}


def test_packing(spark):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(TOKENIZER)
    rows = ODD + [(200 + i, "some words of a text " * (i % 40), "a") for i in range(150)] + [(900, "a <|endoftext|> b", "a")]
    got = packing.pack(docs(spark, rows), TOKENIZER, window=64, keep_ids=True).collect()
    want = sorted((str(i), tuple(slow.encode(t or "", add_special_tokens=False).ids) + (1,)) for i, t, _ in rows)
    by = {}
    for r in got:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        by.setdefault((str(r["doc_id"]), r["doc_tokens"]), []).append((r["start"], tuple(r["ids"])))
    for (i, n), parts in by.items():
        copies = [ids for k, ids in want if k == i and len(ids) == n]
        assert sorted(x for s, p in parts for x in range(s, s + len(p))) == sorted(list(range(n)) * len(copies))
        assert all(copies[0][s : s + len(p)] == p for s, p in parts)
    assert sum(r["length"] for r in got) == sum(len(ids) for _, ids in want)
    spans = {}
    for r in got:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in spans.values():
        assert sorted(own)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(own), sorted(own)[1:])) and sum(n for _, n in own) <= 64
    assert sum(sum(n for _, n in own) < 64 for own in spans.values()) <= 1
    assert packing.pack(docs(spark, ODD).where("false"), TOKENIZER).count() == 0


@pytest.mark.parametrize("blank", [" " * 1_000_001, "\r\n" * 500_001, "\u00a0\u3000" * 500_001, " " * 100_001, " " * 100_000])
def test_ids_of_very_long_blanks(blank):
    from tokenizers import Tokenizer

    text = f"a {blank}b\n"
    assert list(packing.encoder(TOKENIZER)(text)) == Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids


@given(st.lists(st.text(" \n\r\t\x1c\x85\u00a0\u3000\u200b", min_size=1, max_size=9) | st.text("ab1.'s é", max_size=4), max_size=12).map("".join))
def test_ids_of_cut_blanks(text):
    from unittest import mock

    encode = packing.encoder(TOKENIZER)
    with mock.patch.object(packing, "LONG_BLANK", 3):
        assert "".join(p for p, _ in packing.parts(text)) == text
        cut = list(encode(text))
    assert cut == list(encode(text))


def test_packing_of_very_long_blanks(spark):
    d = spark.sql("select 1L as doc_id, repeat(' ', 1000001) as text, 'a' as source union all select 2L, 'short', 'a'")
    got = packing.pack(d, TOKENIZER).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in got}[1] == 1_000_002 == sum(r["length"] for r in got if r["doc_id"] == 1)


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000, "\r\n" * 1_000_000 + "x"])
def test_two_megabytes_of_one_letter(text):
    from tokenizers import Tokenizer

    assert list(packing.encoder(TOKENIZER)(text)) == Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids


def test_packing_of_very_many_equal_rows(spark):
    rows = [(2**53 + 1, "the same few words", "a")] * 3000 + [(None, "no id", "a")] * 200 + [(2**53 + 3, "w " * 500, "a")]
    got = packing.pack(docs(spark, rows).repartition(6), TOKENIZER).collect()
    again = packing.pack(docs(spark, rows).repartition(3), TOKENIZER).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sum(r["length"] for r in got if r["doc_id"] == 2**53 + 1) == 3000 * next(r["doc_tokens"] for r in got if r["doc_id"] == 2**53 + 1)
    assert {r["doc_id"] for r in got} == {2**53 + 1, 2**53 + 3, None}
    spans = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    assert all(a[1] + a[2] == b[1] if a[0] == b[0] else b[1] == 0 for a, b in zip(spans, spans[1:])) and spans[0][1] == 0


@pytest.mark.parametrize("ids", [[], [1, 50256], [1, 70000]])
def test_packed_ids(ids):
    assert packing.unpacked(packing.packed(np.array(ids, np.uint32))).tolist() == ids
