"""Archives, media, chats, pages and embeddings: round trips, damage, brute force; nulls, repeats, empty tables, clashing columns."""

import hashlib
import io
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ringseq.llm import chat, dom, egojoin, extraction, layouts, media, queries, warc

# archives


@given(st.binary(max_size=3000), st.integers(1, 700))
def test_chunks(payload, size):
    buf = io.BytesIO()
    digest = hashlib.sha1(payload).hexdigest()
    own = [("7", "http://x/\r\n%", digest, len(payload), None, k, memoryview(payload)[i : i + 100]) for k, i in enumerate(range(0, max(1, len(payload)), 100))]
    assert warc.write_records(buf, [*own, *own, ("8", None, digest, len(payload), "7", 0, memoryview(b""))], packed=False) == 3
    buf.seek(0)
    rows = list(warc.chunks_of(buf, size))
    for k in (0, 1):
        own = rows[k * (len(rows) - 1) // 2 : (k + 1) * (len(rows) - 1) // 2]
        assert b"".join(r[7] for r in own) == payload and [r[6] for r in own] == list(range(len(own)))
        assert [r[9] for r in own] == [hashlib.sha1(payload[: r[8]]).hexdigest() for r in own]
        assert [r[10] for r in own] == [False] * (len(own) - 1) + [True] and own[0][2] == "http://x/\r\n%"
    assert rows[-1][:6] == ("8", "revisit", None, "7", digest, len(payload))


def test_damaged_archive():
    buf = io.BytesIO()
    row = lambda data, n=100, chunk=0, digest="": ("1", "u", digest, n, None, chunk, memoryview(data))
    warc.write_records(buf, [row(b"x" * 100)], packed=False)
    with pytest.raises(EOFError):
        list(warc.chunks_of(io.BytesIO(buf.getvalue()[:-60]), 10))
    with pytest.raises(ValueError):
        list(warc.chunks_of(io.BytesIO(b"junk\r\n" + buf.getvalue()), 10))
    for bad in ([row(b"x" * 99)], [row(b"x" * 101)], [row(b"x" * 50), row(b"x" * 50, chunk=2)]):
        with pytest.raises(ValueError):
            warc.write_records(io.BytesIO(), bad)
    other = io.BytesIO()
    warc.write_records(other, [row(b"x" * 100, digest=hashlib.sha1(b"y").hexdigest())], packed=False)
    other.seek(0)
    with pytest.raises(ValueError, match="digest"):
        list(warc.chunks_of(other, 10))


def test_a_record_of_300_mb_in_chunks(spark):
    """Written and read as rows of chunks; no worker grows by more than a few of them."""
    data, n = b"0123456789abcdef" * 65536, 300
    digest = hashlib.sha1()
    for _ in range(n):
        digest.update(data)
    one = spark.range(n).selectExpr("'big' record_id", "'u' uri", f"'{digest.hexdigest()}' digest", f"{n << 20}L bytes", "cast(null as string) refers_to", "int(id) chunk", "encode(repeat('0123456789abcdef', 65536), 'UTF-8') data")
    chunks = warc.read(spark, warc.write_chunks(one), chunk_bytes=1 << 20)

    def grown(batches):
        import resource

        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"chunk": b.column(0), "n": pc.binary_length(b.column(1)), "same": [x.as_py() == data for x in b.column(1)], "mb": [resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024] * b.num_rows})

    import pyarrow.compute as pc

    got = chunks.select("chunk", "data").mapInArrow(grown, "chunk int, n int, same boolean, mb long").collect()
    assert sorted((r["chunk"], r["n"], r["same"]) for r in got) == [(i, 1 << 20, True) for i in range(n)]
    assert max(r["mb"] for r in got) < 350
    assert chunks.where("last").select("bytes_so_far", "digest_so_far").collect() == [(n << 20, digest.hexdigest())]


def test_archive_query(spark, tmp_path):
    big = 2**60
    pages = [(1, "u", None, 0), (2, None, "é" * 600, 0), (big + 1, "u\n", "é" * 600, 0), (3, "u", "a" * 999, 0), (4, "u", "a" * 999, 0), (5, "u", "b" * 1000, 0), (5, "u", "b" * 1000, 0), (6, "", "", 0)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest int")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    got = {(r["page_id"], r["record_type"], r["refers_to"]): r for r in queries.op3_warc(spark, str(tmp_path)).collect()}
    assert set(got) == {(1, "response", None), (2, "revisit", big + 1), (big + 1, "response", None), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None)}
    for i, _, html, _ in pages:
        r = next(r for k, r in got.items() if k[0] == i)
        assert (r["payload_bytes"], r["payload_digest"]) == (len((html or "").encode()), hashlib.sha1((html or "").encode()).hexdigest())
    df.where("false").write.parquet(str(tmp_path / "none/pages.parquet"))
    assert queries.op3_warc(spark, str(tmp_path / "none")).count() == 0


# media


@given(st.binary(max_size=4000))
def test_carried_bytes(payload):
    data = media.carry(media.padded(payload), len(payload))
    x = media.parse(data)
    assert media.carried(data, x) == media.padded(payload) and x.tags["payload-bytes"] == str(len(payload))
    assert x.failed == x.resyncs == x.skipped == 0 and x.checked == len(x.offsets) == x.table_frames and x.samples == 1152 * len(x.offsets)
    assert x.table_bytes == len(data) - x.offsets[0] + 192


@pytest.mark.parametrize("units", range(1, 10))
def test_payload_that_looks_like_an_id3v1_tag(units):
    n = units * media.UNIT
    for at in range(max(0, n - 800), n - 2):
        payload = (b"ACGT" * n)[:at] + b"TAG" + (b"GATTACA" * n)[: n - at - 3]
        data = media.carry(payload, n)
        for extra in (b"", b"TAG" + b"name".ljust(125, b"\0")):
            x = media.parse(data + extra)
            assert media.carried(data, x) == payload and x.failed == x.skipped == 0 and ("TIT2" in x.tags) == bool(extra)
    lost = media.parse(data[:-50] + extra)  # the last frame is cut, a tag follows
    assert lost.tags["TIT2"] == "name" and lost.skipped == 3 * media.RATE_OF_UNITS[units % 4 or 4] - 50


def test_damage_and_resynchronization():
    data = media.carry(media.padded(b"q" * 9000), 9000)
    x = media.parse(data)
    cut = data[: x.offsets[3]] + b"\xff\xe0junk\xff\xfb\x90" + data[x.offsets[3] :]
    y = media.parse(cut)
    assert len(y.offsets) == len(x.offsets) and y.resyncs == 1 and y.skipped == 9
    bad = bytearray(data)
    bad[x.offsets[2] + 10] ^= 1  # in the side information of a frame
    assert media.parse(bytes(bad)).failed == 1
    half = media.parse(data[: x.offsets[5] + 10])
    assert len(half.offsets) == 5 and half.skipped == 10
    assert media.parse(None).offsets == media.parse(b"").offsets == media.parse(b"no audio \xff\xfb at all").offsets == []
    v1 = data + b"TAG" + b"name".ljust(125, b"\0")
    assert media.parse(v1).tags["TIT2"] == "name" and media.parse(v1).skipped == 0


def plain_checksum(bits):
    c = 0xFFFF
    for b in bits:
        c = (c << 1 ^ 0x8005 * ((c >> 15) ^ b)) & 0xFFFF
    return c


def test_checksums_of_layers():
    """Layer I: the allocation of all bands; Layer II: that, and two bits for each band with samples."""
    rng = np.random.default_rng(5)
    bits_of = lambda raw: [x >> 7 - i & 1 for x in raw for i in range(8)]
    for word, bits in ((0xFFFEB0C0, 128), (0xFFFEB000, 256), (0xFFFEB050, 4 * (32 + 8))):
        h = media.header(word)
        assert h.layer == 1 and h.checked
        for fault in (0, 1):
            rest = rng.integers(0, 256, h.length - 6, np.uint8).tobytes()
            head = word.to_bytes(4, "big")
            frame = head + plain_checksum(bits_of(head[2:]) + bits_of(rest)[:bits]).to_bytes(2, "big") + rest
            frame = frame[:-fault or None] + b"?" * fault if not fault else frame[:7] + bytes([frame[7] ^ 1]) + frame[8:]
            x = media.parse(frame * 3)
            assert (x.checked, x.failed, len(x.offsets)) == (3, 3 * fault, 3)
    word = 0xFFFCA4C0  # Layer II, 160 kbit/s, 48 kHz, mono: 27 bands of 4, 3 and 2 bits
    h = media.header(word)
    sizes = [4] * 11 + [3] * 12 + [2] * 4
    rest = rng.integers(0, 256, h.length - 6, np.uint8).tobytes()
    raw, at, used = bits_of(rest), 0, 0
    for n in sizes:
        used += any(raw[at : at + n])
        at += n
    head = word.to_bytes(4, "big")
    frame = head + plain_checksum(bits_of(head[2:]) + raw[: at + 2 * used]).to_bytes(2, "big") + rest
    assert h.layer == 2 and media.checked_bits(h, rest) == at + 2 * used
    x = media.parse(frame * 2)
    assert (x.checked, x.failed) == (2, 0) and media.parse((frame[:6] + bytes([frame[6] ^ 0x80]) + frame[7:]) * 2).failed == 2


def test_tags_and_tables():
    seven = lambda n: bytes(n >> s & 127 for s in (21, 14, 7, 0))
    audio = media.carry(b"z" * 1920, 1920)
    audio = audio[audio.index(b"\xff\xfb") :]
    plain = b"TT2\0\0\5\0name" + b"TXX\0\0\5\0k\0vv"
    two = b"ID3\2\0\0" + seven(len(plain)) + plain
    body = b"TIT2\0\0\0\4\0\0\0a\xff\xe0"
    three = b"ID3\3\0\xc0" + seven(len(e := (b"\0\0\0\6" + bytes(6) + body).replace(b"\xff", b"\xff\0"))) + e
    inner = b"\0b\xff\0c"
    four = b"ID3\4\0\x40" + seven(len(f := seven(6) + b"\1\0" + b"TIT2" + seven(len(inner) + 4) + b"\0\3" + seven(4) + inner)) + f
    assert media.parse(two + audio).tags == {"TT2": "name", "k": "vv"}
    assert media.parse(three + audio).tags == {"TIT2": "a\xff\xe0"} and media.parse(four + audio).tags == {"TIT2": "b\xffc"}
    x = media.parse(three + audio)
    assert x.skipped == 0 and len(x.seek) == 100 and x.seek[0] == len(three) and sorted(x.seek) == x.seek
    frame = media._frame_header(64, False).ljust(192, b"\0")
    vbri = frame[:36] + b"VBRI" + bytes([0, 1, 2, 64, 0, 75]) + (960).to_bytes(4, "big") + (4).to_bytes(4, "big") + bytes([0, 4, 0, 2, 0, 2, 0, 1]) + b"".join((96).to_bytes(2, "big") for _ in range(4))
    x = media.parse(vbri.ljust(192, b"\0") + frame * 4)
    assert (x.table, x.table_bytes, x.table_frames, x.seek, x.delay) == ("VBRI", 960, 4, [192, 384, 576, 768], 0x240)
    lame = frame[:21] + b"Info" + (0).to_bytes(4, "big") + b"LAME3.100" + bytes(12) + (576 << 12 | 1100).to_bytes(3, "big")
    x = media.parse(lame.ljust(192, b"\0") + frame)
    assert (x.table, x.delay, x.padding, x.samples) == ("Info", 576, 1100, 1152)


def test_frame_lengths():
    assert (media.header(0xFFFB9064).length, media.header(0xFFFB9064).rate, media.header(0xFFFB9064).kbps) == (417, 44100, 128)
    assert media.header(0xFFFB9264).length == 418 and media.header(0xFFF39064).samples == 576
    assert media.header(0xFFFBF064) is media.header(0xFFFB0064) is media.header(0) is None


def test_media_query(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "é" * 96), (4, "é" * 96), (5, "x" * 200000), (None, "a"), (5, "x" * 200000)]
    spark.createDataFrame([(i, t, b"clash") for i, t in rows], "doc_id long, text string, media binary").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op6_media(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for i, t in rows:
        raw = (t or "").encode()
        pad = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        r = next(r for r in got if r["doc_id"] == i)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-16:]))
        assert f"samples={1152 * -(-len(pad) // 768)};" in r["feature"]
    one = media.parsed(spark.createDataFrame([(media.carry(b"x" * 192, 192), {"a": 1})], "media binary, clash map<string,int>")).first()
    assert one["clash"] == {"a": 1} and one["audio"]["tags"] == {"payload-bytes": "192"} and len(one["audio"]["seek"]) == 100
    parsed = media.parsed(spark.createDataFrame([(None,)], "media binary")).first()["audio"]
    assert parsed["frames"] == 0 and parsed["offsets"] == []


# chats


@given(st.text("\\<|>n\na", max_size=30), st.text("\\<|>n\na", max_size=10))
def test_escapes(text, role):
    turn = f"{chat.START}{chat.escape_role(role)}\n{chat.escape(text)}{chat.END}\n"
    found = chat._TURN.findall(turn * 2)
    assert [(chat.unescape(a), chat.unescape(b)) for a, b in found] == [(role, text)] * 2


@settings(deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", ""]), st.text("ab <|\\", max_size=40)), min_size=1, max_size=20), st.integers(5, 60), st.integers(0, 40))
def test_windows(turns, budget, history):
    w = chat.Windows(budget, history)
    out = [x for role, text in turns for x in w.add(role, text)] + [w.close()]
    new, loss = [], []
    for i, (n, text, repeated, fresh, tokens, mask) in enumerate(out):
        found = [(chat.unescape(a), chat.unescape(b)) for a, b in chat._TURN.findall(text)]
        assert n == i and len(found) == repeated + fresh and fresh >= 1
        cost = [chat.count_tokens(t) + 4 for _, t in found]
        assert tokens == sum(cost)
        context = cost[:repeated]
        if i and turns[0][0] == "system":
            assert found[0] == turns[0]
            context = context[1:]
        assert sum(context) <= history
        assert tokens <= budget or fresh == 1 and not context
        new += found[repeated:]
        loss += [chat.unescape(text[a:b]) for a, b in mask]
    assert new == turns and loss == [t for r, t in turns if r == "assistant"]


def test_chat_query(spark, tmp_path):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi \\n <|im_end|>"), (1, 2, "assistant", "long " * 900), (1, 3, "user", None), (1, 4, "assistant", "é"), (2, 0, None, "x"), (None, 0, "assistant", "z"), (3, None, "user", "b"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a"), (4, 0, "system", "alone")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, window int")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in queries.op8_chat(spark, str(tmp_path)).collect()}
    trap = f"{chat.END}{chat.START}assistant ok"
    rows += [(-1, 0, "user", trap), (-1, 1, "assistant", trap)]
    assert set(got) == {r[0] for r in rows}
    for c in got:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is None, r[1] or 0))
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(own), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    formatted = chat.format_chats(df)
    assert sorted(map(str, chat.read_back(formatted).collect())) == sorted(map(str, chat.read_back(formatted, in_order=True).collect()))
    assert chat.read_back(chat.format_chats(df.where("false"))).count() == 0


# pages


def test_tree():
    nodes = dom.tree("<!DOCTYPE html><body><!-- <p>no --><p>a &amp; b<p>c<br>d <b>e</b><ul><li>f<li><a href=x>g</a></ul><script>var t='</p>';</script><table><tr><td>h<td>i</table>&nbsp;j<div title='>'>k</div><foot")
    assert [n.text for n in nodes if n.text] == ["a & b", "c d e", "f", "g", "h", "i", "j", "k"]
    assert [nodes[n.parent].tag for n in nodes if n.text] == ["p", "p", "li", "li", "td", "td", "body", "div"]
    assert [n.links for n in nodes if n.text == "g"] == [1]
    for odd in ("", "<", "<p", "</p>", "<p class='x>y", "<script>x", "<!--", "</div></p><p>", "a<b", "&#x110000;&bogus;"):
        dom.tree(odd)


def test_marginals_on_a_tree():
    rng = np.random.default_rng(2)
    model = extraction.Model(rng.normal(size=extraction.WIDTH), rng.normal(size=(4, 2, 2)))
    nodes = dom.tree("<div class=menu><p>a b c.</p>d</div><article>e</article>")
    g = extraction.Graph([nodes])
    x, parent, kind = np.zeros((g.size, extraction.WIDTH)), g.parent, g.kind
    x[g.node, g.column] = g.value
    n, total, good, pairs = len(nodes), 0.0, np.zeros(len(nodes)), np.zeros((len(nodes), 2, 2))
    for bits in range(1 << n):
        y = np.array([bits >> i & 1 for i in range(n)])
        p = np.exp((x @ model.weights) @ y + sum(model.table[kind[i], y[parent[i]], y[i]] for i in range(1, n)))
        total += p
        good += p * y
        for i in range(1, n):
            pairs[i, y[parent[i]], y[i]] += p
    p, pair = model.marginals(g)
    assert np.allclose(p, good / total) and np.allclose(pair, pairs / total)
    assert np.allclose(g.scores(model.weights), x @ model.weights) and np.allclose(g.sums(p), p @ x)


@pytest.mark.parametrize("family", [None, *layouts.FAMILIES])
def test_extraction_of_labelled_pages(family):
    """Pages of a family that the model has not seen; of all that it has."""
    model, hit, wrong, missed = extraction.train(without=family), 0, 0, 0
    pages = layouts.pages(100, 77, only=family)
    for html, got in zip(pages, extraction.main_texts(model, pages)):
        nodes, label = extraction.labels_of(dom.tree(html))
        want, found = [n.text for n, y in zip(nodes, label) if y and n.text], got.split("\n\n") if got else []
        hit += sum(len(t) for t in found if t in want)
        wrong += sum(len(t) for t in found if t not in want)
        missed += sum(len(t) for t in want if t not in found)
    assert hit / (hit + wrong) > 0.9 and hit / (hit + missed) > 0.85


@pytest.mark.parametrize("page", ["<!" * 500_000, "<div>" * 100_000 + "x" + "</div>" * 100_000, "<div>" * 100_000 + "</p>" * 100_000, '<a ">" ' * 150_000, "<script>" + "</script " * 100_000, "<svg>" * 200_000, "<ul><li>" * 100_000, "&#" + "9" * 1_000_000 + ";", "<" * 1_000_000, "<p " + "a=\"' " * 200_000])
def test_hostile_pages_take_linear_time(page):
    model, began = extraction.train(), time.process_time()
    extraction.main_texts(model, [page])
    assert time.process_time() - began < 6  # 2 seconds on an idle core


def test_elements_that_are_not_skipped():
    texts = lambda html: [n.text for n in dom.tree(html) if n.text]
    assert texts("<p>a <math><mi>x</mi></math> b<noscript>c</noscript><object>d</object>") == ["a x bcd"]
    assert texts("<p>a<svg><text>no</text></svg>b<svg>c<template>d") == ["abcd"]
    assert texts("<p>a<svg><text>no") == ["ano"] and texts("<p>a<script>no") == ["a"]
    assert texts('<p title="a > b">c</p><p title="x>d</p>') == ["c", "d"]
    assert texts("a &#0000000000065; &#99999999999999; &#x0000000041;") == ["a A � A"]


def test_extraction_query(spark, tmp_path):
    page = "<html><head><title>no</title></head><body><nav><ul><li><a href=/>Home</a><li><a href=/b>Back</a></ul></nav><div class='cookie-notice'>We use cookies.</div><article><h1>A  title</h1><p>First &lt;line&gt;<br>goes on here.\n\n<p>Second line, of some words.<div class=ad>Buy this now.</div></article><div id=comments><div class=comment><p>I do not agree with this.</p></div></div><footer>&copy; x.com</footer></body></html>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (1, "u", page), (None, "u", "<nav><a href=x>y</a></nav>")]
    spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string").write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.op5_extraction(spark, str(tmp_path)).collect()
    assert len(got) == 5 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["text"] for r in got if r["page_id"] == 1} == {"A title\n\nFirst <line> goes on here.\n\nSecond line, of some words."}
    assert {r["text"] for r in got if r["page_id"] != 1} == {""}


# embeddings


def brute(vectors, t=0.95):
    unit = [None if v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v) else np.array(v, float) / np.linalg.norm(np.array(v, float)) for _, v in vectors]
    n, links, lab = len(unit), [0] * len(unit), list(range(len(unit)))
    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= t:
                links[i] += 1
                links[j] += 1
                a, b = lab[i], lab[j]
                lab = [min(a, b) if x in (a, b) else x for x in lab]
    return sorted((i, k, min(x for (x, _), g in zip(vectors, lab) if g == c)) for (i, _), k, c in zip(vectors, links, lab))


def test_similar(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 8))
    vectors = [(i, [float(x) for x in base[i % 12] * (1 + i % 3) + rng.normal(size=8) * 0.12]) for i in range(260)]
    vectors += [(1000 + i, vectors[i % 5][1]) for i in range(20)] + [(7, vectors[7][1])]
    vectors += [(-1, None), (-2, []), (-3, [0.0] * 8), (-4, [float("nan")] * 8), (-5, [1.0, None] + [0.0] * 6), (-6, [float("inf")] * 8), (-7, [3.0]), (-8, [2.0]), (-9, [-1.0])]
    df = spark.createDataFrame([(i, v, 0, 0, "x") for i, v in vectors], "vec_id long, embedding array<double>, label int, n int, fine string")
    got = egojoin.similar(df, task_bytes=40 * 64)
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect()) == brute(vectors)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.collect())
    assert egojoin.similar(df.where("false")).count() == 0
    assert egojoin.similar(df.where("vec_id < 0 and vec_id > -7")).agg(F.sum("n_links")).first()[0] == 0


@settings(deadline=None, max_examples=20)
@given(st.integers(0, 10**6), st.sampled_from([2, 5, 20]))
def test_interval_join(seed, dims):
    rng = np.random.default_rng(seed)
    x = egojoin.unit(rng.normal(size=(700, dims)) + rng.integers(0, 3, (700, 1)))
    t = 0.97
    eps = float(np.sqrt(2 - 2 * t))
    p = egojoin.projected(x, egojoin.basis(x, min(4, dims)))
    assert np.allclose((p * p).sum(axis=1), 1)
    at = egojoin.order(p, eps)
    side = egojoin.Side(x[at], p[at])
    pairs = {(int(at[a]), int(at[b])) for i, j in egojoin.join(side, side, True, t, eps) for a, b in zip(i, j)}
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(x @ x.T >= t, 1)))}
    near = {(min(p), max(p)) for p in pairs}
    edge = {p for p in near ^ want if abs(x[p[0]] @ x[p[1]] - t) > 1e-12}  # sums of another order may round otherwise
    assert len(near) == len(pairs) and not edge
