"""BPE, packing, TIFF, HTML and WARC against plain re-computations."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib
from html import unescape

import numpy as np
import public_tokenizers
import pytest

from lanework.llm import bpe, html_text, packing, queries, tiff, warc

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def plain_bpe():
    import tiktoken

    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.mark.parametrize("leaf", [1, 3, 17, 64])
def test_tree_equals_whole_encoding(leaf, spark, sf_dir):
    plain, tree = plain_bpe(), bpe.TreeBpe(RANKS, leaf_chars=leaf)
    rng = random.Random(leaf)
    parts = ["don't", "we'll", " 's", "  ", "\n\n", "日本語", "é", "ß1", "12 34", "\t", "x" * 40, "'re", "  a", "!!", "  ", "\x1c", "😀", "y ", "Z\n"]
    for _ in range(150):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        assert tree.encode(text) == plain.encode_ordinary(text)
        assert tree.decode(tree.encode(text)) == text.encode()


def test_bpe_query(spark, sf_dir):
    plain = plain_bpe()
    found = {r.doc_id: r for r in queries.op10_bpe_tree(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(found) == len(docs)
    for d in docs:
        ids = plain.encode_ordinary(d.text or "")
        r = found[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_bpe_odd_rows(documents, nothing):
    plain = plain_bpe()
    rows = bpe.encode_documents(documents, RANKS, leaf_chars=50).collect()
    assert len(rows) == 10
    assert sorted(r.ids for r in rows) == sorted(plain.encode_ordinary(d.text or "") for d in documents.collect())
    assert sorted(bytes(r.decoded) for r in rows) == sorted((d.text or "").encode() for d in documents.collect())
    assert bpe.encode_documents(nothing, RANKS).count() == 0


def packed_well(rows, tokens_by_doc):
    by_sequence: dict = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= 4096
    return sum(tokens_by_doc) / (4096 * len(by_sequence))


def test_packing_query(spark, sf_dir):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    rows = queries.op2_pack_least_squares(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    ids = {d.doc_id: tokenizer.encode(d.text or "", add_special_tokens=False).ids + [2] for d in docs}
    covered: dict = {}
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        covered.setdefault(r.doc_id, []).append((r.start, r.length))
    for doc, parts in covered.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[doc])
    assert covered.keys() == ids.keys()
    assert packed_well(rows, [len(x) for x in ids.values()]) > 0.95


def test_word_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    tokenizer, mine = Tokenizer.from_file(WORDS), packing.WordBpe(WORDS, 2)
    rng = random.Random(5)
    letters = "aZ09.,'\"-_<|>éÀßÿÞ×÷µªº ñ" + "\u0301\u0130\u03a3\u03c3\u65e5\ufb01\u00a0\u2003\x1c\x7f\x85\x00" + "strevmld"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["<|endoftext|>", "it's we'LL <|startoftext|>x"]
    for text, found in zip(texts, mine.encode_many(texts), strict=True):
        assert np.frombuffer(found, "<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_packing_odd_rows(documents, nothing):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    rows = packing.pack(packing.token_pieces(documents, WORDS)).collect()
    lengths = [len(tokenizer.encode(d.text or "", add_special_tokens=False).ids) + 1 for d in documents.collect()]
    assert sum(r.length for r in rows) == sum(lengths)
    packed_well(rows, lengths)
    assert packing.pack(packing.token_pieces(nothing, WORDS)).count() == 0


def test_patterns_use_up_the_histogram():
    rng = np.random.default_rng(1)
    for n in (0, 1, 50, 5000):
        histogram = np.bincount(rng.integers(1, 257, n), minlength=257).astype(np.int64)
        used = np.zeros(257, np.int64)
        for option, times in packing.solve_patterns(histogram):
            assert sum(option) <= 256 and times > 0
            for i in option:
                used[i] += times
        assert (used == histogram).all()


def test_least_squares_finds_a_nonnegative_solution():
    rng = np.random.default_rng(2)
    options = np.full((20, 3), -1)
    for row in options:
        n = rng.integers(1, 4)
        row[:n] = rng.integers(0, 12, n)
    a = np.zeros((12, 20))
    for j, row in enumerate(options):
        for i in row[row >= 0]:
            a[i, j] += 1
    b = a @ np.maximum(0, rng.normal(size=20))
    found = packing.nonnegative_least_squares(options, b)
    assert found.min() >= 0 and np.abs(a @ found - b).max() < 1e-6
    b = rng.random(12) * 10  # no exact solution: at the least squares no gain is positive, and none where x is
    found = packing.nonnegative_least_squares(options, b)
    gain = a.T @ (b - a @ found)
    assert gain.max() < 1e-6 and np.abs(gain[found > 0]).max(initial=0) < 1e-6


def test_solver_is_light():
    import tracemalloc

    histogram = np.bincount(np.clip(np.random.default_rng(0).exponential(30, 250_000).astype(int) + 1, 1, 256), minlength=257)
    tracemalloc.start()
    patterns = packing.solve_patterns(histogram)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20 and histogram @ np.arange(257) > 0.99 * 256 * sum(times for _, times in patterns)


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.PACKBITS, tiff.ADOBE_DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, 16])
def test_tiff_round_trip(compression, predictor, tile):
    rng = np.random.default_rng(3)
    pages = [rng.integers(0, 4, (h, w, s), dtype=np.uint8) for h, w, s in ((1, 1, 1), (70, 33, 3), (200, 64, 1))]
    data = tiff.write_pages(pages, compression, predictor, tile=tile)
    read = [tiff.read_page(data, t) for t in tiff.directories(data)]
    assert len(read) == 3 and all((a == b).all() for a, b in zip(pages, read, strict=True))


def test_lzw_long():
    data = np.random.default_rng(4).integers(0, 256, 60000, dtype=np.uint8).tobytes() + b"ab" * 30000
    assert tiff.unpack_lzw(tiff.pack_lzw(data)) == data
    assert tiff.unpack_bits(tiff.pack_bits(data)) == data


def test_tiff_query(spark, sf_dir):
    docs = {d.doc_id: (d.text or "").encode() for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op3_tiff_pages(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        raw = docs[r.doc_id]
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.media_bytes > 0 and re.fullmatch("[0-9a-f]{64}", r.media_sha256)


def test_every_form_is_used(documents, spark):
    texts = [(i, f"{'ab' * (i % 40)} text {i} \u00e9 {'z' * (i % 300)}") for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = tiff.text_media(docs).collect()
    used = set()
    for r in rows:
        (tags,) = tiff.directories(bytes(r.media))
        used.add((tags[tiff.COMPRESSION][0], tags[tiff.PREDICTOR][0], tags.get(tiff.TILE_WIDTH, [None])[0]))
        assert tiff.read_page(bytes(r.media), tags).tobytes().rstrip(b" ") == texts[r.doc_id][1].encode().rstrip(b" ")
    assert used == set(tiff.FORMS)
    for form in set(tiff.FORMS):
        assert tiff.read_pages(tiff.text_media(documents, form=form)).where("error is null").count() == 10


def test_pack_bits_of_runs():
    rng = random.Random(3)
    for _ in range(300):
        data = b"".join(bytes([rng.randrange(4)]) * rng.choice([1, 1, 1, 2, 3, 127, 128, 129, 300]) for _ in range(rng.randrange(12)))
        assert tiff.unpack_bits(tiff.pack_bits(data)) == data


def test_tiff_pages_and_errors(spark, documents, nothing):
    two = tiff.write_pages([np.zeros((2, 3, 1), np.uint8), np.ones((4, 5, 3), np.uint8)])
    media = spark.createDataFrame([(1, bytearray(two)), (2, None), (3, bytearray(b"II*\0junk"))], "doc_id long, media binary")
    rows = tiff.read_pages(media).orderBy("doc_id", "page").collect()
    assert [(r.doc_id, r.page, r.n_pages, r.width, r.height, r.n_samples) for r in rows[:2]] == [(1, 0, 2, 3, 2, 1), (1, 1, 2, 5, 4, 3)]
    assert rows[2].error and rows[3].error and rows[2].page is None
    assert tiff.read_pages(tiff.text_media(documents)).where("error is null").count() == 10
    assert tiff.text_media(nothing).count() == 0


def test_main_text_of_all_pages(spark, sf_dir):
    """Every generated page marks its article, which gives the expected text."""
    wrong = 0
    rows = {r.page_id: r for r in queries.op1_html_blocks(spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        inside = re.search(r"<article>(.*?)(</article>|\Z)", p.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", unescape(re.sub(r"<(/?b|br)>", " ", x))).strip() for x in re.split(r"</?(?:p|h1)>", inside)]
        wrong += rows[p.page_id].text != "\n\n".join(x for x in parts if x)
    assert wrong == 0


def test_main_text_of_odd_pages(spark):
    tree = html_text.grow(*html_text.labelled_table())
    words = "one two three four five six seven eight nine ten eleven twelve "
    page = f"<body><div id='top-nav'><a href=/>Home</a> <a href=/n>News</a></div><div class='cookie-banner'>{words}</div><div class='post-content'><h2>A &amp; B&#33;</h2><p>{words}<b>bold</b> &lt;x&gt;<p>Short.<script>var a='<p>no</p>';</script></div><form>{words}<input></form><section class='comments'><p>{words}</p></section><aside>{words}</aside><footer>{words}</footer>"
    assert html_text.main_text(page, tree) == f"A & B!\n\n{words}bold <x>\n\nShort."
    assert html_text.main_text("", tree) == "" and html_text.main_text("<p", tree) in ("", "<p")
    rows = html_text.extract(spark.createDataFrame([(1, None, None, 1), (None, "u", "", 2), (2, "u", page, 3), (2, "u", page, 3)], "page_id long, url string, html string, text int")).collect()
    assert len(rows) == 4 and {r.n_chars for r in rows} == {0, len(f"A & B!\n\n{words}bold <x>\n\nShort.")}


CHANGES = {
    "div": lambda x: x.replace("<article>", "<div>").replace("</article>", "</div>"),
    "section": lambda x: x.replace("<article>", "<section>").replace("</article>", "</section>"),
    "body class": lambda x: x.replace("<body>", "<body class='has-sidebar'>").replace("<article>", "<div>").replace("</article>", "</div>"),
    "title attribute": lambda x: x.replace("<p>", "<p title='a hidden gem' data-x=nav>"),
    "article class": lambda x: x.replace("<article>", "<article class='post legal-news'>"),
    "no marks at all": lambda x: re.sub(r"<(/?)(?:nav|article|footer)>", r"<\1div>", x),
    "no footer": lambda x: re.sub(r"<footer>.*?</footer>", "", x, flags=re.S),
    "nothing else": lambda x: re.search(r"<article>.*</article>", x, re.S)[0].replace("article>", "div>"),
    "nested spans": lambda x: x.replace("<article>", "<article><span class=ad>buy <span>this</span> lamp</span>"),
}


@pytest.mark.parametrize("change", CHANGES)
def test_main_text_does_not_hang_on_marks(change):
    import pyarrow.parquet as pq

    tree = html_text.grow(*html_text.labelled_table())
    for html in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist():
        assert html_text.main_text(CHANGES[change](html), tree) == html_text.main_text(html, tree) != ""


def asked(tree):
    return set() if isinstance(tree, int) else {html_text.FEATURES[tree[0]]} | asked(tree[2]) | asked(tree[3])


def test_tree_asks_for_words_and_links_of_neighbours():
    rows, labels = html_text.labelled_table()
    tree = html_text.grow(rows, labels)
    assert {"link_density", "link_density_before", "words_after", "container_share"} <= asked(tree)
    assert sum(html_text.judge(tree, list(r)) == y for r, y in zip(rows, labels, strict=True)) > 0.98 * len(labels)


def plain_blocks(html):
    """Words and link density of each block by a regular expression over a page without nesting."""
    out = []
    for part in re.split(r"</?(?:p|div|h1|nav|footer|body)[^>]*>", html):
        text = re.sub(r"\s+", " ", re.sub(r"<[^>]*>", "", part)).strip()
        if text:
            linked = " ".join(re.findall(r"<a [^>]*>(.*?)</a>", part)).split()
            out.append((text, len(text.split()), len(linked) / len(text.split())))
    return out


def test_blocks_and_neighbours():
    rng = random.Random(6)
    for _ in range(50):
        bits = []
        for _ in range(rng.randint(1, 8)):
            tag = rng.choice(["p", "div", "h1"])
            inside = " ".join(rng.choice(["w", "two words", "<a href='/x?y=1>2'>link here</a>", "<b>bold</b>"]) for _ in range(rng.randint(0, 5)))
            bits.append(f"<{tag} title='a > b'>{inside}</{tag}>".replace("'a > b'", "t"))
        html = "<body>" + "".join(bits) + "</body>"
        plain = plain_blocks(html.replace("?y=1>2", ""))
        found = html_text.blocks(html)
        assert [(t, f[0], f[1]) for t, f in found] == plain
        for i, (_, f) in enumerate(found):
            assert (f[2], f[3]) == (plain[i - 1][1:] if i else (0, 0.0)) and (f[4], f[5]) == (plain[i + 1][1:] if i + 1 < len(plain) else (0, 0.0))


def test_malformed_pages_take_linear_time():
    import time

    tree = html_text.grow(*html_text.labelled_table())
    for bad in ("<a '" * 250_000, '<a b="' * 200_000, '<a b="x" ' * 100_000, "<" * 1_000_000, "<!--" * 250_000, "<script>" * 125_000, "<p>" * 330_000, "<span class=ad>" * 70_000):
        began = time.process_time()
        html_text.main_text(bad, tree)
        assert time.process_time() - began < 5


def test_tiff_keeps_good_pages(spark):
    good = [np.full((2, 3, 1), i, np.uint8) for i in range(3)]
    data = bytearray(tiff.write_pages(good))
    bits = [m.start() for m in re.finditer(re.escape(struct.pack("<HHI", tiff.BITS, 3, 1)), data)]
    assert len(bits) == 3
    data[bits[1] + 8] = 16
    media = spark.createDataFrame([(1, data), (2, bytearray(b"II*\0\0\0\0\0")), (3, bytearray(tiff.write_pages(good)))], "doc_id long, media binary")
    rows = tiff.read_pages(media).orderBy("doc_id", "page").collect()
    assert [(r.doc_id, r.page, r.n_pages, r.error is None) for r in rows] == [(1, 0, 3, True), (1, 1, 3, False), (1, 2, 3, True), (2, None, None, False), *((3, i, 3, True) for i in range(3))]
    assert [bytes(rows[i].samples) for i in (0, 2)] == [bytes([i] * 6) for i in (0, 2)]


def test_main_text_in_wrappers():
    tree = html_text.grow(*html_text.labelled_table())
    words = "one two three four five six seven eight nine ten eleven twelve "
    nav, foot = "<nav><a href=/>Home</a></nav>", f"<aside>{words}</aside><footer>{words}</footer>"
    inside = f"<h1>A</h1><p>{words}</p><p>{words * 2}</p><p>Short.</p>"
    text = f"A\n\n{words.strip()}\n\n{(words * 2).strip()}\n\nShort."
    for before, after in (("<body class='single right-sidebar'>", "</body>"), ("<html class=no-cookie><body id=menu>", "</body>"), ("<div class='content with-sidebar'>", "</div>"), ("<form id=aspnetForm>", "</form>"), ("<body class=menu><form><div class=has-sidebar>", "</div></form></body>")):
        for part in (f"<article>{inside}</article>", f"<main>{inside}</main>", f"<div class=content>{inside}</div>"):
            assert html_text.main_text(before + nav + part + foot + after, tree) == text
    assert html_text.main_text(f"{nav}<article>{inside}</article><section id=comments><article><p>{words * 9}</p></article></section>{foot}", tree) == text
    assert html_text.main_text(f"<div style='display:none'><article>{inside}</article></div>", tree) == ""


def test_warc_salvage():
    members = [warc.member(warc.record("response", f"urn:page:{i}", "http://a", bytes([i]) * 50)) for i in range(5)]
    whole = b"".join(members)
    assert [x[2]["warc-record-id"] for x in warc.salvage(whole)] == [f"<urn:page:{i}>" for i in range(5)]
    broken = bytearray(members[1])
    broken[-6] ^= 255
    data = b"noise" + members[0] + bytes(broken) + members[2] + members[3][:-9] + b"\0\0" + members[4] + b"tail"
    found = list(warc.salvage(data))
    assert [x[2]["warc-record-id"] for x in found if x[2]] == ["<urn:page:0>", "<urn:page:2>", "<urn:page:4>"]
    gaps = [(x[0], x[1]) for x in found if x[2] is None]
    at1, at3 = 5 + len(members[0]), 5 + len(members[0]) + len(broken) + len(members[2])
    assert gaps == [(0, 5), (at1, len(broken)), (at3, len(members[3]) - 9 + 2), (len(data) - 4, 4)]
    plain = b"".join(warc.record("response", f"urn:page:{i}", "http://a", b"p%d" % i) for i in range(3))
    bad = plain.replace(b"\r\n\r\np1\r\n", b"\r\n\r\nq1\r\n")
    found = list(warc.salvage(bad))
    assert [x[3] for x in found if x[2]] == [b"p0", b"p2"] and [x[4] for x in found if x[4]] == ["payload digest differs"]
    assert list(warc.salvage(b"")) == []


def test_warc_salvage_inside_members():
    rng = random.Random(4)
    rows = [warc.record("response", f"urn:page:{i}", "http://a", rng.randbytes(3000)) for i in range(12)]
    alone = warc.member(warc.record("response", "urn:page:99", "http://a", b"next"))
    ids = lambda data: [int(x[2]["warc-record-id"][10:-1]) for x in warc.salvage(data) if x[2]]
    for broken in ([0], [4], [11], [0, 5, 6]):
        plain = b"".join(r.replace(b"\r\n\r\n", b"\r\n\r\n!", 1) if i in broken else r for i, r in enumerate(rows))
        data = warc.member(plain) + alone
        assert ids(data) == [i for i in range(12) if i not in broken] + [99]
        assert sum(x[2] is None for x in warc.salvage(data)) == (2 if len(broken) == 3 else 1)
    for level in (0, 1):
        whole = warc.member(b"".join(rows), level)
        failed = bytearray(whole)
        failed[-6] ^= 255
        assert ids(bytes(failed) + alone) == [*range(12), 99]
        cut = whole[: len(whole) * 6 // 10]
        assert ids(cut) == [*range(7)] and ids(cut + alone) == [*range(7), 99]
        found = list(warc.salvage(cut + alone))
        assert {x[:2] for x in found[:-1]} == {(0, len(cut))} and found[-2][4] and found[-1][:2] == (len(cut), len(alone))
        assert [x[2] is None for x in found] == [False] * 7 + [True, False]
    junk = warc.member(b"no record at all" * 9)
    assert [(x[0], x[1], x[4]) for x in warc.salvage(junk + alone)][:1] == [(0, len(junk), "no version line")]


def test_warc_pages(spark):
    big = "x" * 1000
    rows = [(1, "u1", big, 0), (2, "u2", big, 0), (2, "u2", big, 0), (3, None, "small", 0), (4, "u4", "small", 0), (5, "u5", None, 0), (None, "u6", big, 0), (7, "u7", big + "é", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int")
    found = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in warc.archive_pages(pages).collect())
    assert found == sorted([(1, 1000, "revisit", 2), (2, 1000, "response", 0), (2, 1000, "response", 0), (3, 5, "response", 0), (4, 5, "response", 0), (5, 0, "response", 0), (0, 1000, "revisit", 2), (7, 1002, "response", 0)])
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_archives_are_filled_and_checked(spark, tmp_path):
    rng = random.Random(2)
    pages = spark.createDataFrame([(i, "u", rng.randbytes(700).hex()) for i in range(2500)], "page_id long, url string, html string").coalesce(2)
    folder = f"file://{tmp_path}/warc"
    written = warc.write_archives(warc.plan_records(pages), folder, file_bytes=400_000).collect()
    assert sum(r.records for r in written) == 2500 and len(written) < 12 and sum(r.bytes >= 400_000 for r in written) >= len(written) - 8
    (tmp_path / "warc" / "part-000099-000000.warc.gz").write_bytes(warc.member(warc.record("response", "urn:page:7", "u", b"of a task that failed")))
    table = spark.createDataFrame(written)
    found = warc.read_archives(spark, folder, payloads=False)
    assert warc.lost_files(table, found).count() == 0
    first = tmp_path / "warc" / written[0].file
    data = bytearray(first.read_bytes())
    data[len(data) // 2] ^= 255
    first.write_bytes(bytes(data))
    (lost,) = warc.lost_files(table, found).collect()
    assert lost.file == written[0].file and lost.read == lost.records - 1 and lost.gaps == 1


def test_warc_query(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    expected = con.execute(queries.ORACLES["op5_warc_salvage"]).fetchall()
    found = queries.op5_warc_salvage(spark, sf_dir).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))


def test_warc_salvage_is_linear():
    """Version lines, member starts and unfinished headers without end: each byte is looked at a few times only; sound records after them are found."""
    import time

    sound = warc.record("response", "urn:page:1", "http://a", b"x" * 50)
    for junk in (b"WARC/1.0\r\n", b"WARC/1.1\r\nA: b\r\n", warc.MEMBER, b"WARC/1.0\r\n" + b"y" * 3000 + b"\r\n"):
        data = junk * ((2 << 20) // len(junk))
        start = time.perf_counter()
        found = list(warc.salvage(data + b"\r\n\r\n" + sound))
        inner = warc.records_in(data + b"\r\n\r\n" + sound)[0]
        assert time.perf_counter() - start < 12
        assert [x[2]["warc-record-id"] for x in found if x[2]] == ["<urn:page:1>"] and [x[0]["warc-record-id"] for x in inner if x[0]] == ["<urn:page:1>"]
        assert sum(x[1] for x in found) == len(data) + 4 + len(sound)
    longest = warc.record("response", "urn:page:2", "http://a/" + "u" * (60 << 10), b"z")
    assert [x[4] for x in warc.salvage(longest)] == [None]
    assert "do not end" in next(warc.salvage(warc.record("response", "urn:page:2", "u" * (70 << 10), b"z")))[4]
    assert [x[2]["warc-target-uri"] for x in warc.salvage(warc.record("response", "urn:page:3", "see WARC/1.0", b"z")) if x[2]] == ["see WARC/1.0"]


def test_warc_salvage_of_mutated_archives():
    rng = random.Random(8)
    whole = b"".join(warc.member(warc.record("response", f"urn:page:{i}", "http://a", rng.randbytes(400)) * (1 + i % 2)) for i in range(6)) + warc.record("response", "urn:page:9", "http://a", b"plain")
    for _ in range(500):
        data = bytearray(whole)
        for _ in range(rng.randint(1, 12)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        if rng.random() < 0.3:
            a = rng.randrange(len(data))
            del data[a : a + rng.randint(1, 300)]
        found = list(warc.salvage(bytes(data)))
        assert sum(x[1] for x in {(x[0], x[1]): x for x in found}.values()) == len(data)


def test_tiff_damage_costs_its_own_row(spark):
    """Mutated and malformed files give error rows, never a failed task."""
    rng = random.Random(3)
    page = np.frombuffer(rng.randbytes(192 * 20), np.uint8).reshape(20, 192, 1)
    rows = []
    for compression, predictor, tile in tiff.FORMS[:8]:
        whole = tiff.write_pages([page, page[:5]], compression, predictor, tile=tile)
        for _ in range(65):
            data = bytearray(whole)
            for _ in range(rng.randint(1, 4)):
                data[rng.choice((rng.randrange(len(data)), len(data) - 1 - rng.randrange(300)))] = rng.choice((0, 1, 255, rng.randrange(256)))
            rows.append(bytes(data))
    files = spark.createDataFrame(list(enumerate(rows)), "doc_id long, media binary")
    found = tiff.read_pages(files, samples=False).collect()
    assert {r.doc_id for r in found} == set(range(len(rows))) and any(r.error for r in found) and any(r.error is None for r in found)

    def changed(tag, value, tile=64):
        data = bytearray(tiff.write_pages([page], tiff.ADOBE_DEFLATE, 1, tile=tile))
        at = struct.unpack_from("<I", data, 4)[0]
        for i in range(struct.unpack_from("<H", data, at)[0]):
            if struct.unpack_from("<H", data, at + 2 + 12 * i)[0] == tag:
                struct.pack_into("<I", data, at + 10 + 12 * i, value)
        return bytes(data)

    bad = [changed(tiff.TILE_WIDTH, 0), changed(tiff.TILE_LENGTH, 0), changed(tiff.WIDTH, 400_000), changed(tiff.HEIGHT, 0), changed(tiff.TILE_LENGTH, 1 << 31), changed(tiff.ROWS_PER_STRIP, 0, None)]
    huge = bytearray(changed(tiff.WIDTH, 400_000))
    found = tiff.read_pages(spark.createDataFrame(list(enumerate([*bad, bytes(huge), None, b""])), "doc_id long, media binary")).collect()
    assert len(found) == 9 and all(r.error for r in found)
