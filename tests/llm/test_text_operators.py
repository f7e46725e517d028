import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from surveyq.llm.common import ALNUM, SOLID, texts_of, word_hash, words_of
from surveyq.llm.html_text import between, extract_main_text, main_text
from surveyq.llm.license_scan import compile_template, scan_licenses
from surveyq.llm.media import Sniffer, from_wav, sniff, store_media, to_wav
from surveyq.llm.token_counts import count_tokens
from surveyq.llm.tokens import ByteIds, WordCounts, read_vocabulary, splice
from tests.llm.cases import ROWS, as_dict, documents, empty

pa = pytest.importorskip("pyarrow")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM_RE, SOLID_RE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(r"[^\x20\x09-\x0D]+")
text = st.text(st.characters(codec="utf-8"), max_size=60)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), text), max_size=6))
def test_words_follow_the_patterns(values):
    texts = texts_of(pa.array(values, pa.string()))
    for table, pattern in ((ALNUM, ALNUM_RE), (SOLID, SOLID_RE)):
        w = words_of(texts, table)
        for i, v in enumerate(values):
            want = pattern.findall((v or "").translate(LOWER))
            got = w.hash[w.first[i] : w.first[i + 1]].tolist()
            assert got == [word_hash(x) for x in want]


def test_a_word_longer_than_a_block():
    long = "x" * 700_000
    w = words_of(texts_of(pa.array([long + " y", long], pa.string())), ALNUM)
    assert w.hash.tolist() == [word_hash(long), word_hash("y"), word_hash(long)]


# --- licenses ----------------------------------------------------------------


def test_templates():
    def accepts(markup, said):
        a = compile_template("l", markup)
        words = [word_hash(x) for x in said.split()]
        return a.match(words, 0, len(words)) == len(words)

    t = "<<optional>>the<</optional>> mit license copyright <<any 3>> permission"
    assert accepts(t, "mit license copyright permission") and accepts(t, "the mit license copyright 2020 jane doe permission")
    assert not accepts(t, "mit license copyright 1 2 3 4 permission") and not accepts(t, "the mit copyright permission")
    for bad in ("<<optional>>a", "a<</optional>>", "<<optional>>a<</optional>>", ""):
        with pytest.raises(ValueError):
            compile_template("l", bad)


def test_license_scan(spark):
    rows = [*ROWS, (20, "Under the MIT license. under THE mit-license; cc BY nc 4"), (21, "under the permissive mit license")]
    got = as_dict(scan_licenses(documents(spark, rows)))
    assert {k: got[20][k] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels")} == {
        "n_words": 12, "n_base": 3, "first_word": 0, "last_word": 8, "base_labels": "cc-by-nc,mit", "labels": "cc-by-nc,mit"}
    assert got[7]["base_labels"] == "apache-2" and got[7]["score"] == 1.0 and got[8]["labels"] == "mit"
    assert got[21]["n_base"] == 0 and got[21]["labels"] == "" and got[21]["first_word"] is None
    assert got[4]["n_words"] == got[5]["n_words"] == 0 and got[4]["labels"] == ""
    assert scan_licenses(documents(spark, rows)).count() == len(rows)
    assert scan_licenses(empty(spark)).count() == 0


def test_license_base_against_brute_force(spark):
    phrases = {"mit": "under the mit license".split(), "apache-2": "apache license version 2".split(), "cc-by-nc": "cc by nc".split()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = as_dict(scan_licenses(docs))
    for r in docs.collect():
        words = ALNUM_RE.findall((r.text or "").translate(LOWER))
        places = [(i, k) for k, p in phrases.items() for i in range(len(words)) if words[i : i + len(p)] == p]
        g = got[r.doc_id]
        assert (g["n_words"], g["n_base"]) == (len(words), len(places))
        assert g["base_labels"] == ",".join(sorted({k for _, k in places})) and set(filter(None, g["base_labels"].split(","))) <= set(filter(None, g["labels"].split(",")))
        if places:
            assert (g["first_word"], g["last_word"]) == (min(places)[0], max(places)[0])


# --- tokens --------------------------------------------------------------------

SOURCES = {k: read_vocabulary(public_tokenizers.path(f)) for k, f in ((WordCounts, "word_bpe_49k.json"), (ByteIds, "byte_bpe_50k.json"))}
LOADED = {k: (k(s), Tokenizer.from_str(s)) for k, s in SOURCES.items()}


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(list("abcdEé'sSrv12³½.,!?<|>endoftxt \n\tİ日\x1f\x85\xa0\xad́")), max_size=80))
def test_encodings_equal_the_library(value):
    words, lib = LOADED[WordCounts]
    assert words.count(value) == len(lib.encode(value, add_special_tokens=False).ids)
    ids, lib = LOADED[ByteIds]
    assert np.concatenate(list(ids.ids(value))).tolist() == lib.encode(value, add_special_tokens=False).ids


@pytest.mark.parametrize("chunk,overlap", [(300, 5), (500, 40), (2000, 200)])
def test_splicing_is_exact(chunk, overlap):
    value = "intro " + "y" * 900 + " Sentence one, it's fine.\nNext   line 12 " * 60 + " " * 700 + "z" * 800 + " The end <|endoftext|> here. " * 30
    for kind, (mine, lib) in LOADED.items():
        want = lib.encode(value, add_special_tokens=False).ids
        assert np.concatenate(list(splice(value, mine.encode, chunk, overlap))).tolist() == want
    mine, lib = LOADED[ByteIds]
    value = value.replace("<|endoftext|>", "")
    assert np.concatenate(list(splice(value, mine._quick, chunk, overlap))).tolist() == lib.encode(value, add_special_tokens=False).ids


def test_token_counts(spark):
    got = as_dict(count_tokens(documents(spark), public_tokenizers.path("word_bpe_49k.json")))
    lib = LOADED[WordCounts][1]
    for i, t in ROWS:
        if i is not None:
            n = len(lib.encode(t or "", add_special_tokens=False).ids)
            assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 2048)
    assert count_tokens(empty(spark), public_tokenizers.path("word_bpe_49k.json")).count() == 0


# --- media -----------------------------------------------------------------------


def test_media(spark):
    df = store_media(documents(spark), keep_media=True)
    got = as_dict(df)
    for i, t in ROWS:
        if i is None:
            continue
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        g = got[i]
        assert (g["n_bytes"], g["payload_bytes"]) == (len(raw), len(payload)) and g["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert g["tail_crc32"] == zlib.crc32(payload[-64:]) and from_wav(bytes(g["media"])) == payload
        assert g["media_bytes"] == len(g["media"]) and g["media_sha256"] == hashlib.sha256(bytes(g["media"])).hexdigest()
        assert g["feature"].startswith("audio/wav;corrected=1")
    assert {k: v for k, v in got[1].items() if k != "doc_id"} == {k: v for k, v in got[2].items() if k != "doc_id"}
    assert store_media(empty(spark)).count() == 0 and df.count() == len(ROWS)


def test_sniffing_confirms_structure():
    import gzip
    import io
    import struct
    import zipfile

    png = b"\x89PNG\r\n\x1a\n" + b"".join(
        struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
        for n, d in ((b"IHDR", b"\0\0\0\1\0\0\0\1\x08\0\0\0\0"), (b"IDAT", zlib.compress(b"\0\0")), (b"IEND", b"")))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a.json", "{}")
    s = Sniffer()
    inside = to_wav(b"....." + png + gzip.compress(b"hello") + packed.getvalue())
    kind, corrected, spans = sniff(inside, "image/png", s)
    assert (kind, corrected) == ("audio/wav", True) and [x.kind for x in spans] == ["png", "gzip", "zip"]
    assert inside[spans[0].start : spans[0].end] == png
    assert sniff(png, "image/png", s)[:2] == ("image/png", False)
    broken = bytearray(png)
    broken[20] ^= 1
    assert sniff(bytes(broken), "text/plain", s) == ("text/plain", False, [])
    assert s.spans(b"RIFF GIF89a %PDF- BM PK\x03\x04 OggS fLaC \x1f\x8b\x08 \xff\xd8\xff") == []
    with pytest.raises(ValueError):
        from_wav(inside[:-1])


def _samples():
    """One small valid container of each format."""
    import gzip
    import io
    import struct
    import zipfile

    png = b"\x89PNG\r\n\x1a\n" + b"".join(
        struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
        for n, d in ((b"IHDR", b"\0\0\0\1\0\0\0\1\x08\0\0\0\0"), (b"IDAT", zlib.compress(b"\0\0")), (b"IEND", b"")))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a.json", "{}")
        z.writestr("b.json", "[]")
    page = lambda flags, n, body: b"OggS\0" + bytes([flags]) + struct.pack("<qIII", 0, 1, n, 0) + bytes([1, len(body)]) + body
    return {
        "wav": to_wav(b"\x80" * 64), "png": png,
        "gif": b"GIF89a\1\0\1\0\x80\0\0\0\0\0\xff\xff\xff!\xf9\4\0\0\0\0\0,\0\0\0\0\1\0\1\0\0\2\2D\1\0;",
        "jpeg": b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\3\1\x12\x34\xff\0\x11\xff\xd9",
        "bmp": b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\1\2\3\0",
        "pdf": b"%PDF-1.4\n1 0 obj\nstartxref\n0\n%%EOF", "zip": packed.getvalue(),
        "ogg": page(2, 0, b"abc") + page(0, 1, b"defg") + page(4, 2, b"hi"),
        "gzip": gzip.compress(b"hello, hello, hello"), "flac": b"fLaC\0\0\0\x22" + b"\0" * 34 + b"\x84\0\0\2ab" + b"frames",
    }


def test_every_format_is_found_and_carved():
    from surveyq.llm.media import TYPES

    s = Sniffer()
    for kind, data in _samples().items():
        assert sniff(data, "text/plain", s) == (TYPES[kind], True, []) and sniff(data, TYPES[kind], s)[1] is False
        if kind != "flac":  # its frames have no end of their own
            got = s.spans(b"junk." + data + b".junk")
            assert [(x.kind, x.start, x.end) for x in got] == [(kind, 5, 5 + len(data))]
        cut = [x for x in s.spans(data[:-4]) if x.start == 0 and kind not in ("ogg", "flac")]
        assert not cut, kind
    several = b"".join(b"--" + _samples()[k] for k in ("png", "ogg", "pdf", "gzip", "ogg"))
    assert [x.kind for x in s.spans(several)] == ["png", "ogg", "pdf", "gzip", "ogg"]


def test_sniffing_a_column(spark):
    import pyspark.sql.types as T

    from surveyq.llm.media import sniff_media

    samples = _samples()
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("blob", T.BinaryType()), T.StructField("said", T.StringType()), T.StructField("spans", T.StringType())])
    rows = [(1, samples["png"], "image/jpeg", "x"), (2, samples["png"], "image/png", "x"), (3, None, "audio/wav", "x"), (4, to_wav(b".." + samples["gif"]), None, "x"), (None, b"plain", None, "x")]
    df = spark.createDataFrame(rows, schema)
    got = {r.id: r for r in sniff_media(df, "id", "blob", "said", keep_carved=True).collect()}
    assert (got[1].media_type, got[1].corrected, got[2].corrected) == ("image/png", True, False)
    assert (got[3].media_type, got[3].corrected, got[3].spans) == ("audio/wav", False, [])
    assert got[4].media_type == "audio/wav" and [bytes(x) for x in got[4].carved] == [samples["gif"]] and got[4].spans[0].kind == "gif"
    assert got[None].media_type is None and sniff_media(df.limit(0), "id", "blob").count() == 0
    told = store_media(spark.createDataFrame([(1, "a", "audio/wav"), (2, "a", None)], "doc_id long, text string, kind string"), declared_col="kind").collect()
    assert {r.doc_id: r.feature.split(";")[1] for r in told} == {1: "corrected=0", 2: "corrected=1"}


def test_many_signatures_cost_one_pass():
    import time

    s, n = Sniffer(), 1 << 20
    page = b"OggS\0%c" + b"\0" * 20 + b"\1\xc8" + b"x" * 200
    parts = (b"%PDF-", page % 2, page % 0, b"GIF89a", b"GIF89a\0\0\0\0\0\0\0!", b"PK\3\4", b"RIFF\x10\0\0\0WAVE", b"BM", b"\xff\xd8\xff\xda\0\2", b"fLaC\0\0\0\x22", b"\x1f\x8b\x08")
    for part in parts:
        for data in (part * (n // len(part)), part * (n // len(part)) + b"startxref%%EOF"):
            begun = time.process_time()
            assert len(s.spans(data)) <= 1
            assert time.process_time() - begun < 20, part


# --- pages -----------------------------------------------------------------------


def test_surge_and_dive():
    assert between([0, 5, 90, 10, 0, 0, 0, 7, 0], 3, 80) == [False, True, True, True, False, False, False, False, False]
    assert between([0, 0, 0]) == [False] * 3 and between([]) == [] and between([200]) == [True]


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="menu-open">
      <header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></ul></nav><!-- c --><div class="cookie-notice">We use cookies on this site, and you should agree to it now.</div>
      <article><header><h1>The &amp; Title</h1></header><p><b>First   line
      of text<br><p>Tom &lt;3 &eacute;&#233;</p><aside>See also</aside><div class="ad">Buy!</div><ul><li>one<li>two</ul>
      <form><input><button>Go</button></form><section id="comments"><p>Nice post!</p></section></article><footer>&copy; me</footer></body></html>"""
    assert main_text(page) == "The & Title\nFirst line of text\nTom <3 éé\none\ntwo"
    plain = "<body><div id=nav><a>Home</a></div><div><h2>Head</h2>" + "<p>A paragraph that is long enough to make text surge here, is it not so?</p>" * 2 + "</div><div class='comments'><p>" + "reader says " * 20 + "</p></div></body>"
    assert main_text(plain).split("\n") == ["Head"] + ["A paragraph that is long enough to make text surge here, is it not so?"] * 2
    marked = """<body class="content"><div class="content overflow-hidden"><nav>Menu</nav><h1>Short</h1><p>Text.</p><div hidden>no</div><p style="display: none">no</p></div>
      <article class="comment"><p>I am a reader.</p></article></body>"""
    assert main_text(marked) == "Short\nText."
    assert main_text("<div role=main><p>a</p></div><p>" + "b" * 200) == "a"
    assert main_text("<div id=content><p>outer</p><article><p>inner</p></article></div>") == "inner"
    for junk in ("", "<", "<p", "a < b", "<article>", "</p></article>", "<a href='x", "&amp", "<!--"):
        assert isinstance(main_text(junk), str)


def test_extract_pages(spark):
    rows = [(1, "u", "<article><p>Hello  there</p></article>"), (2, None, None), (None, "u", ""), (1, "u", "<article><p>Hello  there</p></article>")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = extract_main_text(pages).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, "Hello there", 11), (1, "Hello there", 11), (2, "", 0)]
    assert extract_main_text(pages.limit(0)).count() == 0


def test_pages_against_their_markup(spark):
    import html

    got = {r.page_id: r.text for r in extract_main_text(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1].replace("<b>", "")
        want = [" ".join(html.unescape(x).split()) for x in re.split(r"<(?:/?p|/?h1|br)>", body)]
        assert got[r.page_id] == "\n".join(x for x in want if x)


@pytest.mark.parametrize("tag", ["article", "div"])
def test_distribution_finds_the_text(tag):
    """With and without a marked article, and not without the distribution."""
    import pyarrow.parquet as pq

    from surveyq.llm.html_text import lines_of

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    for page in pages:
        want = main_text(page or "")
        other = re.sub(r"<(/?)(article|nav|footer)\b", rf"<\1{tag}", page or "") if tag == "div" else page or ""
        assert main_text(other) == want
        assert "\n".join(x.text for x in lines_of(other) if x.text) != want


def test_parts_of_articles_stay():
    body = "<article><h1>T</h1><p class='side'>One</p><div class='legal'>Two</div><math>x</math><noscript>Three</noscript><p>End</p></article>"
    assert main_text(body) == "T\nOne\nTwo\nx\nThree\nEnd"
    assert main_text("<article><h1>T</h1><nav>menu<p>First.</p><p>Second.</p></article>") == "T\nFirst.\nSecond."
    assert main_text("<article><h1>T</h1><nav>menu</nav><p>First.</p></article><nav>more<p>x</p>") == "T\nFirst."
    links = "<ul>" + "<li><a href='/x'>A link that is quite long</a></li>" * 6 + "</ul>"
    assert main_text(f"<article><p>Text.</p>{links}<p>More.</p></article>") == "Text.\nMore."
    assert main_text("<p>Short page.</p><footer>Imprint</footer>") == "Short page."
    assert main_text("<article><p>a</p><div class=comments><p>Nice!</p></div><select><option>1</select><p>b</p></article>") == "a\nb"


def test_pages_are_read_in_one_pass():
    import time

    pages = [
        "<div>" * 20_000 + "</p>" * 20_000, "<b" * 500_000 + '"', "<p>x" * 200_000, "<div><table>" + "<b>" * 90_000 + "</div>" * 90_000,
        "<b ='>" * 150_000 + "<a href=\"", "<select>" * 120_000, "<nav>" * 150_000, "<!--" * 250_000, "<a href='" * 110_000, "<![CDATA[" * 110_000,
    ]
    for page in pages:
        begun = time.process_time()
        main_text(page)
        assert time.process_time() - begun < 20, page[:20]


def test_only_known_files_are_spliced():
    import json

    for kind, source in SOURCES.items():
        assert LOADED[kind][0].fast
        parts = json.loads(source)
        parts["pre_tokenizer"] = {"type": "Whitespace"}
        other = kind(json.dumps(parts))
        lib = Tokenizer.from_str(json.dumps(parts))
        text = "It's a long text, 12 times. " * 3000
        assert not other.fast and sum(len(x) for x in other.ids(text)) == len(lib.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("chunk,overlap", [(300, 5), (500, 40), (2000, 200)])
def test_spliced_words_have_the_texts_tokens(chunk, overlap):
    value = "intro " + "y" * 900 + " Sentence one, it's fine.\nNext   line 12 " * 60 + " " * 700 + "zé" * 400 + " The end, they'll say. " * 30
    mine, lib = LOADED[WordCounts]
    want = len(lib.encode(value, add_special_tokens=False).ids)
    assert mine.plain(value) and sum(int(x.sum()) for x in splice(value, mine.words_with_counts, chunk, overlap)) == want
    assert mine.count(value * 20) == len(lib.encode(value * 20, add_special_tokens=False).ids) and len(value * 20) > mine.chunk


def test_counts_of_the_corpus_equal_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lib = LOADED[WordCounts][1]
    got = {r.doc_id: r.n_tokens for r in count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).collect()}
    rows = docs.select("doc_id", "text").collect()
    want = [len(e.ids) for e in lib.encode_batch_fast([r.text or "" for r in rows], add_special_tokens=False)]
    assert [got[r.doc_id] for r in rows] == want
    assert sum(len(r.text or "") > WordCounts.chunk for r in rows) >= 5
