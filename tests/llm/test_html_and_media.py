import hashlib
import io
import struct
import zipfile
import zlib

import pytest

from candlewick.llm import html_extraction as he
from candlewick.llm import media

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">A</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy this now and here for a very long time indeed, dear reader of pages.</div>
<article><h1>Title &amp; more</h1><p><b>First
  line<br>goes on.<p>Caf&eacute; &lt;b&gt; &copy;</p><aside>Side</aside><div class="share-buttons">Share</div><ul><li>item</li></ul><form><p>mail</p></form></article>
<section id="comments"><p>A comment that is rather long and would be text by its length alone, were it not one.</p></section><footer>&copy; x</footer>"""


def test_article():
    assert he.extract(PAGE) == "Title & more\n\nFirst line goes on.\n\nCafé <b> ©\n\nitem"


def test_pages_without_an_article():
    text = "This sentence is long enough to count as text when it stands in a line of its own, and it does."
    page = f"<div class=menu><a href=x>Home</a></div><div><p>{text}<p>Short.<p>{text}</div><div class='cookie-notice'>We use cookies</div>"
    assert he.extract(page) == f"{text}\n\nShort.\n\n{text}"
    assert he.extract("plain words") == "plain words"


@pytest.mark.parametrize("page", [None, "", "   ", "<nav>x</nav>", "<script>1", "<p", "<!-- x", "<div class='", "<" * 2000, "<p>" * 5000])
def test_odd_pages(page):
    assert isinstance(he.extract(page), str)


def test_page_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 5), (2, None, None, 6), (1, "u", PAGE, 5)], "page_id long, url string, html string, text int")
    rows = he.extract_pages(pages).collect()
    assert len(rows) == 3 and sorted(len(r.text) for r in rows)[0] == 0
    assert he.extract_pages(pages.limit(0)).count() == 0


def png():
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def archive():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\0;"
GOOD = {"image/png": png(), "audio/wav": media.wav(b"abc"), "application/zip": archive(), "image/gif": GIF, "application/gzip": zlib.compress(b"x" * 99, wbits=31)}


@pytest.mark.parametrize("kind", GOOD)
def test_sniffing_and_carving(kind):
    magic, data = media.automaton(), GOOD[kind]
    assert media.sniff(data, magic) == [(kind, 0, len(data))]
    assert media.sniff(b"junk BM GIF8" + data + b" tail", magic) == [(kind, 12, len(data))]
    broken = data[:-1]
    assert media.sniff(broken, magic) == []


def test_inspect_and_carve(spark):
    values = [(1, b"xx" + GOOD["image/png"] + GOOD["audio/wav"], "text/plain", 0), (2, GOOD["audio/wav"], "image/png", 0), (3, None, "a/b", 0), (4, b"", "a/b", 0)]
    df = media.inspect(spark.createDataFrame(values, "id int, media binary, declared string, offset int"))
    rows = {r.id: r for r in df.collect()}
    assert (rows[1].media_type, rows[1].valid, len(rows[1].objects)) == ("text/plain", False, 2)
    assert (rows[2].media_type, rows[2].valid) == ("audio/wav", True)
    assert (rows[3].media_type, rows[4].media_type, rows[4].valid) == (None, "a/b", False)
    assert sorted(bytes(r.object) for r in media.carve(df.filter("id = 1")).collect()) == sorted([GOOD["image/png"], GOOD["audio/wav"]])


def test_texts_as_samples(make_docs, odd_texts):
    texts = [*odd_texts, "BM" + "GIF89a" * 40, "RIFF WAVEfmt data" * 9]
    rows = {r.doc_id: r for r in media.read_samples(media.inspect(media.store_text(make_docs(texts)))).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-16:]))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(media.wav(payload)).hexdigest()


LONG = "This sentence is long enough to count as text when it stands in a line of its own, and it does."
BODY = "".join(f"<p>{LONG} {i}</p>" for i in range(6))
WANT = "\n\n".join(f"{LONG} {i}" for i in range(6))


@pytest.mark.parametrize(
    "before, after",
    [
        ('<article class="post type-post hentry tag-news">', "</article>"),
        ('<div class="layout no-sidebar">', "</div>"),
        ('<div class="widget"><div class="side">', "</div></div>"),
        ('<article class="review">', "</article>"),
        ('<div id="comments-off" role="article" class="has-related">', "</div>"),
    ],
)
def test_names_do_not_lose_the_article(before, after):
    page = f'<body><nav><a href=x>Home</a></nav>{before}{BODY}{after}<div class="share-buttons">Share</div><div class="cookie-notice">We use cookies</div><footer>&copy; x</footer></body>'
    assert he.extract(page) == WANT


def test_text_called_by_a_name_of_its_own_is_all_of_a_page():
    assert he.extract("".join(f'<div class="widget"><p>{LONG} {i}</p></div>' for i in range(6))) == WANT


@pytest.mark.parametrize("gap", ["", "<p></p>" * 9])
def test_marked_teasers_do_not_displace_the_body(gap):
    teasers = "".join(f"<article><h3>Teaser {i}</h3><p>Read this too.</p></article>" for i in range(4))
    assert he.extract(f"<div>{BODY}</div>{gap}<div class='cards'>{teasers}</div>") == WANT
    assert he.extract(f"<div class='cards'>{teasers}</div>{gap}<div>{BODY}</div>") == WANT
    assert he.extract(f"<div><p>{LONG}</p></div>{gap}<article>{BODY}</article>") == WANT


def test_a_very_long_page():
    from candlewick.llm.html_extraction import extract

    page = "<body><article>" + "".join(f"<p>paragraph number {i} of a long page</p>" for i in range(20000)) + "</article></body>"
    assert extract(page).count("\n\n") == 19999


@pytest.mark.parametrize(("page", "text"), [("<article><p>Yes.</p></article>", "Yes."), ("<nav><a href=x>Home</a></nav><main><p>No</p></main><footer>All rights reserved by us</footer>", "No"), ("<p>ok</p>", "ok")])
def test_short_pages_are_kept_whole(page, text):
    assert he.extract(page) == text
