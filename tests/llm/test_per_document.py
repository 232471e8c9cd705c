"""Operators that take one document at a time, against the libraries, brute force and round trips."""

import hashlib
import os
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest_llm import prose
from pyarrow import fs
from tokenizers import Tokenizer

from phonoweave.llm import byte_bpe, html_text, quality, token_files, wordpiece
from phonoweave.llm.common import fresh_path

WORD = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
FUZZ = "ab 'stmdrevl\n\t 　é1२!?中\U00020000'  \x1c\x85́"


def fuzz(seed, n=300):
    r = random.Random(seed)
    return ["".join(r.choice(FUZZ) for _ in range(r.randrange(50))) for _ in range(n)]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def test_bpe_equals_the_library(reference):
    texts = [*fuzz(1), "y" * 3000, " " * 99, "ab" * 80 + "'ll" * 9, "", prose(3, 500)]
    got = byte_bpe.coder(RANKS).encode(texts)
    for text, (pieces, offsets) in zip(texts, got):
        ids = [i for p in pieces for i in p]
        assert ids == reference.encode_ordinary(text)
        assert byte_bpe.coder(RANKS).decode(ids) == text.encode()
        assert offsets[0 if len(offsets) > 1 else -1] in (0, len(text)) and offsets[-1] == len(text)


def test_bpe_query(spark, make, awkward, reference):
    rows = byte_bpe.round_trip(make(awkward), RANKS, keep_ids=True).collect()
    want = sorted((d is not None, d or 0, len(reference.encode_ordinary(t or ""))) for d, t in awkward)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in rows) == want
    by = {r.doc_id: r for r in rows}
    ids = reference.encode_ordinary(awkward[7][1])
    assert by[7].ids == ids and by[7].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert by[7].decoded_sha256 == hashlib.sha256(awkward[7][1].encode()).hexdigest()
    assert byte_bpe.round_trip(make([]), RANKS).count() == 0


def test_token_files(spark, make, awkward):
    rows = token_files.token_files(make(awkward), WORD).collect()
    library = Tokenizer.from_file(WORD)
    ordered = sorted(awkward, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for doc_id, text in ordered:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want
    assert token_files.token_files(make([]), WORD).count() == 0


def test_strings_of_added_tokens(make):
    got = token_files.token_files(make([(1, "hello <|endoftext|> world")]), WORD).collect()
    ids = [*Tokenizer.from_file(WORD).encode("hello <|endoftext|> world", add_special_tokens=False).ids, 2]
    assert 49407 in ids and [(r.n_tokens, r.ids_crc32) for r in got] == [(4, zlib.crc32(np.array(ids, "<u4").tobytes()))]


def test_word_encoder_equals_the_library():
    library = Tokenizer.from_file(WORD)
    texts = [*fuzz(2), "<|endoftext|> a", "hello <|endoftext|> world<|startoftext|><|endoftext|>x <|ENDOFTEXT|>", "a\x1cb <|endoftext|>c\x1d", "Éa ÀÞß×÷ÿ é\u0301 \xa0b\x85c ½²x Ãı", "don't 'tis --'s x'll'd a1b22!?", "\udcff".encode("utf-8", "replace").decode(), "İstanbul ΑΣ ΣΑΣ.", prose(5, 200)]
    for text, ids in zip(texts, token_files.WordEncoder(WORD, most=50).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_reader_fetches_one_document_and_sees_damage(spark, make, tmp_path):
    texts = [(k, prose(k, 4000)) for k in range(60)]
    folder = f"file://{tmp_path}"
    manifest = token_files.write_token_files(make(texts).coalesce(1), folder, WORD, 2)
    place, root = fs.FileSystem.from_uri(folder)
    library = Tokenizer.from_file(WORD)
    found = 0
    for name, _, _ in manifest:
        with place.open_input_file(f"{root}/{name}") as stream:
            reader = token_files.FrameReader(stream, stream.size())
            read = []
            whole = reader.frame
            reader.frame = lambda k: read.append(k) or whole(k)
            for ids in reader.get(17):
                found += 1
                assert ids.tolist() == [*library.encode(texts[17][1], add_special_tokens=False).ids, 2]
                assert len(read) == 1
    assert found == 1
    path = tmp_path / manifest[0][0]
    raw = bytearray(path.read_bytes())
    raw[40] ^= 255
    path.write_bytes(raw)
    with place.open_input_file(str(path)) as stream, pytest.raises(Exception):
        token_files.FrameReader(stream, stream.size()).frame(0)


def test_wordpiece_counts_equal_greedy_matching():
    r = random.Random(3)
    for trial in range(60):
        first = {"".join(r.choice("ab") for _ in range(r.randrange(1, 5))).encode() for _ in range(6)}
        inner = first if trial % 2 else {"".join(r.choice("ab") for _ in range(r.randrange(1, 5))).encode() for _ in range(6)}
        automaton = wordpiece.LongestMatch(first, None if trial % 2 else inner)
        for _ in range(40):
            word = "".join(r.choice("ab") for _ in range(r.randrange(1, 12))).encode()
            at, n = 0, 0
            while at < len(word):
                known = first if at == 0 else inner
                size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in known), 0)
                if not size:
                    n = -1
                    break
                at, n = at + size, n + 1
            assert automaton.count(word) == n


def test_wordpiece_query(spark, make, awkward):
    rows = {r.doc_id: r for r in wordpiece.wordpiece_counts(make(awkward), WORD).collect()}
    known = wordpiece.byte_vocabulary(WORD)
    total = 0
    for word in awkward[7][1].lower().split():
        for piece in wordpiece.WordCounter.WORD.findall(word):
            raw = piece.encode()
            while raw:
                size = next(k for k in range(len(raw), 0, -1) if raw[:k] in known)
                raw, total = raw[size:], total + 1
    assert rows[7].n_tokens == total and rows[7].n_unknown == 0
    assert rows[1].n_tokens == rows[2].n_tokens == rows[3].n_tokens == 0
    assert wordpiece.wordpiece_counts(make([]), WORD).count() == 0


def test_quality(spark, make, awkward):
    good = [(k, prose(k, 80)) for k in range(200)]
    bad = [(1000 + k, " ".join(w + "$$$" for w in prose(k, 80).split())) for k in range(60)] + [(2000 + k, f"{WORD_[k % 5]} " * 50) for k in range(60)]
    labels = spark.createDataFrame([(d, 1, 0) for d, _ in good] + [(d, 0, 0) for d, _ in bad] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.fit_and_score(make([*good, *bad, *[(9000 + k, t) for k, (_, t) in enumerate(awkward)]]), labels).collect()
    held = [r for r in rows if r.held_out and r.doc_id < 9000]
    assert held and all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in rows)
    assert sum(r.predicted == (r.doc_id < 1000) for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    none = quality.fit_and_score(make([(1, "a b")]), labels.limit(0)).collect()
    assert none[0].score == 0.5
    kept = quality.accepted(make([*good, *bad]), labels)
    assert kept.columns == make([]).columns and kept.count() >= 190


WORD_ = ["Hm", "Zebra", "And", "quiet", "Ö"]

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></nav>
<div class="ad">Buy now, it is very cheap today and only here</div><article><h1>Title &amp; more</h1><p>First   para<br>graph.</p><p>Short.<p>Third <b>bold</b> &eacute;<script>var a="</p>"</script>
<div class="sidebar">aside text</div><form><input><label>Name</label></form><p>Last &lt;one&gt;</p></article><div id="comments"><p>I disagree with all of this, at length.</p></div><footer>&copy; me</footer>"""


def test_html():
    assert html_text.main_text(PAGE) == "Title & more\n\nFirst para graph.\n\nShort.\n\nThird bold é\n\nLast <one>"
    plain = "<body><ul>" + "<li><a href=x>Link</a>" * 9 + "</ul><div>" + "".join(f"<p>{prose(k, 30)}" for k in range(5)) + "</div><ul>" + "<li><a>More links</a>" * 9 + "</ul></body>"
    assert html_text.main_text(plain) == "\n\n".join(prose(k, 30) for k in range(5))
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>a</nav>") == ""
    assert html_text.main_text("just text") == "just text"
    assert html_text.main_text("<article><p>cut off in a ta") == "cut off in a ta"
    assert html_text.main_text("<article><p>Energy is <math><mi>E</mi></math> here</p></article>") == "Energy is E here"
    began = time.time()
    assert html_text.main_text("<article><p>" + "<span>" * 20_000 + "deep" + "</div>" * 20_000 + "</p></article>") == "deep" and time.time() - began < 5


def test_html_keeps_an_article_that_adverts_and_links_interrupt():
    a, b, c = (prose(k, n) for k, n in ((1, 100), (2, 90), (3, 5)))
    advert = '<div class="ad"><p>a</p><p>b</p><div><p>c</p></div></div><nav><ul><li>d<li>e</ul></nav><aside><p>f</p><p>g</p></aside>'
    for page in (f"<div><p>{a}</p>{advert}<p>{b}</p>{advert * 3}<p>{c}</p></div>", f"<p>{a}{advert}<p>{b}{advert * 3}<p>{c}", f"<div><div>{a}{advert * 5}</div><div>{b}</div>{advert * 5}<div>{c}</div></div>"):
        assert html_text.main_text(f"<body><nav>Home</nav>{page}<footer>&copy;</footer></body>") == f"{a}\n\n{b}\n\n{c}"
    related = '<ul><li><a href="/x">Related page</a></ul>'
    source = '<p><a href="/x">A long title of the source</a> here</p>'
    page = f"<body><div><p>{a}</p>{source * 6}<p>{b}</p>{source}</div>{related * 5}<div>Some words of the site</div></body>"
    assert html_text.main_text(page) == "\n\n".join([a, *["A long title of the source here"] * 6, b, "A long title of the source here"])
    assert html_text.main_text(f"<div><p>{a}{related * 5}<p>{b}</div>{related * 5}<div>Some words</div>") == f"{a}\n\n{b}"


def test_html_cues_strip_no_wrapper():
    a, b = prose(1, 100), prose(2, 30)
    teaser = f'<div class="related"><article><p>{b}</p></article></div>'
    for names in ('class="content has-sidebar"', 'id="page" class="no-sidebar"', 'class="search-result-page"', 'class="search"', "class=sidebar role=search"):
        assert html_text.main_text(f"<body><div {names}><article><p>{a}</p></article>{teaser}</div></body>") == a
        assert html_text.main_text(f"<body><div {names.replace(' role=search', '')}><p>{a}</p><div class=ad>{b}</div></div><footer>&copy;</footer>") == a
    assert html_text.main_text(f'<p>So <span class="comment">it</span> <code class="search">goes</code> on</p><div class="site-header">x</div>') == "So it goes on"
    assert html_text.main_text(f'<div><p>{b}</p><div id="comments"><p>{a}</p><p>{a}</p></div></div>') == b
    for name in ("ad-container", "cookie_notice", "comment-list", "sidebar left"):
        assert html_text.main_text(f'<article><p>{a}</p><div class="{name}"><p>{b}</p></div></article>') == a


def test_html_articles_with_cues():
    a, b = prose(1, 40), prose(2, 60)
    for comment in (f'<article class="comment"><p>{b}</p></article>', f'<article class="related"><p>{b[:99]}</p></article>'):
        assert html_text.main_text(f"<article><p>{a}</p>{comment}</article>{comment}") == a
    assert html_text.main_text(f'<article class="comment"><p>{b}</p></article>') == b


def test_html_without_hints_follows_the_distribution(monkeypatch):
    a, b, c = prose(1, 60), prose(2, 55), prose(3, 12)
    assert html_text.main_text(f"<div>Home News Shop</div><div><p>{a}</p><p>{b}</p></div><div>Copyright by us</div>") == f"{a}\n\n{b}"
    talk = f"<div><p>{c}</p></div>"
    assert html_text.main_text(f"<div><p>{a}</p><p>{b}</p></div>{'<div></div>' * 6}{talk}") == f"{a}\n\n{b}"
    assert html_text.main_text(f"<div><p>{a}</p><p>{b}</p></div>{'<div></div>' * 6}<div><p>{b}</p></div>") == f"{a}\n\n{b}\n\n{b}"
    assert html_text.main_text(f"<h1>Big title</h1><div><p>{a}</p><p>{b}</p></div>") == f"Big title\n\n{a}\n\n{b}"
    # Without the distribution's threshold, the menu and the talk come back.
    monkeypatch.setattr(html_text, "SURGE", 10**9)
    assert c in html_text.main_text(f"<div><p>{a}</p><p>{b}</p></div>{'<div></div>' * 6}{talk}")
    monkeypatch.undo()
    # An article element weighs; a far longer text beside it still wins.
    assert html_text.main_text(f"<article><p>{a}</p></article><div><p>{c}</p></div>") == a
    long = " ".join(prose(k, 60) for k in range(200))
    assert html_text.main_text(f"<div><p>{long}</p></div><article><p>Hi.</p></article>").startswith(long)


def test_html_stretches_against_brute_force():
    r = random.Random(8)
    for _ in range(300):
        w = [r.choice([0, 0, 0, 5, 40]) for _ in range(r.randrange(30))]
        alive = [any(w[k : k + html_text.WINDOW]) for k in range(len(w))]
        want, heavy = [], [k for k in range(len(w)) if w[k]]
        for k in heavy:
            if want and all(alive[want[-1][-1] : k]):
                want[-1].append(k)
            else:
                want.append([k])
        assert [(a, b) for _, a, b in html_text.stretches(w)] == [(g[0], g[-1] + 1) for g in want]
        assert [h for h, _, _ in html_text.stretches(w)] == [max(sum(w[k : k + html_text.WINDOW]) for k in range(g[0], g[-1] + 1)) for g in want]


def test_html_attributes_quotes_and_sections():
    a = prose(1, 30)
    for attributes in ('style="overflow:hidden"', 'title="the hidden gem"', 'data-id="comment-1"', "data-role=navigation"):
        assert html_text.main_text(f"<div><p {attributes}>{a}</p><p>{a}</p></div>") == f"{a}\n\n{a}"
    assert html_text.main_text(f"<div><p hidden>{a} no</p><p>{a}</p></div>") == a
    assert html_text.main_text(f"<article><header><h1>Headline</h1></header><p>{a}</p></article>") == f"Headline\n\n{a}"
    assert html_text.main_text('<div><p title="abc>Hello') == "Hello" and html_text.main_text('<p title="a>b">Hello</p>') == "Hello"
    assert html_text.main_text("<p>one <![CDATA[two three") == "one two three" and html_text.main_text("<p>one <![CDATA[two]]> three") == "one two three"


def test_html_query(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "v", ""), (None, "w", "<p>é")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' AS text", "1 AS n_chars")
    got = html_text.extract_text(pages).collect()
    assert len(got) == 5 and {r.page_id: r.n_chars for r in got}[2] == 0
    assert all(r.n_chars == len(r.text) for r in got) and html_text.extract_text(pages.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_quality_of_held_out_rows(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.fit_and_score(documents, labels).join(labels.select("doc_id", "quality"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in rows) / len(rows)
    pairs = [(a.score, b.score) for a in rows if a.quality == 1 for b in rows if b.quality == 0]
    assert len(rows) > 50 and right >= 0.97 and sum(a > b for a, b in pairs) / len(pairs) >= 0.98


def test_fresh_paths_differ(spark):
    assert fresh_path(spark, "a") != fresh_path(spark, "a")
