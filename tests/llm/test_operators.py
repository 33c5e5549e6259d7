"""The dealt operators against brute force, exact round trips and held-out accuracy, with
nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import io
import itertools
import math
import pathlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from compare import connect, same
from pyspark.sql import functions as F

from siltstone.llm import chat, decontam, html_extract, langid, media, mixing, ngram_join, sharding, substring, suffix
from siltstone.llm.common import components, materialize, ship
from siltstone.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 string, id int, t int, score string, shard int"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgéü") for _ in range(rng.randint(1, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    base, passage = prose(rng, 120), prose(rng, 70)
    texts = [base, base, None, "", " \n ", "one two", "One  TWO", "!!! 123", "x" * 300, "日本語の文章です。" * 40, prose(rng, 3000) + " " + passage + " " + prose(rng, 3000), passage]
    for _ in range(12):  # near copies
        words = base.split(" ")
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    for _ in range(12):
        texts.append(prose(rng, rng.randint(5, 60)) + " " + passage + " " + prose(rng, rng.randint(5, 60)))
    texts += [prose(rng, rng.randint(1, 90)) for _ in range(20)]
    rows = [(k, t, ["en", "fr", None][k % 3], ["s0", "s1", None, "s0"][k % 4], len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[0], rows[14], rows[30]]  # repeated rows
    rows += [(None, passage + " and more", None, None, 5), (-7, base, "en", "s1", 3)]
    return [(*r, "clash", 1, 2, "x", 9) for r in rows]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# ------------------------------------------------------------------------- op1

def gear_cuts(text):
    """The cuts of a text, byte by byte, as the module docstring says."""
    gear, cuts, last, n = substring.gear().tolist(), [], 0, len(text)
    hashes, h = [], 0
    for b in text:
        h = ((h << 1) + gear[b]) & 0xFFFF
        hashes.append(h)
    top = -substring.MIN_CHUNK
    for at in range(1, n):
        if hashes[at - 1] >> (16 - substring.MASK_BITS) == 0 and at >= 16 and at - top >= substring.MIN_CHUNK:
            cuts.append(at)
            top = at
    out = []
    for end in [*cuts, n]:
        while end - last > substring.MAX_CHUNK:
            places = range(last + substring.MIN_CHUNK, min(last + substring.MAX_CHUNK + 1, end - substring.MIN_CHUNK + 1))
            last = min(places, key=lambda p: (hashes[p - 1], p))
            out.append(last)
        if end < n:
            out.append(end)
        last = end
    return [0, *out] if n else []


def repeated_chunks(rows):
    """(doc_id, start, n_bytes) by the definition: a chunk is a repeat if a smaller id has
    it, or the same text earlier."""
    low = substring.NULL_ID
    rows = sorted({(low if r[0] is None else r[0], (r[1] or "").encode()) for r in rows})
    least, own, chunks = {}, {}, []
    for i, text in rows:
        edges = [*gear_cuts(text), len(text)]
        chunks.append([(text[a:b], a, b) for a, b in itertools.pairwise(edges)])
        for c, a, _ in chunks[-1]:
            least[c] = min(least.get(c, i), i)
            own.setdefault((i, text, c), a)
    want = collections.Counter()
    for (i, text), cs in zip(rows, chunks, strict=True):
        runs = []
        for c, a, b in cs:
            if least[c] < i or own[i, text, c] < a:
                if runs and runs[-1][1] == a:
                    runs[-1][1] = b
                else:
                    runs.append([a, b])
        want.update((None if i == low else i, a, b - a) for a, b in runs)
    return want


@pytest.fixture(scope="module")
def unclear(corpus):
    """Different texts without an id, or with one id, some of them with repeats."""
    rng = random.Random(91)
    p, q = prose(rng, 60), prose(rng, 40)
    texts = [(None, f"{p} a {p}"), (None, q), (None, f"{q} {prose(rng, 9)}"), (5000, f"{p} {q}"), (5000, f"{q} {q}"), (5000, prose(rng, 50)), (5001, q), (5000, f"{q} {q}"), (None, q)]
    texts += [(5100 + k, t) for k, t in enumerate(["=" * 900, "ab" * 300, "abc " * 200 + p, p + "-" * 300 + p, "\n".join([q[:30]] * 40), "x" * 99, "y" * 100, "z" * 101])]
    return [(i, t, None, None, 1, "c", 1, 2, "s", 0) for i, t in texts] + corpus[:30]


def test_substring_dedup(spark, docs, corpus, none, unclear):
    for df, rows in ((docs, corpus), (spark.createDataFrame(unclear, SCHEMA).repartition(3), unclear)):
        got = collections.Counter((r["doc_id"], r["start"], r["n_bytes"]) for r in substring.repeated_runs(df).collect())
        want = repeated_chunks(rows)
        assert got == want, (got - want, want - got)
    assert substring.repeated_runs(none).count() == 0
    kept = {r["doc_id"]: r for r in substring.remove_ranges(docs, substring.repeated_runs(docs)).collect()}
    assert kept[1]["kept_text"] == "" and kept[-7]["kept_text"] == kept[-7]["text"] and kept[2]["kept_text"] is None
    lone = spark.createDataFrame([(None, "same words, " * 60), (None, prose(random.Random(3), 90))], "doc_id long, text string")
    kept = {r["text"]: r["kept_text"] for r in substring.remove_ranges(lone, substring.repeated_runs(lone)).collect()}
    assert sorted(len(t) == len(k) for t, k in kept.items()) == [False, True]


def test_cuts_are_those_of_a_byte_by_byte_gear_hash():
    rng = random.Random(4)
    for _ in range(60):
        text = rng.choice([prose(rng, rng.randint(0, 300)), "ab" * rng.randint(0, 900), prose(rng, 3) * rng.randint(1, 80)]).encode()
        assert substring.chunk_edges(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0].tolist() == gear_cuts(text)


def test_short_repeats_are_reported(spark):
    rng = random.Random(21)
    short = ["By be in tothedouou and, oninly.", "x", "A line of some forty bytes, no more yet."]
    passages = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 4))) for _ in range(51)) for _ in range(60)]
    texts = [f"{prose(rng, 20)} {p} {prose(rng, 20)}" for p in passages]
    again = [f"{prose(rng, 25)} {p} {prose(rng, 15)}" for p in passages]
    rows = [*enumerate([*short, *texts]), *[(1000 + k, t) for k, t in enumerate([*short, *again])]]
    spans = collections.defaultdict(list)
    for r in substring.repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        spans[r["doc_id"]].append((r["start"], r["start"] + r["n_bytes"]))
    assert [spans[1000 + k] for k in range(3)] == [[(0, len(t))] for t in short] and not spans.keys() & {0, 1, 2}
    hit = 0
    for k, (p, t) in enumerate(zip(passages, again, strict=True)):
        at = t.encode().index(p.encode())
        hit += any(a < at + len(p) and b > at for a, b in spans[1003 + k])
    assert hit >= 55, hit


def test_chunks_resist_insertions():
    rng = random.Random(2)
    text = prose(rng, 900).encode()
    cut = lambda b: {b[x:y] for x, y in itertools.pairwise([*substring.chunk_edges(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0].tolist(), len(b)])}
    assert len(cut(text) - cut(text[:2000] + b"new words here " + text[2000:])) <= 3


def test_repetitive_passages_are_cut_by_content():
    rng = random.Random(8)
    def cut(b):
        edges = [*substring.chunk_edges(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0].tolist(), len(b)]
        sizes = np.diff(edges)
        assert sizes.max() <= substring.MAX_CHUNK and (sizes[:-1] >= substring.MIN_CHUNK).all()
        return list(itertools.pairwise(edges))
    lost = 0
    for _ in range(150):
        unit = prose(rng, rng.randint(1, 6)) + " "
        passage = (unit * 600)[: 700].encode()
        a, b = (prose(rng, rng.randint(20, 60)).encode() + passage + prose(rng, 30).encode() for _ in range(2))
        have = {a[x:y] for x, y in cut(a)}
        at = b.index(passage)
        lost += sum(y - x for x, y in cut(b) if b[x:y] in have and at <= x and y <= at + 700) < 300
    assert lost <= 1, lost


# ------------------------------------------------------------------------- op2

def test_html_held_out_pages_and_forms(spark, trees):
    rng = random.Random(77)
    wrong = total = 0
    for _ in range(60):
        page = html_extract.parse(html_extract.training_page(rng))
        x, _ = html_extract.features([page], trees.odds)
        chars = np.bincount(page.node, [len(t) for t in page.text], len(page.kind)) if page.node else np.zeros(len(page.kind))
        inside = html_extract.chosen(page, trees.logit(x))
        wrong += chars[inside != (np.array(page.label) == 1)].sum()
        total += chars.sum()
    assert wrong / total < 0.04
    long = "Words of the story, that go on. " * 30
    page = f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=/a>Home</a></ul></nav><div class='cookie-notice'>We use cookies</div><article><h1>A &amp; B</h1><p>{long}<p><b>Second</b>\n\t block<br>goes&nbsp;on<div class=ad>Buy now</div><ul><li>one<li>two</ul></article><section id=comments><p>nice post!</p></section><footer>&copy; x</footer><script>var a='<p>no</p>'</script></body></html>"
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "only text &lt;here"), (5, "u", "<p>a<b>c<p></i></table><div"), (1, "u", page)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_extract.extract(rows, trees).collect()}
    assert got[1]["text"] == "A & B\n" + " ".join(long.split()) + "\nSecond block goes on\none\ntwo"
    assert got[1]["n_chars"] == len(got[1]["text"]) and got[2]["text"] == "" and got[3]["text"] == "" and got[4]["text"] == "only text <here"
    assert html_extract.extract(rows.limit(0), trees).count() == 0


def foreign_page(rng):
    """(html, main text): pages of another make than those the trees are fitted on, with names
    that say nothing or are foreign, layout by tables, definition lists, nested sections."""
    syl = "ka to mi ren sol va der ich ung en la que do os pra vy sta lo ne pri hod".split()
    word = lambda: "".join(rng.choice(syl) for _ in range(rng.randint(1, 4)))

    def sent(n):
        return " ".join(word() for _ in range(n)).capitalize() + rng.choice([".", ".", ".", "!", "?"])

    def para(lo=1, hi=6):
        return " ".join(sent(rng.randint(4, 18)) for _ in range(rng.randint(lo, hi)))

    code = lambda: rng.choice("abcdefg") + "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(3, 6)))
    main, parts = [], []

    def keep(tag, text, attrs=""):
        main.append(text)
        parts.append(f"<{tag}{attrs}>{text}</{tag}>")

    style = rng.randrange(5)
    keep(rng.choice(["h1", "h2"]), sent(rng.randint(3, 8)).rstrip(".!?"))
    for _ in range(rng.randint(2, 12)):
        k = rng.random()
        if k < 0.72:
            keep("p", para()) if style != 1 else keep("div", para())
        elif k < 0.8:
            keep("h3", " ".join(word() for _ in range(rng.randint(1, 5))))
        elif k < 0.88:
            items = [sent(rng.randint(2, 12)) for _ in range(rng.randint(2, 6))]
            main.extend(items)
            parts.append("<ol>" + "".join(f"<li>{x}</li>" for x in items) + "</ol>")
        elif k < 0.94:
            pairs = [(word(), sent(rng.randint(3, 14))) for _ in range(rng.randint(2, 4))]
            main.extend(x for p in pairs for x in p)
            parts.append("<dl>" + "".join(f"<dt>{a}</dt><dd>{b}</dd>" for a, b in pairs) + "</dl>")
        else:
            keep("blockquote", para(1, 2))
    link = lambda: f'<a href="/{word()}">{" ".join(word() for _ in range(rng.randint(1, 4)))}</a>'
    names = {"n": ["menueleiste", "navegacao", code()], "w": ["werbung", "reklama", "pub", code()], "k": ["kommentare", "opinie", "comentarios", code()], "s": ["spalte2", "barra", code()], "f": ["fuss", "rodape", "stopka", code()]}
    nm = lambda k: rng.choice(names[k])
    nav = f'<div class="{nm("n")}">' + "".join(f"<span>{link()}</span>" if style % 2 else f"<div>{link()}</div>" for _ in range(rng.randint(4, 12))) + "</div>"
    ad = f'<div class="{nm("w")}">{sent(rng.randint(3, 8))} {link()}</div>'
    side = f'<div id="{nm("s")}"><b>{word()}</b><ul>' + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(3, 9))) + "</ul></div>"
    talk = f'<section class="{nm("k")}"><h4>{word()} ({rng.randint(2, 40)})</h4>' + "".join(f'<div class="u7"><i>{word()} {rng.randint(1, 28)}.{rng.randint(1, 12)}.2021</i><div>{sent(rng.randint(3, 20))}</div>{link()}</div>' for _ in range(rng.randint(2, 6))) + "</section>"
    foot = f'<div class="{nm("f")}">&copy; {rng.randint(1999, 2024)} {word()} | {link()} | {link()} | {link()}</div>'
    form = f'<div><label>{word()}</label><input type=text><input type=submit value="{word()}"></div>'
    body = "".join(parts)
    if style == 0:
        page = f'{nav}<div class={code()}><div class={code()}>{body}</div>{side}</div>{talk if rng.random() < .5 else ""}{foot}'
    elif style == 1:
        page = f'{nav}{ad}<div id={code()}>{body}</div>{form}{foot}'
    elif style == 2:
        page = f'<table><tr><td>{nav}</td><td>{body}</td><td>{side}</td></tr></table>{foot}'
    elif style == 3:
        page = f'{form}{nav}<section><section>{body}</section>{ad}</section><section>{talk}</section>{foot}'
    else:
        page = f'<div class={code()}>{nav}{side}</div><div class={code()}><div>{ad}</div>{body}</div>{foot}'
    return f"<!doctype html><html><head><title>{word()}</title></head><body>{page}</body></html>", "\n".join(main)


@pytest.fixture(scope="module")
def trees():
    return html_extract.trained()


def test_html_of_a_foreign_make(trees):
    rng = random.Random(1)
    pages = [foreign_page(rng) for _ in range(300)]
    hit = got = want = 0
    for (_, text), out in zip(pages, html_extract.main_texts([p for p, _ in pages], trees), strict=True):
        a, b = collections.Counter(out.split("\n")), collections.Counter(text.split("\n"))
        hit += sum(len(k) * v for k, v in (a & b).items())
        got += sum(len(k) * v for k, v in a.items())
        want += sum(len(k) * v for k, v in b.items())
    assert hit / want > 0.95 and hit / got > 0.95, (hit / want, hit / got)


def test_html_loses_no_article(trees):
    story = "Some article words here, long enough. " * 20
    cases = {
        f"<div class=a1><p>{story}</p></div><section class=kommentare><p>nice</p></section><div class=werbung>buy</div>": story.strip(),
        "<div>Hello</div><div>World</div>": "Hello\nWorld",
        "<p>Short one.</p>": "Short one.",
        "only text": "only text",
        "<p>Formula <math><mi>x</mi><mo>=</mo><mn>2</mn></math> here.</p>": "Formula x=2 here.",
        f"<article><p>{story}</p><xmp><b>&amp; raw</b></xmp><p>{story}</p></article>": f"{story.strip()}\n<b>&amp; raw</b>\n{story.strip()}",
        f"<article><p>{story}<object data=x>shown <b>instead</b></object></p></article>": f"{story}shown instead",
        f"<article><p>{story}<select><option>one</select></p><textarea>typed</textarea></article>": story.strip(),
        "<nav><a href=/>Home</a></nav><footer>&copy; us</footer>": "",
        "a < b and c <d": "a < b and c",
    }
    assert dict(zip(cases, html_extract.main_texts(list(cases), trees), strict=True)) == cases


def weblog_page(rng, opening, closing, body=""):
    """(html, main text): a plain page as blog software writes it, in sentences of English words."""
    pool = "the a of to and in city council voted new plan report said people house water year school market river found work after before under over many small old first last while where price road team game".split()
    sent = lambda lo, hi: " ".join(rng.choice(pool) for _ in range(rng.randint(lo, hi))).capitalize() + "."
    title = sent(4, 8)[:-1]
    main = [title, *(" ".join(sent(5, 18) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(3, 9)))]
    nav = "<nav><ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in rng.sample(pool, 5)) + "</ul></nav>"
    story = f"<h1>{title}</h1>" + "".join(f"<p>{x}</p>" for x in main[1:])
    return f"<!doctype html><html><head><title>{title}</title></head><body{body}><header><a href='/'>Site {rng.choice(pool)}</a></header>{nav}{opening}{story}{closing}<footer><p>&copy; 2024 {rng.choice(pool)}. All rights reserved. <a href='/p'>Privacy</a></p></footer></body></html>", "\n".join(main)


WEBLOG = {
    "article": ("<article>", "</article>", ""),
    "id": ("<div id=content>", "</div>", ""),
    "classes": ("<article class='post type-post hentry category-news'>", "</article>", ""),
    "tag": ("<article class='post type-post hentry category-news tag-politics'>", "</article>", ""),
    "body": ("<article>", "</article>", " class='home menu-open'"),
    "column": ("<div class='col-right'>", "</div>", ""),
    "author": ("<div class='author-post'>", "</div>", ""),
    "around": ("<div class='has-sidebar header-fixed'><article>", "</article></div>", ""),
    "silent": ("<div class=xq77>", "</div>", ""),
    "bare": ("", "", ""),
}


@pytest.mark.parametrize("make", WEBLOG)
def test_html_names_do_not_empty_a_page(trees, make):
    rng = random.Random(len(make) + 40)
    pages = [weblog_page(rng, *WEBLOG[make]) for _ in range(100)]
    kept, extra = [], 0
    for (_, text), out in zip(pages, html_extract.main_texts([p for p, _ in pages], trees), strict=True):
        a, b = collections.Counter(out.split("\n")), collections.Counter(text.split("\n"))
        kept.append(sum(len(k) * v for k, v in (a & b).items()) / sum(len(k) * v for k, v in b.items()))
        extra += sum(len(k) * v for k, v in (a - b).items()) / len(text)
    assert np.mean(kept) >= 0.95 and extra / len(pages) < 0.05, (np.mean(kept), extra)


def test_html_short_paragraphs_and_pages_without_an_article(trees):
    story = " ".join(["The council met in the old hall and spoke of the new plan for hours."] * 4)
    talk = lambda n, item: "".join(item.format(k) for k in range(n))
    cases = {
        f"<article><h1>T</h1><p>{story}</p><p>Why?</p><p>{story}</p><p>* * *</p><p>{story}</p></article>": f"T\n{story}\nWhy?\n{story}\n* * *\n{story}",
        f"<html><body><main><p>{story}</p><pre>x = 1; y = 2</pre></main></body></html>": f"{story}\nx = 1; y = 2",
        f"<html><body><nav><a href=/>Home</a></nav><article><p>Short.</p><p>{story}</p><p>{story}</p></article></body></html>": f"Short.\n{story}\n{story}",
        f"<html><body><article><h1>Title of it</h1><p><a href=/1>{story}</a></p><p><a href=/2>{story}</a></p></article></body></html>": f"Title of it\n{story}\n{story}",
        f"<html><body><ul>{talk(8, '<li><a href=/{0}>Link {0}</a></li>')}</ul><div>Copyright 2024 Us</div><a href=/p>Privacy</a> <a href=/t>Terms</a></body></html>": "",
        "<html><body><div><p>We use cookies to improve your experience on this site.</p><button>Accept</button><button>Reject all</button></div></body></html>": "",
        "<html><body><div><form><label>User</label><input name=u><label>Password</label><input name=p><button>Sign in</button></form><a href=/f>Forgot password?</a></div></body></html>": "",
        f"<html><body><div class=k1><h1>Title here</h1><p>{story}</p><p>{story}</p></div><div class=k2><h3>3 opinions</h3>{talk(4, '<div class=k3><b>Ann{0}</b> 3.4.2021<p>I think this was a nice read, thanks.</p><a href=#>Reply</a></div>')}</div></body></html>": f"Title here\n{story}\n{story}",
        f"<html><body><div class=k1><h1>Title here</h1><p>{story}</p><p>{story}</p></div><div class=k2>{talk(5, '<div class=k3><span>Ann{0}</span><p>I think this was a nice read, thanks.</p></div>')}</div></body></html>": f"Title here\n{story}\n{story}",
    }
    assert dict(zip(cases, html_extract.main_texts(list(cases), trees), strict=True)) == cases


def test_runs_between_chosen_siblings_are_closed():
    page = html_extract.parse("<p>a</p><p>b<i class=x>c</i></p><p>d</p><p>e</p><div>f</div><p>g</p>")
    inside = np.array([False, True, False, False, True, False, False, True])
    assert html_extract.close_runs(inside, page).tolist() == [False, True, True, True, True, False, False, True]


def test_decoding_takes_no_barred_node():
    barred = [False, True, True]
    assert html_extract.decode(np.array([-9.0, 9.0, 9.0]), [0, 0, 1], np.ones(3), None, barred).tolist() == [False] * 3
    assert html_extract.decode(np.array([9.0, 9.0, 9.0]), [0, 0, 1], np.ones(3), None, barred).tolist() == [True, False, False]
    assert html_extract.decode(np.array([9.0, 9.0, 9.0]), [0, 0, 1], np.ones(3)).tolist() == [True] * 3


def test_decoding_cuts_no_solid_node():
    logit, weight = np.array([5.0, -9.0, -9.0]), np.ones(3)
    assert html_extract.decode(logit, [0, 0, 0], weight).tolist() == [True, False, False]
    assert html_extract.decode(logit, [0, 0, 0], weight, [False, True, False]).tolist() != [True, False, True]
    assert html_extract.decode(np.array([9.0, -5.0, -5.0]), [0, 0, 0], weight, [False, True, False]).tolist() == [True, True, False]


@pytest.mark.parametrize("unit", ["<a ", "<div>", "<p><b>", "<svg>", "</x>", "<a b=\"", "<!", "<li><option>", "x <b> </b>", "=", "<", "<!--", "<x></y>", "<xmp>", "<i class=\"", "<td>", "&amp", "<a b='c\" "])
def test_broken_markup_takes_linear_time(trees, unit):
    import time

    began = time.process_time()
    html_extract.main_texts([(unit * (1_000_000 // len(unit)))[:1_000_000], "<a " + unit * (300_000 // len(unit))], trees)
    assert time.process_time() - began < 8  # 1.5 s where nothing else runs


def test_decoding_never_contradicts():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(2, 12))
        parent = [0, *[int(rng.integers(0, k)) for k in range(1, n)]]
        logit, weight = rng.normal(0, 3, n), rng.random(n) + 0.1
        inside = html_extract.decode(logit, parent, weight)

        def score(labels):
            total = 0.0
            state = []
            for k in range(n):
                above = state[parent[k]] if k else 0
                s = (1 if labels[k] else 0) if above == 0 else 2 if above == 2 else (1 if labels[k] else 2)
                if above == 2 and labels[k]:
                    return -math.inf
                if k and above == 1 and s == 2:
                    total -= html_extract.CUT_COST
                state.append(s)
                total += -np.logaddexp(0, -logit[k] if labels[k] else logit[k]) * weight[k]
            return total

        best = max(score(x) for x in itertools.product([False, True], repeat=n))
        assert score(tuple(inside)) == pytest.approx(best)


# ------------------------------------------------------------------------- op3

def test_ppm_costs_and_accuracy(spark, docs, none, sf):
    texts = {"a": [b"abracadabra banana", b"banana"], "b": [b"xyxyxz zyx", b"abc"]}
    model = langid.fit_ppm(texts, 3)
    seen = collections.Counter(t[i - d : i] for ts in texts.values() for t in ts for d in range(1, 4) for i in range(d, len(t)))

    def brute(trained, data):
        follow = collections.defaultdict(collections.Counter)
        for t in trained:
            for i, d in itertools.product(range(len(t)), range(4)):
                if i >= d:
                    follow[t[i - d : i]][t[i]] += 1
        bits = 0.0
        for i, b in enumerate(data):
            d = min(3, i)
            while d and seen[data[i - d : i]] < 2:
                d -= 1
            while d >= 0 and (c := follow[data[i - d : i]])[b] == 0:
                bits += math.log2((c.total() + len(c)) / len(c)) if c else 0
                d -= 1
            bits += 8 if d < 0 else -math.log2(c[b] / (c.total() + len(c)))
        return bits

    tests = [b"banana zyx", b"", b"q", "abraé".encode(), b"xyz" * 50]
    offs = np.append(0, np.cumsum([len(t) for t in tests]))
    got = model.bits(np.frombuffer(b"".join(tests), np.uint8), offs)
    want = [[brute(texts[lang], t) for lang in model.langs] for t in tests]
    assert np.abs(got - want).max() < 1e-3
    out = langid.predict_documents(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.95
    rows = langid.predict_documents(docs).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == docs.count() and all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 for k in (2, 3, 4, 7))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows if r["doc_id"] is not None)
    assert langid.predict_documents(none).count() == 0


def test_training_counts_copies_once(spark):
    rng = random.Random(33)
    few, copy = [prose(rng, 40) for _ in range(6)], prose(rng, 40)
    rows = spark.createDataFrame([*((t, "aa") for t in few), *((prose(rng, 40), "bb") for _ in range(6))], "text string, lang string")
    many = spark.range(20_000).select(F.lit(copy).alias("text"), F.lit("aa").alias("lang"))
    got = langid.training_texts(rows.unionByName(many), 5_000)
    assert {x.decode() for x in got["aa"]} == {*few, copy} and len(got["bb"]) == 6


def test_forty_languages_have_all_their_contexts():
    """Each language of many costs what it costs alone, in a table that grows with what was
    seen only."""
    rng = random.Random(34)
    langs = {f"l{k:02}": [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz"[k % 13 : k % 13 + 12]) for _ in range(rng.randint(2, 7))) for _ in range(3000)).encode()] for k in range(40)}
    model = langid.fit_ppm(langs)
    assert model.nbytes < 100 << 20
    for lang in ("l00", "l17", "l39"):
        text = np.frombuffer(langs[lang][0][:4000], np.uint8)
        offs = np.array([0, len(text)])
        bits, alone = model.bits(text, offs)[0], langid.fit_ppm({lang: langs[lang]}).bits(text, offs)[0, 0]
        assert bits[model.langs.index(lang)] == pytest.approx(alone, rel=0.01)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(langid, "MODEL_BYTES", 1000)
        with pytest.raises(ValueError, match="MODEL_BYTES"):
            langid.identify(None_docs(), model)


class None_docs:
    """A frame that is never read."""

    sparkSession = None


def languages(rows):
    """{doc_id: (language, score)} of rows (doc_id, text, lang), from code lengths computed
    byte by byte; whole distinct texts of documents that are not held out are the sample."""
    train = {(t.encode(), lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 5 and t and lang}
    langs = sorted({lang for _, lang in train})
    seen, follow = collections.Counter(), {lang: collections.defaultdict(collections.Counter) for lang in langs}
    for t, lang in train:
        for i, d in itertools.product(range(len(t)), range(4)):
            if i >= d:
                seen[t[i - d : i]] += 1
                follow[lang][t[i - d : i]][t[i]] += 1
    out = {}
    for i, t, _ in rows:
        if not t or not langs or not any(c.isalpha() for c in t):
            out[i] = ("und", 0.0)
            continue
        b, bits = t.encode(), []
        for lang in langs:
            total = 0.0
            for at, byte in enumerate(b):
                d = min(3, at)
                while d and seen[b[at - d : at]] < 2:
                    d -= 1
                while d >= 0 and (c := follow[lang][b[at - d : at]])[byte] == 0:
                    total += math.log2((c.total() + len(c)) / len(c)) if c else 0
                    d -= 1
                total += 8 if d < 0 else -math.log2(c[byte] / (c.total() + len(c)))
            bits.append(total)
        out[i] = (langs[int(np.argmin(bits))], 1 / sum(2 ** -min(x - min(bits), 1000) for x in bits))
    return out


def test_language_query_against_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").filter("octet_length(text) < 4000").select("doc_id", "text", "lang").orderBy("doc_id").collect()][:60]
    rows += [(900_001, "short", "en"), (900_002, "12 34", "en"), (900_003, None, "en"), (900_004, "\ufffd\u00e9", None), (900_005, "", "de")]
    want = languages(rows)
    for r in langid.predict_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect():
        assert r["lang_pred"] == want[r["doc_id"]][0] and r["score"] == pytest.approx(want[r["doc_id"]][1], abs=1e-4)


def test_long_texts_cost_the_same_in_pieces(monkeypatch):
    rng = random.Random(35)
    model = langid.fit_ppm({"a": [prose(rng, 500).encode()], "b": [prose(rng, 500).upper().encode()]})
    texts = [prose(rng, 9000).encode(), b"", prose(rng, 3).encode(), prose(rng, 4000).encode()]
    data, offs = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
    want = np.array([model.bits(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts])
    monkeypatch.setattr(langid, "KERNEL_BYTES", 1000)
    assert np.allclose(model.bits(data, offs), want, rtol=1e-6)


# ------------------------------------------------------------------------- op4

def word_bins(text):
    """Words by hash bin, with the hash written out for one word at a time."""
    m64, odd = 2**64 - 1, 0x9E3779B97F4A7C15

    def mix(x):
        x = (x ^ (x >> 31)) * 0xBF58476D1CE4E5B9 & m64
        x = (x ^ (x >> 29)) * 0x94D049BB133111EB & m64
        return x ^ (x >> 32)

    out = [0] * mixing.TERMS
    for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()):
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in w)
        h = mix(len(w) * odd & m64)
        for k in range(0, len(w), 8):
            h = mix((h ^ int.from_bytes(w[k : k + 8], "little")) * odd & m64)
        out[mix(h if len(w) <= 256 else xxhash.xxh3_64_intdigest(w, 0)) % mixing.TERMS] += 1
    return out


def mixed(rows, centres, keep=0.5, flatten=0.7):
    """{(doc_id, text): (cell, tokens, p)} of rows (doc_id, text, lang, source), by loops."""
    cells, where = collections.Counter(), {}
    for i, t, lang, source in rows:
        bins = word_bins(t)
        near = [round(sum(math.sqrt(b) * c for b, c in zip(bins, centre, strict=True)), 9) for centre in centres]
        topic = f"topic{near.index(max(near))}" if sum(bins) else "none"
        where[i, t] = (source or "unknown", lang or "unknown", topic), sum(bins)
        cells[where[i, t][0]] += sum(bins)
    total = sum(cells.values())
    share = [collections.Counter() for _ in range(3)]
    for cell, n in cells.items():
        for s, v in zip(share, cell, strict=True):
            s[v] += n / total
    weight = {c: n * math.prod(s[v] ** (flatten - 1) if s[v] else 0 for s, v in zip(share, c, strict=True)) for c, n in cells.items()}
    every = sum(weight.values())
    low, high = 0.0, 1e12
    for _ in range(300):  # the scale by bisection
        middle = (low + high) / 2
        low, high = (middle, high) if sum(min(n, middle * weight[c] / every) for c, n in cells.items()) < keep * total else (low, middle)
    return {k: (c, n, min(1.0, high * weight[c] / every / cells[c]) if cells[c] else 0.0) for k, (c, n) in where.items()}


def test_mixing_against_loops(spark, docs, corpus, none, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    for df, rows in ((docs, [r[:4] for r in corpus]), (table, [tuple(r) for r in table.select("doc_id", "text", "lang", "source").collect()])):
        want = mixed(rows, mixing.sampled_topics(df).centres.tolist())
        got = mixing.mix(df).collect()
        assert len(got) == len(rows)
        texts = collections.defaultdict(set)
        for i, t, *_ in rows:
            texts[i].add(t)
        for r in got:
            assert any(want[r["doc_id"], t][0] == (r["source"], r["lang"], r["topic"]) and want[r["doc_id"], t][1] == r["tokens"] and want[r["doc_id"], t][2] == pytest.approx(r["p"], abs=1e-6) for t in texts[r["doc_id"]]), r
            assert r["kept"] == (r["u"] < r["p"])
    far = mixing.mix(docs, local_cells=0).collect()
    near = {(r["doc_id"], r["tokens"], r["u"]): r["p"] for r in mixing.mix(docs).collect()}
    assert len(far) == len(corpus) and all(near[r["doc_id"], r["tokens"], r["u"]] == pytest.approx(r["p"], abs=1e-7) for r in far)
    assert mixing.mix(none).count() == 0 and mixing.mix(none, local_cells=0).count() == 0
    kept = mixing.mixed_documents(docs)
    assert kept.columns == docs.columns and kept.count() == mixing.mix(docs).filter("kept").count()
    given = docs.withColumn("topic", F.when(F.col("doc_id") % 2 == 0, "even"))
    assert {r["topic"] for r in mixing.mix(given).collect()} == {"even", "unknown"}
    assert mixing.mixed_documents(given).columns == given.columns


@pytest.mark.parametrize("cells", [10**6, 0])
def test_raking_makes_the_default_mix(spark, docs, monkeypatch, cells):
    p = lambda: {(r["doc_id"], r["tokens"], r["u"]): r["p"] for r in mixing.mix(docs, local_cells=cells).collect()}
    raked = p()
    monkeypatch.setattr(mixing, "SWEEPS", 0)
    plain = p()
    assert {round(x, 9) for k, x in plain.items() if k[1]} == {mixing.KEEP_SHARE}
    assert any(abs(x - plain[k]) > 1e-3 for k, x in raked.items())
    monkeypatch.setattr(mixing, "SWEEPS", 1)  # too few: the flatter mix itself
    assert all(x == pytest.approx(raked[k], abs=1e-7) for k, x in p().items())


def test_topics_part_what_differs():
    rng = random.Random(14)
    kinds = [[prose(rng, 1) for _ in range(40)] for _ in range(3)]
    counts = np.array([word_bins(" ".join(rng.choice(kinds[k % 3]) for _ in range(80))) for k in range(90)])
    found = mixing.fit_topics(counts, 3).of(counts)
    assert len(set(found)) == 3 and all(len(set(found[k::3])) == 1 for k in range(3))
    assert mixing.fit_topics(counts[:0]).of(counts[:2]).tolist() == [-1, -1]


@pytest.fixture(scope="module")
def many(spark):
    """4,600 short texts of five kinds, of which every tenth is there twice."""
    rng = random.Random(16)
    kinds = [[prose(rng, 1) for _ in range(30)] for _ in range(5)]
    rows = [(k, " ".join(rng.choice(kinds[k * k % 5]) for _ in range(12)), rng.choice(["en", "en", "fr"]), rng.choice(["s0", "s1"])) for k in range(4600)]
    rows += [(10_000 + k, *r[1:]) for k, r in enumerate(rows[::10])]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(7)


def counted(df):
    """Term counts of each distinct text, in the order of hashes."""
    texts = [r["text"].encode() for r in df.select("text", F.xxhash64("text").alias("h")).distinct().orderBy("h").collect()]
    return mixing.term_counts(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))


def test_topics_are_fitted_on_every_text(many):
    counts = counted(many[1])
    assert len(counts) > 4000
    want = mixing.fit_topics(counts).centres
    for parts in (1, 7):
        assert mixing.sampled_topics(many[1].repartition(parts)).centres == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("cells", [10**6, 0])
def test_mixing_targets(spark, cells):
    rng = random.Random(15)
    rows = [(k, prose(rng, 30), rng.choice(["en", "en", "fr", "de"]), rng.choice(["s0", "s1"]), rng.choice(["x", "y"])) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string")
    aim = {"lang": {"en": 0.2, "fr": 0.5, "de": 0.3}, "source": {"s0": 0.5, "s1": 0.5}, "topic": {"x": 0.6, "y": 0.4}}
    got = mixing.mix(df, aim, keep_share=0.2, local_cells=cells).toPandas()
    mass = (got.p * got.tokens).groupby(got.lang).sum()
    assert got.p.max() < 1 and mass["fr"] / mass.sum() == pytest.approx(0.5, abs=1e-5) and mass.sum() == pytest.approx(0.2 * got.tokens.sum(), rel=1e-6)
    with pytest.raises(ValueError, match="no tokens of lang xx"):
        mixing.mix(df, {"lang": {"en": 0.2, "xx": 0.8}}, local_cells=cells)
    if cells:
        with pytest.warns(UserWarning, match="no tokens of lang xx"):
            lost = mixing.mix(df, {"lang": {"en": 0.2, "xx": 0.8}}, strict=False).toPandas()
        assert (lost[lost.lang != "en"].p == 0).all()
        # en only in s0: its share cannot differ from that of s0
        tied = df.withColumn("source", F.when(F.col("lang") == "en", "s0").otherwise("s1"))
        with pytest.raises(ValueError, match="contradict"):
            mixing.mix(tied, {"lang": {"en": 0.5, "fr": 0.25, "de": 0.25}, "source": {"s0": 0.1, "s1": 0.9}})


# ------------------------------------------------------------------------- op5

def test_seeds_hit_every_window_with_two_words_replaced():
    for gone in itertools.combinations(range(13), 2):
        left = set(range(13)) - set(gone)
        assert any(all(s + j in left for j, c in enumerate(m) if c == "1") for m in decontam.MASKS for s in range(13 - len(m) + 1)), gone


def overlapping(rows, items):
    """{(doc_id, item_id): most equal words} of the pairs that overlap, by all alignments."""
    word = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    want = {}
    for (d, text), (i, item) in itertools.product(rows, items):
        a, b = np.array(word(text), object), np.array(word(item), object)
        width = min(len(b), decontam.VERIFY_WORDS)
        for line in range(-len(b), len(a)) if len(b) > 1 or len(a) == len(b) == 1 else ():
            lo, hi = max(line, 0), min(line + len(b), len(a))
            eq = a[lo:hi] == b[lo - line : hi - line]
            if eq.sum() >= 0.8 * width and max((eq[k : k + width].sum() for k in range(len(eq) - width + 1)), default=0) >= 0.8 * width:
                want[d, i] = max(want.get((d, i), 0), int(eq.sum()))
    return want


def test_decontamination_against_brute_force(spark, docs, corpus, none):
    rng = random.Random(5)
    items = [prose(rng, n) for n in (4, 6, 12, 13, 30, 45, 45, 1, 2, 3)]
    items[6] = items[5]
    def changed(text, every):
        return " ".join("zz" if k % every == every - 1 else w for k, w in enumerate(text.split(" ")))
    planted = [items[4], changed(items[4], 6).replace("a", "A"), changed(items[4], 3), items[5][: len(items[5]) // 2], prose(rng, 9) + " " + items[3] + "\n" + prose(rng, 9), items[1], items[0], items[5] + " " + items[5], changed(items[2], 6), items[7], "so " + items[7], f"so {items[8].upper()} on", f"{items[9]} {items[9]}", items[9].split(" ")[0]]
    rows = [*corpus[:40], *[(100 + k, t, None, None, 1, "c", 1, 2, "s", 0) for k, t in enumerate(planted)]]
    bench = spark.createDataFrame([*enumerate(items), (19, None), (20, ""), (None, items[4])], "item_id long, text string")
    found = decontam.overlaps(spark.createDataFrame(rows, SCHEMA), bench).collect()
    want = overlapping([r[:2] for r in rows], [*enumerate(items), (None, items[4])])
    assert {(r["doc_id"], r["item_id"]): r["matched"] for r in found} == want and len(want) >= 9
    assert decontam.overlaps(none, bench).count() == 0 and decontam.overlaps(docs, bench.limit(0)).count() == 0
    clean = decontam.clean_documents(spark.createDataFrame(rows, SCHEMA), bench)
    assert clean.columns == SCHEMA.replace(",", "").split(" ")[::2] and {r["doc_id"] for r in clean.collect()} == {r[0] for r in rows} - {d for d, _ in want}


def test_short_items_match_with_any_words_replaced(spark):
    rng = random.Random(15)
    rows, items, want = [], [], {}
    for n in range(5, 14):
        item = [f"w{n}x{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        for many in range(n // 5 + 2):
            for gone in itertools.combinations(range(n), many):
                words = ["zz" if k in gone else w for k, w in enumerate(item)]
                rows.append((len(rows), " ".join([prose(rng, 6), *words, prose(rng, 6)])))
                if n - many >= decontam.SIMILARITY * n:
                    want[rows[-1][0], n] = n - many
    items.append((4, "what is quantum entanglement"))
    rows += [(len(rows), "Well, What is\tquantum Entanglement then"), (len(rows) + 1, "what is quantum")]
    want[rows[-2][0], 4] = 4
    found = decontam.overlaps(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]): r["matched"] for r in found.collect()} == want


def test_best_windows():
    rng = np.random.default_rng(2)
    size, width = rng.integers(0, 30, 200), rng.integers(1, 14, 200)
    equal = rng.random(size.sum()) < 0.6
    ends = np.append(0, np.cumsum(size))
    want = [max((int(equal[a + k : a + k + w].sum()) for k in range(n - w + 1)), default=0) for a, n, w in zip(ends, size, width, strict=False)]
    assert decontam.best_windows(equal, size, width).tolist() == want


# ------------------------------------------------------------------------- op6

@pytest.mark.parametrize("shards", [16, 5])
def test_shards(docs, none, spark, sf, shards):
    for source in (docs, spark.read.parquet(f"{sf}/documents.parquet")):
        got = sharding.shard_documents(source, shards).toPandas()
        want = source.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).toPandas()
        assert sorted((str(a), b) for a, b in zip(got.doc_id, got["size"], strict=True)) == sorted((str(a), len(t.encode()) + 1) for a, t in zip(want.doc_id, want.t, strict=True))
        for _, slots in got.groupby("shard").slot:
            assert sorted(slots) == list(range(len(slots)))
        sums = got.groupby("shard")["size"].sum().reindex(range(shards), fill_value=0)
        assert sums.max() - sums.min() <= 2 * got["size"].max() + 2
    assert sharding.shard_documents(none, shards).count() == 0


def kd_tree(points, shards):
    """points: (keys of the dims, tie keys, weight) of rows; the shard of each, recursively."""
    out = [0] * len(points)
    dims = range(len(points[0][0])) if points else ()
    whole = [(max(p[0][i] for p in points) - min(p[0][i] for p in points)) or 1.0 for i in dims]

    def split(rows, first, n):
        if n == 1 or not rows:
            for r in rows:
                out[r] = first
            return
        wide = max(dims, key=lambda i: (max(points[r][0][i] for r in rows) - min(points[r][0][i] for r in rows)) / whole[i])
        key = lambda r: (points[r][0][wide], *points[r][1])
        goal, upto, left = sum(points[r][2] for r in rows) * (n // 2) / n, 0, []
        for _, same_key in itertools.groupby(sorted(rows, key=key), key):
            group = list(same_key)
            before, upto = upto, upto + sum(points[r][2] for r in group)
            if upto < goal or (before < goal and upto - goal <= goal - before):
                left += group
            else:
                break
        split(left, first, n // 2)
        split(sorted(set(rows) - set(left)), first + n // 2, n - n // 2)

    split(list(range(len(points))), 0, shards)
    return out


def shards_of(rows, shards=16):
    """(doc_id, text crc, shard) of rows (doc_id, text, lang, source) by the docstring."""
    size = lambda t: len((t or "").encode()) + 1
    nulls_first = lambda v: (v is not None, v or "")
    least = {}
    for _, t, lang, source in rows:
        a, b = least.get(t or "", (source, lang))
        least[t or ""] = min(a, source, key=nulls_first), min(b, lang, key=nulls_first)
    sums = [collections.Counter(), collections.Counter()]
    for _, t, *_ in rows:
        for s, v in zip(sums, least[t or ""], strict=True):
            s[v] += size(t)
    place = []
    for s in sums:
        upto, at = 0, {}
        for v in sorted(s, key=nulls_first):
            at[v] = (upto + s[v] / 2) / s.total()
            upto += s[v]
        place.append(at)
    points = []
    for row, (i, t, *_) in enumerate(rows):
        n, low = size(t), -(2**63) if i is None else i
        meta = [at[v] for at, v in zip(place, least[t or ""], strict=True)]
        points.append(([*meta, math.log(n) / math.log(2), (n - 1 - len(t or "")) / n], (zlib.crc32((t or "").encode()), low >> 32, low & 0xFFFFFFFF, row), n))
    return [(i, p[1][0], s) for (i, *_), p, s in zip(rows, points, kd_tree(points, shards), strict=True)]


@pytest.mark.parametrize("shards", [16, 5])
def test_shards_against_a_recursive_tree(spark, docs, corpus, sf, shards):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    for source, rows in ((docs, [r[:4] for r in corpus]), (table, [tuple(r) for r in table.select("doc_id", "text", "lang", "source").collect()])):
        got = sharding.shard_documents(source, shards).select("doc_id", "text_crc32", "shard").collect()
        assert collections.Counter(map(tuple, got)) == collections.Counter(shards_of(rows, shards))
        homes = collections.defaultdict(set)
        for _, crc, shard in got:
            homes[crc].add(shard)
        assert sum(len(h) > 1 for h in homes.values()) <= shards - 1


def test_shards_of_equal_rows(spark):
    rows = [(k, "same", None, ["a", "b"][k % 2], 4, "c", 1, 2, "s", 0) for k in range(160)]
    assert sorted(r["count"] for r in sharding.shard_documents(spark.createDataFrame(rows, SCHEMA)).groupBy("shard").count().collect()) == [10] * 16
    few = spark.createDataFrame([(k % 7, f"text {k % 30}", None, ["a", "b"][k % 2]) for k in range(120)], "doc_id long, text string, lang string, source string")
    homes = collections.defaultdict(set)
    for r in sharding.shard_documents(few, 4).collect():
        homes[r["text_crc32"]].add(r["shard"])
    assert len(homes) == 30 and sum(len(h) > 1 for h in homes.values()) <= 3
    repeated = [(5, "one text " * 40, "en", "a")] * 400 + [(k, f"text {k} " * (k % 9), ["en", None][k % 2], ["a", "b"][k % 3 % 2]) for k in range(60)]
    got = sharding.shard_documents(spark.createDataFrame(repeated, "doc_id long, text string, lang string, source string").repartition(3))
    sums = [r[1] for r in got.groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sums) == 16 and max(sums) - min(sums) <= 2 * 362  # no cut leaves the sides more than a row apart
    assert collections.Counter(map(tuple, got.select("doc_id", "text_crc32", "shard").collect())) == collections.Counter(shards_of(repeated))
    bare = few.select("doc_id", "text")
    assert sharding.shard_documents(bare, 4).count() == 120


# ------------------------------------------------------------------------- op7

def test_media_formats_round_trip():
    rng = np.random.default_rng(3)
    grey, rgb = rng.integers(0, 256, (5, 7), np.uint8), rng.integers(0, 256, (3, 6, 3), np.uint8)
    assert (media.decode_image(media.encode_pgm(grey)) == grey).all() and (media.decode_image(media.encode_bmp(grey)) == grey).all()
    assert (media.decode_image(b"P6 # note\n6 3\n255\n" + rgb.tobytes()) == rgb).all()
    assert (media.decode_image(b"P3\n6 3\n255\n" + " ".join(map(str, rgb.reshape(-1))).encode()) == rgb).all()
    assert (media.decode_image(b"P2 7 5 255\n" + " ".join(map(str, grey.reshape(-1))).encode()) == grey).all()
    assert media.decode_image(b"P1\n3 2\n1 0 1\n0 1 0").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode_image(b"P4\n3 2\n" + bytes([0b10100000, 0b01000000])).tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode_image(b"P5 2 1 65535\n" + bytes([1, 0, 0, 2])).tolist() == [[256, 2]]
    import struct

    body = b"".join(row[:, ::-1].tobytes().ljust(20, b"\0") for row in rgb[::-1])
    bmp = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + len(body), 0, 0, 54, 40, 6, 3, 1, 24, 0, len(body), 0, 0, 0, 0) + body
    assert (media.decode_image(bmp) == rgb).all()
    with pytest.raises(ValueError):
        media.decode_image(b"GIF89a")
    small = media.tile(grey, 2, 3)
    fine = np.repeat(np.repeat(grey.astype(float), 2, 0), 3, 1)  # 10 x 21: both tilings are whole
    assert np.allclose(small, fine.reshape(2, 5, 3, 7).mean((1, 3)))


def test_media_columns(docs, none):
    forms = [media.text_payload_images(docs.select("doc_id", "text", "k1"), form=f) for f in ("pgm", "bmp")]
    assert [{bytes(r["media"][:2]) for r in f.collect()} for f in forms] == [{b"P5"}, {b"BM"}]
    for r in forms[0].unionByName(forms[1]).collect():
        stored = bytes(r["media"])
        payload = media.decode_image(stored).tobytes()
        assert len(payload) == r["payload_bytes"] and len(payload) % 64 == 0 and len(payload) >= 64
        assert hashlib.sha256(payload).hexdigest() == r["payload_sha256"] and zlib.crc32(payload[-64:]) == r["tail_crc32"]
        assert len(stored) == r["media_bytes"] and hashlib.sha256(stored).hexdigest() == r["media_sha256"]
        assert np.load(__import__("io").BytesIO(bytes(r["tile"]))).shape == (16, 16)
    by = {r["doc_id"]: (r["n_bytes"], r["payload_sha256"], r["dhash"]) for r in media.text_payload_images(docs, False).collect()}
    assert by[0] == by[1] == by[-7] and by[2] == by[3] and by[2][0] == 0
    assert media.text_payload_images(none).count() == 0


def test_media_query_writes_tiles(spark, sf):
    got = {r["doc_id"]: r for r in QUERIES["op7_media_columns"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs) > 0
    for r in docs:
        image = media.decode_image(media.text_image((r["text"] or "").encode()))
        tile = np.load(io.BytesIO(got[r["doc_id"]]["tile"]))
        edge = lambda n: np.arange(media.TILE + 1) * n / media.TILE
        share = [np.clip(np.minimum(edge(n)[1:, None], np.arange(1, n + 1)) - np.maximum(edge(n)[:-1, None], np.arange(n)), 0, None) * media.TILE / n for n in image.shape]
        assert tile.dtype == np.uint8 and np.abs(share[0] @ image @ share[1].T - tile).max() <= 0.5 + 1e-6


# ------------------------------------------------------------------------- op8

def word_set(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ")
    w = [x for x in w if x]
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])


def linked(rows):
    sets = [word_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [(i, len(s), i if not s else least.get(root(k))) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]


def test_ngram_join(spark, docs, corpus, none):
    got = ngram_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()
    want = linked([r[:2] for r in corpus])
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    assert ngram_join.near_duplicates(none).count() == 0
    one = ngram_join.one_of_each(docs)
    kept = [r["doc_id"] for r in one.collect()]
    assert one.columns == docs.columns and sorted(k for k in kept if k is not None) == sorted({c for i, _, c in want if i is not None})


@pytest.mark.parametrize("frequent,singles,block", [(2, 10**6, 16), (2, 40, 4), (64, 80, 512)])
def test_ngram_join_of_a_large_near_group(spark, monkeypatch, frequent, singles, block):
    """Frequent tokens in pairs and singly, families of more than one block, long chains."""
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "SINGLES_FROM", singles)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(8)
    rows = []
    for g in range(3):
        words = prose(rng, 60 + 20 * g).split(" ")
        for k in range(30):
            if k % 3 == 0:
                words = words.copy()
                words[rng.randrange(len(words))] = f"v{g}x{k}"
            own = words.copy()
            for _ in range(rng.choice([0, 0, 1, 2])):
                own[rng.randrange(len(own))] = f"u{g}x{k}"
            rows.append((1000 * g + k, " ".join(own)))
    rng.shuffle(rows)
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(linked(rows))


def test_ngram_join_keeps_apart_what_polynomials_confuse(spark):
    """Thue-Morse words of 2048 bytes have equal hashes under every polynomial mod 2^64."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    rows = [(1, a), (2, b), (3, a), (4, f"{a} x y z w v"), (5, f"{b} x y z w v")]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_candidates_of_shared_passages_stay_few(spark):
    """Texts of passages that many share, two or three of them in each: hardly a link, and
    one connected group of candidates. What is compared stays in proportion to the entries."""
    rng = random.Random(44)
    passages = [prose(rng, 40) for _ in range(150)]
    rows = [(k, " ".join([*rng.sample(passages, rng.randint(2, 3)), prose(rng, 12)])) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.near_duplicates(df).select("doc_id", "n_shingles", "component_id").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(linked(rows))
    from siltstone.llm.common import Tables, lean

    named = df.select(F.xxhash64("text").alias("k1"), F.hash("text").alias("k2"), F.encode("text", "UTF-8").alias("t")).mapInArrow(lean(ngram_join._to_sets), "k1 long, k2 int, s long, n int, tokens array<bigint>")
    with Tables(spark) as tables:
        entries = tables.table(ngram_join.open_entries(tables.table(ngram_join.index_entries(named.select("s", "n", "tokens"))), None, tables))
        blocks = ngram_join.homes(entries, 0, tables).select("s", F.col("home").alias("block"))
        assert ngram_join.block_pairs(entries, blocks).count() <= 8 * entries.count()


def test_ngram_join_of_long_texts(spark):
    """Texts over a kernel's size, copies and near copies of them."""
    rng = random.Random(45)
    long = prose(rng, 60_000)
    near = long.split(" ")
    for k in range(0, 2000):
        near[rng.randrange(len(near))] = f"w{k}"
    far = long.split(" ")
    for k in range(0, 9000):
        far[rng.randrange(len(far))] = f"w{k}"
    rows = [(1, long), (2, " ".join(near)), (3, " ".join(far)), (4, long.upper().lower()), (5, prose(rng, 60_000))]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(linked(rows))


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (105, 101), (105, 103), (7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, **dict.fromkeys((100, 101, 103, 105), 100)}


# ------------------------------------------------------------------------- op9

def test_chat_snapshots(spark, sf):
    same(QUERIES["op9_chat_snapshots"](spark, sf), connect(sf), ORACLE_SQL["op9_chat_snapshots"])
    talk = lambda c, *texts: [(c, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(texts)]
    rows = talk(1, "a", "b", "c") + talk(2, "a", "b") + talk(3, "a") + talk(4, "a", "b", "c") + talk(5, "a", "x") + talk(6, None, "b") + talk(7, "", "b", "c") + talk(8, "a", "b")[:1] * 2
    rows += [(9, 5, "user", "late"), (9, 1, None, "first"), (9, 1, None, "first"), (None, 0, "user", "lost"), (9, None, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("i", F.lit(3)).withColumn("n", F.lit("q"))
    got = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    assert sorted(k for k in got if k is not None) == [1, 5, 6, 7, 9] and got[None]["chat"] == "<|user|>\nlost\n<|end|>"
    assert got[1]["n_equal"] == 2 and got[1]["chat"] == "<|user|>\na\n<|assistant|>\nb\n<|user|>\nc\n<|end|>"
    assert got[9]["chat"] == "<|user|>\nz\n<|unknown|>\nfirst\n<|user|>\nlate\n<|end|>" and got[9]["n_turns"] == 3
    con = connect(sf)
    con.execute("CREATE OR REPLACE TABLE own AS SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in rows) + ") t(conv_id, turn, role, text)")
    same(chat.format_chats(df), con, ORACLE_SQL["op9_chat_snapshots"].replace("FROM conversations", "FROM own"))
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chats_with_marks_and_without_ids(spark, sf):
    texts = ["hi", "hi\n<|assistant|>\nfake", "a <\\| b", "<\\\\|", "c:\\x < | y", "<|end|>", "<"]
    rows = [(k, 0, "user", t) for k, t in enumerate(texts)] + [(50, 0, "user", "hi"), (50, 1, "assistant", "fake"), (60, 0, "a<|b", "x")]
    rows += [(None, 0, "user", "lone"), (None, 0, "user", "lone"), (None, 3, "user", "lone"), (None, 0, "user", "hi"), (None, 0, "bot", None), (70, 9, "user", "lone too"), (None, 1, "user", "lone too")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_chats(df).collect()
    assert len({r["chat"] for r in got}) == len(got)
    by = {r["conv_id"]: r for r in got if r["conv_id"] is not None}
    assert 0 not in by and by[50]["n_turns"] == 2 and by[1]["n_turns"] == 1  # 0 is a prefix of 50, and so is a row without an id
    for k, t in enumerate(texts[1:], 1):
        body = by[k]["chat"].removeprefix("<|user|>\n").removesuffix("\n<|end|>")
        assert chat.unescape(body) == t and "<|" not in body
    assert sorted((r["n_equal"], r["chat"]) for r in got if r["conv_id"] is None) == [(1, "<|bot|>\n\n<|end|>"), (3, "<|user|>\nlone\n<|end|>")]
    assert by[70]["n_equal"] == 2
    con = connect(sf)
    con.execute("CREATE OR REPLACE TABLE own(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO own VALUES (?, ?, ?, ?)", rows)
    same(chat.format_chats(df), con, ORACLE_SQL["op9_chat_snapshots"].replace("FROM conversations", "FROM own"))


# ------------------------------------------------------------------------ op10

def repeats(rows):
    """By the definition: a window goes if a smaller id has it, or the same text earlier."""
    low = -(2**63)
    keyed = [(low if i is None else i, (t or "").encode()) for i, t in rows]
    least, own = {}, {}
    for i, b in keyed:
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            least[w] = min(least.get(w, i), i)
            own.setdefault((i, b, w), k)
    out = []
    for i, b in keyed:
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if least[w] < i or own[i, b, w] < k:
                gone[k : k + 100] = b"\1" * 100
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((None if i == low else i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [None, 300])
def test_repeated_strings(spark, docs, corpus, none, unclear, hot, monkeypatch):
    """hot: every anchor of two contexts or more is split by finer ones."""
    if hot:
        for name, value in (("HOT_BYTES", hot), ("CELL", 3)):
            monkeypatch.setattr(suffix, name, value)
    for df, rows in ((docs, corpus), (spark.createDataFrame(unclear, SCHEMA).repartition(3), unclear)):
        got = collections.Counter(map(tuple, suffix.remove_repeats(df).collect()))
        want = collections.Counter(repeats([r[:2] for r in rows]))
        assert got == want, (got - want, want - got)
    assert suffix.remove_repeats(none).count() == 0


def test_steps_in_one_process_against_brute_force(monkeypatch):
    """Finer anchors on random texts of few letters, without Spark: the same windows under
    the same finer anchor, at the same place."""
    rng = random.Random(12)
    base = "".join(rng.choice("ab") for _ in range(400))
    c = {k: [] for k in suffix._KINDS}
    for j in range(40):
        at, n = rng.randrange(0, 200), rng.randint(100, 168)
        rel = rng.randrange(n - 100, 69)
        text = (base[at : at + n] if rng.random() < 0.7 else "".join(rng.choice("ab") for _ in range(n))).encode()
        for k, v in zip(suffix._KINDS, (7, j, j, 0, rel, n, None), strict=True):
            c[k].append(np.frombuffer(text, np.uint8) if k == "data" else v)
    c = {k: np.concatenate(v) if k == "data" else np.array(v, suffix._KINDS[k]) for k, v in c.items()}
    def windows(c):
        offs, out = np.append(0, np.cumsum(c["size"])), []
        for j in range(len(c["doc"])):
            for w in range(c["size"][j] - 99):
                out.append((c["doc"][j], c["start"][j] + w, c["rel"][j] - w, c["data"][offs[j] + w : offs[j] + w + 100].tobytes(), c["h"][j]))
        return out
    fine = windows(suffix.finer(c))
    assert sorted(x[:4] for x in fine) == sorted(x[:4] for x in windows(c))
    by = {}
    for _, _, o, w, h in fine:
        assert by.setdefault((o, w), h) == h


def test_very_long_texts_against_brute_force(spark):
    """Texts over a kernel's size, one of a single character, one with far repeats."""
    rng = random.Random(19)
    pool = [prose(rng, 12) for _ in range(2000)]
    long = " ".join(rng.choice(pool) + prose(rng, 3) for _ in range(5000))
    rows = [(1, long[:600_000]), (2, prose(rng, 9) + long[250_000:700_000]), (3, "=" * 700_000), (4, ("0123456789" * 40 + "\n") * 900), (5, "=" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert collections.Counter(map(tuple, suffix.remove_repeats(df).collect())) == collections.Counter(repeats(rows))
    got = collections.Counter((r["doc_id"], r["start"], r["n_bytes"]) for r in substring.repeated_runs(df).collect())
    assert got == repeated_chunks(rows)


def test_periodic_text_needs_little_memory():
    """8 MB of one character are one window and a range, not a context for each byte."""
    text = np.frombuffer(b"=" * (8 << 20), np.uint8)
    h, _, start, last, _, again = suffix.anchors(text, np.array([0, len(text)]))
    assert len(h) < 20_000 and (last - start + 1)[again].sum() > (8 << 20) - 20_000


def test_merged_transforms_group_equal_windows(monkeypatch):
    rng = random.Random(3)
    base = [bytes(rng.choice(b"ab") for _ in range(130)) for _ in range(5)]
    for shards in (1, 2, 5):
        monkeypatch.setattr(suffix, "SHARDS", shards)
        strings = []
        for _ in range(30):
            x = bytearray(rng.choice(base)[rng.randrange(0, 20) : rng.randrange(112, 130)])
            if rng.random() < 0.5 and x:
                x[rng.randrange(len(x))] = ord("c")
            strings.append(bytes(x))
        strings += [b"a" * 140, b"", b"ab" * 70]
        data, offs = np.frombuffer(b"".join(strings), np.uint8), np.append(0, np.cumsum([len(x) for x in strings]))
        number, by = suffix.equal_windows(data, offs), {}
        many = collections.Counter(x[o : o + 100] for x in strings for o in range(len(x) - 99))
        for j, x in enumerate(strings):
            for o in range(len(x)):
                n, window = number[offs[j] + o], x[o : o + 100]
                assert (n >= 0) == (len(window) == 100 and many[window] > 1)
                if n >= 0:
                    assert by.setdefault(window, n) == n
        assert len(set(by.values())) == len(by)


def test_suffix_arrays():
    rng = random.Random(6)
    for _ in range(30):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 1, 5, 30]))) for _ in range(rng.randint(1, 8))]
        data, offs = np.frombuffer(b"".join(strings), np.uint8), np.append(0, np.cumsum([len(x) for x in strings]))
        want = sorted((tuple(c + 1 for c in x[o:]) + (0, j), int(offs[j]) + j + o) for j, x in enumerate(strings) for o in range(len(x) + 1))
        assert suffix.suffix_array(data, offs).tolist() == [at for _, at in want]


# -------------------------------------------------------------------- pipeline

def test_pipeline_stages(spark, docs, none, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs_now = docs
    names = docs.columns
    for k, (_, stage) in enumerate(pipeline.STAGES):
        before = docs_now
        docs_now = materialize(stage(spark, docs_now, sf))
        if k < len(pipeline.STAGES) - 1:
            assert docs_now.columns == names and docs_now.count() <= before.count()
    assert docs_now.count() == before.count()
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0
    assert pipeline.run(spark, sf).count() > 0


def test_pipeline_keeps_what_raking_gives(spark, sf, monkeypatch):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = lambda: {r["doc_id"] for r in pipeline.mix_sources(spark, docs, sf).select("doc_id").collect()}
    raked = kept()
    monkeypatch.setattr(mixing, "SWEEPS", 0)
    assert raked and raked != kept()


def test_pipeline_mixes_by_topics_of_every_text(spark, sf, many):
    """Over more than 4,000 texts, against the draw written as loops."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rows, docs = many
    p = mixed(rows, mixing.fit_topics(counted(docs)).centres.tolist())
    u = {r["doc_id"]: r["u"] for r in docs.select("doc_id", mixing._draw().alias("u")).collect()}
    got = {r["doc_id"] for r in pipeline.mix_sources(spark, docs, sf).collect()}
    assert got == {r[0] for r in rows if u[r[0]] < p[r[0], r[1]][2]}


def test_pipeline_against_brute_force(spark, sf, tmp_path):
    """run() over short documents with planted copies, near copies, benchmark passages,
    empty texts and texts of no language, against the stages written as loops."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(55)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").filter("octet_length(text) < 2500").select("doc_id", "text", "lang", "source", "n_chars").orderBy("doc_id").collect()][:70]
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").orderBy("item_id").collect()][:12]
    words = rows[3][1].split(" ")
    near = [" ".join("new" if k in (n, n + 9) else w for k, w in enumerate(words)) for n in range(4)]
    new = [rows[0][1], rows[0][1], rows[5][1], *near, rows[7][1] + " " + bench[0][1], bench[1][1], None, "", "12 34 !", None]
    rows += [(10_000 + k, t, rng.choice(["en", "de", None]), rng.choice(["x", None]), len(t or "")) for k, t in enumerate(new)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    told = languages([r[:3] for r in rows])
    kept = [r for r in rows if told[r[0]][0] != "und" and told[r[0]][1] >= pipeline.MIN_SCORE]
    assert len(kept) < len(rows)
    one = {c for i, _, c in linked([r[:2] for r in kept])}
    kept, before = [r for r in kept if r[0] in one], kept
    assert len(kept) < len(before)
    dirty = {d for d, _ in overlapping([r[:2] for r in kept], bench)}
    kept, before = [r for r in kept if r[0] not in dirty], kept
    assert len(kept) < len(before)
    now = spark.createDataFrame(kept, "doc_id long, text string, lang string, source string, n_chars long")
    p = mixed([r[:4] for r in kept], mixing.sampled_topics(now).centres.tolist())
    u = {r["doc_id"]: r["u"] for r in now.select("doc_id", mixing._draw().alias("u")).collect()}
    kept = [r for r in kept if u[r[0]] < p[r[0], r[1]][2]]
    want = collections.Counter((i, len(r[1].encode()) + 1, crc, s) for r, (i, crc, s) in zip(kept, shards_of([r[:4] for r in kept]), strict=True))
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in got) == want
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_tables_go_when_their_block_ends(spark):
    from siltstone.llm.common import Tables, clear, shared_dir

    count = lambda: len(list(pathlib.Path(shared_dir(spark).removeprefix("file://")).glob("*")))
    materialize(spark.range(3))
    n = count()
    with Tables(spark) as tables:
        assert tables.table(spark.range(5)).count() == 5
        out = tables.keep(spark.range(7))
        assert count() == n + 2
    assert count() == n + 1 and out.count() == 7
    clear(spark)
    assert count() == 0


def test_known_hashes_are_bounded():
    from siltstone.llm.common import Known

    known = Known(1, room=100)
    for k in range(50):
        known.add(np.arange(10 * k, 10 * k + 10, dtype=np.uint64), np.arange(10) + k)
        known.find(np.arange(5, dtype=np.uint64))
    ok, value = known.find(np.array([3, 7, 499, 420], np.uint64))
    assert len(known.hashes) == 100 and ok.tolist() == [True, False, True, True] and value[0].tolist()[0] == 3 and value[0].tolist()[2:] == [9 + 49, 42]


def test_buckets_are_handed_over_whole():
    import pyarrow as pa

    from siltstone.llm import common

    rng = random.Random(3)
    buckets = sorted(rng.randrange(40) for _ in range(500))
    batches, at = [], 0
    while at < len(buckets):
        n = rng.randint(0, 30)
        batches.append(pa.RecordBatch.from_arrays([pa.array(buckets[at : at + n], pa.int32()), pa.array([b"x" * 100] * len(buckets[at : at + n]), pa.binary())], ["bucket", "data"]))
        at += n
    calls = []

    def step(it):
        calls.append([b for batch in it for b in batch.column(0).to_pylist()])
        yield from ()

    with pytest.MonkeyPatch.context() as m:
        m.setattr(common, "BUCKET_BYTES", 2000)
        list(common._whole_buckets(iter(batches), step))
    assert sum(calls, []) == buckets and len(calls) > 5 and max(len(c) for c in calls) < 120
    assert all(a[-1] != b[0] for a, b in itertools.pairwise(calls))
