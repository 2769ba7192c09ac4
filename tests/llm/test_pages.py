"""Page templates against a brute-force deduction, and hosts whose boxes have no telling names."""

import random
from collections import Counter, defaultdict

import pytest

from geoloom.llm import page_templates
from geoloom.llm.page_templates import SHARE, SUPPORT, main_text, read_page, slots

PAGES = "page_id long, url string, html string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def extracted(spark, pages):
    return {r.page_id: r.text for r in page_templates.extract(spark.createDataFrame(pages, PAGES)).collect()}


def brute_template(pages):
    """token -> (varying characters or None, template texts) of one host, from its pages in a list."""
    read = [read_page(html) for html in pages]
    held = [(tokens | {"": 1}, slots(tokens, blocks)) for tokens, blocks in read]
    out = {}
    for path in {p for tokens, _ in held for p in tokens}:
        own = [(tokens[path], slot[path]) for tokens, slot in held if path in tokens]
        if len(own) >= max(min(SUPPORT, len(pages)), -(-len(pages) // SHARE)):
            texts = Counter(key for _, (key, chars) in own if chars)
            same = {key for key, n in texts.items() if n >= SUPPORT and 2 * n >= len(own)}
            varying = sum(chars for _, (key, chars) in own if key not in same) / len(own)
            # tokens of one vector are one class: it is a frame if all of them come once
            vector = tuple(tokens.get(path, 0) for tokens, _ in held)
            out[path] = (varying, frozenset(same), vector)
    frames = defaultdict(lambda: True)
    for _, _, vector in out.values():
        frames[vector] &= max(vector) == 1
    return {path: (varying if frames[vector] else None, same) for path, (varying, same, vector) in out.items()}


def test_templates_against_brute_force(spark):
    rng = random.Random(4)
    pages = []
    for host in range(4):
        for i in range(20):
            layout = ("a", "b", "c")[i % 3] if host % 2 else "a"
            items = "".join(f"<div class=item>{words(rng, 3)}</div>" for _ in range(rng.randint(1, 4)))
            body = f"<h1>{words(rng, 4)}</h1>" + "".join(f"<p>{words(rng, 20)}</p>" for _ in range(rng.randint(1, 5)))
            article = f"<article>{body}</article>" if host == 2 else f"<div class=l{layout}>{body}</div>"
            pages.append((len(pages), f"http://h{host}/{i}", f"<body><div class=top>{words(random.Random(host), 6)}</div>{article}<div class=more>{items}</div></body>"))
    got = {r.host: r for r in page_templates.templates(spark.createDataFrame(pages, PAGES)).collect()}
    texts = extracted(spark, pages)
    for host in range(4):
        own = [p for p in pages if p[1].startswith(f"http://h{host}/")]
        want = brute_template([html for _, _, html in own])
        found = {t["path"]: (t["varying"] if c["frame"] else None, frozenset(t["same"])) for c in got[f"h{host}"]["classes"] for t in c["tokens"]}
        assert found == want and got[f"h{host}"]["n_pages"] == 20
        for key, _, html in own:
            assert texts[key] == main_text(html, want)
            blocks = [b[1] for b in read_page(html)[1] if "/div.l" in b[0] or "/article" in b[0]]
            assert texts[key] == "\n".join(blocks)


@pytest.mark.parametrize("inside", [False, True])
def test_a_repeated_box_without_a_telling_name_goes(spark, inside):
    rng = random.Random(1)
    pages, want = [], {}
    for i in range(6):
        own = words(rng, 30)
        boxes = f"<div class=zz>the same on every page of this host</div><div class=qq>{own}</div>"
        pages.append((i, f"http://h/{i}", f"<html><body>{f'<article>{boxes}</article>' if inside else boxes}</body></html>"))
        want[i] = own
    assert extracted(spark, pages) == want


def test_a_box_of_the_article_stays_whatever_its_name(spark):
    rng = random.Random(2)
    pages, want = [], {}
    for i in range(6):
        head, own = words(rng, 4), words(rng, 25)
        pages.append((i, f"http://h/{i}", f"<html><body><article><h1>{head}</h1><div class=product-search-results>{own}</div></article></body></html>"))
        want[i] = f"{head}\n{own}"
    assert extracted(spark, pages) == want


def test_a_passage_that_articles_share_stays(spark):
    rng = random.Random(3)
    shared = words(rng, 60)
    pages = [(i, f"http://h/{i}", f"<body><div class=a><h1>{i} {words(rng, 3)}</h1><p>{shared}</p></div></body>") for i in range(8)]
    assert all(text.endswith("\n" + shared) for text in extracted(spark, pages).values())
    copies = [(i, f"http://h/{i}", f"<body><article><div class=x>{shared}</div></article></body>") for i in range(8)]
    assert set(extracted(spark, copies).values()) == {shared}


def test_comments_records_and_landmarks(spark):
    rng = random.Random(5)
    pages, want = [], {}
    for i in range(9):
        own = [words(rng, 40), words(rng, 40)]
        comments = "".join(f"<article>{words(rng, 5)}</article>" for _ in range(i % 4))
        pages.append((i, f"http://h/{i}", f"<body><header>site</header><article><header><h1>{i}</h1></header><p>{own[0]}<p>{own[1]}<aside>{words(rng, 9)}</aside>{comments}</article><div role=complementary>{words(rng, 50)}</div></body>"))
        want[i] = "\n".join([str(i), *own])
    assert extracted(spark, pages) == want


def test_pages_without_a_host_are_read_alone(spark):
    # the same frame on unrelated pages is no template: nothing of it goes
    pages = [(i, url, f"<body><div class=a>shared words of a frame</div><div class=b>page {i}</div></body>") for i, url in enumerate([None, None, "x", "x", "y"])]
    assert all(text.startswith("shared words") for text in extracted(spark, pages).values())


def test_odd_pages(spark):
    rng = random.Random(6)
    long_text = words(rng, 200_000)
    pages = [
        (0, None, None), (1, "http://h/1", ""), (2, "http://h/2", None), (None, "http://h/3", "<p>a&nbsp;b</p>"),
        (4, "http://h/4", f"<article><p>{long_text}</article>"), (4, "http://h/4", f"<article><p>{long_text}</article>"), (5, "http://h/5", "<<<>>&&<p"),
    ]
    rows = spark.createDataFrame([(*p, "kept", "clash") for p in pages], PAGES + ", host string, text string")
    got = page_templates.extract(rows).collect()
    assert [r.text for r in got if r.page_id == 4] == [long_text] * 2 and all(r.host == "kept" for r in got)
    assert {r.page_id: r.text for r in got if r.page_id in (0, 1, 2)} == {0: "", 1: "", 2: ""}
    assert [r.text for r in got if r.page_id is None] == ["a b"] and len(got) == 7
    assert page_templates.extract(rows.limit(0)).collect() == []


def test_a_sibling_of_the_main_text_stays(spark):
    """Without an article element, what stands beside the largest token goes only if it is template text, a record or apart."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    text = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], {}
    for i in range(6):
        a, b, replies = text(60), text(10), [text(4) for _ in range(3)]
        comments = "".join(f'<div class="reply">{r}</div>' for r in replies)
        html = f'<div class="top">Our site</div><div class="c"><div class="a">{a}</div><div class="b">{b}</div></div><div class="replies">{comments}</div><footer>{text(8)}</footer>'
        rows.append((i, f"http://h.com/{i}", html))
        want[i] = f"{a}\n{b}"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in page_templates.extract(pages).collect()} == want
