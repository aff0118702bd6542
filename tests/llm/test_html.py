"""Main text of generated pages whose articles are known, the vote against plain counting, and pages that nest deeply."""

import random
import time
from collections import Counter

from tapewatch.llm import html

FRAMES = ['<div class="post-content">{}</div>', "<article>{}</article>", '<main class="page{n}">{}</main>', '<section><div class="story body{n}">{}</div></section>']
AROUND = ['<nav><ul><li><a href="/">Home</a><li>News</ul></nav>', '<aside class="sidebar"><p>Read these other stories as well</p></aside>', "<script>var p = '<p>code</p>';</script>",
          '<div class="cookie-notice">We keep small files on your machine.</div>', '<div class="ad banner">Buy one now, pay later.</div>', "<style>p { color: red }</style>",
          '<form><input name="q"><label>Find</label></form>', '<div id="comments"><p>A reader says something rather long about all this.</p></div>', "<!-- <p>no</p> -->",
          "<footer><p>All rights reserved &copy; 2024</p></footer>"]


def article(rng):
    raw, plain = [], []
    for _ in range(rng.randrange(3, 7)):
        words = [f"{rng.choice('abcdefgh')}{rng.randrange(10 ** 5)}" for _ in range(rng.randrange(12, 30))]
        raw.append("<p>" + (" \n\t ".join(words[:5]) + " &amp; <b>" + " ".join(words[5:]) + "</b>&nbsp;") + "</p>")
        plain.append(" ".join([*words[:5], "&", *words[5:]]))
    return "".join(raw), "\n".join(plain)


def test_articles_of_generated_pages(spark):
    rng, rows, expected = random.Random(11), [], {}
    for host, frame in enumerate(FRAMES):
        for k in range(9):
            raw, plain = article(rng)
            before, after = rng.sample(AROUND, 3), rng.sample(AROUND, 3)
            page = f"<html><head><title>t</title></head><body>{''.join(before)}{frame.replace('{n}', str(k)).format(raw)}{''.join(after)}</body></html>"
            rows.append((len(rows), f"https://site{host}.example/{k}", page))
            expected[len(rows) - 1] = plain
    got = html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == expected


def test_votes_against_counting(spark):
    """A host's paths are those with a fiftieth of its votes, most first; a page takes the first that it has."""
    rng, rows = random.Random(5), []
    for k in range(150):  # one path for most pages, one for some, and pages with paths of their own
        name = "content" if k % 3 else "story" if k % 2 else f"text {''.join(rng.choices('qwxyz', k=8))}"
        more = '<div class="content"><p>Short note.</p></div>' if k % 5 == 0 and name != "content" else ""
        rows.append((k, "http://one.example/x" if k % 10 else None, f'<body><div class="{name}">{article(rng)[0]}</div>{more}</body>'))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    votes: dict[str, Counter] = {}
    for _, url, page in rows:
        votes.setdefault("one.example" if url else "", Counter())[html.choose(html.parsed(page)).written_path()] += 1
    paths = {h: [p for p, n in sorted(c.items(), key=lambda x: (-x[1], x[0])) if n * 50 >= c.total()] for h, c in votes.items()}
    assert {r.host: r.paths for r in html.host_paths(df).collect()} == paths and all(len(p) <= 50 for p in paths.values())
    got = {r.page_id: (r.text, r.path) for r in html.extract_main_text(df).collect()}
    assert got == {k: html.extract(page, paths["one.example" if url else ""]) for k, url, page in rows}
    assert any(path == "body>div.content" and "content" not in rows[k][2].split(">")[1] for k, (_, path) in got.items())  # the others' vote


def test_deep_pages_cost_linear_time():
    n = 100_000
    start = time.process_time()
    assert html.extract("<div>" * n + "text", []) == ("text", ">".join(["div"] * n))
    assert html.extract("<div>" + "<span>" * n + "<li>x</li>" * 1000, [])[0] == "\n".join("x" * 1000)
    assert html.extract("<i>" * n + "</b>" * n + "q", [])[0] == "q"
    assert html.extract("<form>" * n + "hello " + "</form>" * n, [])[0] == "hello"
    assert html.extract("<div>a" * 20_000, [f"body>div.x{k}" for k in range(50)])[0].count("a") > 10_000
    assert time.process_time() - start < 60
