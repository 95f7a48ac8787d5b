"""Main text: the method against plain loops, and pages on which the clusters decide."""

import math

import numpy as np
import pytest

from bytesift.llm import html

WORDS = "river stone quiet under morning letter window garden walked answer because little between".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS, n)).capitalize() + "."


def brute_upper(lines):
    """Ratio, weight, Gaussian window and two clusters, number by number."""

    def split(values):
        t = sum(values) / len(values)
        for _ in range(100):
            low, high = [v for v in values if v < t], [v for v in values if v >= t]
            if not low or not high:
                return min(values)
            new = (sum(low) / len(low) + sum(high) / len(high)) / 2
            if abs(new - t) < 1e-9:
                break
            t = new
        return t

    ratio = [chars / tags for _, chars, tags, *_ in lines]
    weight = [(4 if line[4] else 1) / (64 if line[5] else 1) for line in lines]
    reach = round(3 * html.SIGMA)
    smooth = []
    for i in range(len(lines)):
        near = [(math.exp(-(((j - i) / html.SIGMA) ** 2) / 2), ratio[j]) for j in range(max(0, i - reach), min(len(lines), i + reach + 1))]
        smooth.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    value, alone = [s * w for s, w in zip(smooth, weight)], [r * w for r, w in zip(ratio, weight)]
    a, b = split(value), split(alone)
    return [v >= a or u >= b for v, u in zip(value, alone)]


def brute_text(lines):
    up = brute_upper(lines)
    regions = {line[3] for line, u in zip(lines, up) if u}
    articles = {line[4] for line, u in zip(lines, up) if u and line[4]}
    first, last = up.index(True), len(up) - 1 - up[::-1].index(True)
    out = []
    for i, (text, chars, _, region, article, suspect, linked) in enumerate(lines):
        own = region in regions or (not suspect and (article in articles or first <= i <= last))
        if own and (article or linked <= 0.6 * chars):
            out.append(text)
    return "\n".join(out)


def given_page(rng, article="article", ad=' class="ad"'):
    """A page as the given tables have them, and its article."""
    menu = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in rng.choice(WORDS, 6))
    blocks = [sentence(rng, rng.integers(3, 12))] + [sentence(rng, rng.integers(1, 90)) for _ in range(rng.integers(3, 20))]
    body = f"<h1>{blocks[0]}</h1>" + "".join(f"<p><b>{b}<br>" if rng.random() < 0.2 else f"<p>{b}</p>" for b in blocks[1:])
    page = f'<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul>{menu}</ul></nav><!-- ad --><div{ad}>{sentence(rng, rng.integers(3, 14))}</div><{article}>{body}</{article}><footer>&copy; {sentence(rng, 12)}</footer></body></html>'
    return page, "\n".join(blocks)


def random_page(rng):
    out = []
    for _ in range(rng.integers(1, 14)):
        kind = rng.choice(["p", "list", "div", "article", "ad", "table", "text"])
        text = sentence(rng, rng.integers(1, 60))
        out.append(
            {
                "p": f"<p>{text}</p>",
                "list": "<ul>" + "".join(f"<li><a href=x>{w}</a>" for w in rng.choice(WORDS, 4)) + "</ul>",
                "div": f"<div><p>{text}</p><div>{sentence(rng, 3)}</div></div>",
                "article": f"<article><h2>{sentence(rng, 4)}</h2><p>{text}</article>",
                "ad": f"<div class='ad box'>{text}</div>",
                "table": f"<table><tr><td>{text}<td>{sentence(rng, 2)}</table>",
                "text": text,
            }[kind]
        )
    return "<body>" + "".join(out) + "</body>"


def test_method_equals_plain_loops():
    rng = np.random.default_rng(0)
    for _ in range(300):
        page = random_page(rng)
        parser = html.Lines()
        parser.feed(page)
        parser.close()
        assert html.upper_cluster(parser.lines).tolist() == brute_upper(parser.lines)
        assert html.main_text(page) == brute_text(parser.lines)


def test_the_clusters_decide_on_pages_as_given():
    rng = np.random.default_rng(1)
    pages = [given_page(rng) for _ in range(200)]
    assert all(html.main_text(p) == want for p, want in pages)
    assert all(html.main_text(p, clusters=False) != want for p, want in pages)


@pytest.mark.parametrize(("article", "ad"), [("div", ' class="ad"'), ("article", ""), ("div", "")])
def test_marks_are_no_more_than_a_hint(article, ad):
    rng = np.random.default_rng(2)
    pages = [given_page(rng, article, ad) for _ in range(200)]
    assert sum(html.main_text(p) == want for p, want in pages) >= 185


def test_a_teaser_in_an_article_element_does_not_displace_the_story():
    rng = np.random.default_rng(3)
    story = [sentence(rng, 60) for _ in range(5)]
    page = "<body><div class=top>Site</div><div id=story>" + "".join(f"<p>{s}</p>" for s in story) + "</div>" + "<article class=teaser><a href=1>Read this too</a></article>" * 3 + "<article><h3>Also</h3></article></body>"
    assert html.main_text(page) == "\n".join(story)


def test_very_long_and_broken_pages():
    rng = np.random.default_rng(4)
    blocks = [sentence(rng, 40) for _ in range(5000)]
    assert html.main_text("<article>" + "".join(f"<p>{b}" for b in blocks)) == "\n".join(blocks)
    assert html.main_text("<div><p>" + blocks[0] + "</div></div></b><p") == blocks[0]
