"""Operators against plain versions of the same rule."""

import html
import itertools
import random

import numpy as np
import pytest

from quillmatch.llm import html_paths as H
from quillmatch.llm import langid_mixture as L
from quillmatch.llm import toxicity_gru as G

# HTML: pages of blocks whose paths are known, scored and chosen by plain loops.


def page_of(r):
    """A page without names for its parts, and its blocks as (path, element numbers around, text, linked characters)."""
    blocks, out, number = [], [], itertools.count()

    def words():
        return " ".join(r.choice(["some", "text.", "and", "more,", "of", "it"]) for _ in range(r.randint(1, 25)))

    def element(path, around, depth):
        name = r.choice(["div", "section", "p"]) if depth < 4 else "p"
        kind = r.choice(["", "x1", "y2"])
        step = f"{name}.{kind}" if kind else name
        out.append(f'<{name} class="{kind}">' if kind else f"<{name}>")
        here, inside = [*path, step], [*around, next(number)]
        if name == "p":
            text, linked = words(), r.random() < 0.3
            out.append(f"<a href=x>{html.escape(text)}</a>" if linked else html.escape(text))
            blocks.append((tuple(here), tuple(inside), text, len("".join(text.split())) if linked else 0))
        else:
            for _ in range(r.randint(1, 4)):
                element(here, inside, depth + 1)
        out.append(f"</{name}>")

    for _ in range(r.randint(1, 6)):
        element([], [], 0)
    return "".join(out), blocks


def plain_scores(blocks, inside=None):
    by = {}
    for b in blocks:
        by.setdefault(b[0], []).append(b)
    marks = lambda t: sum(c in ".,;:!?" for c in t)
    text = [sum(len(x[2]) for x in by[b[0]]) / len(by[b[0]]) for b in blocks]
    mark = [sum(marks(x[2]) for x in by[b[0]]) / len(by[b[0]]) for b in blocks]

    def smooth(x):
        if len(x) < 5:
            return x
        weight = {d: np.exp(-0.5 * d * d) for d in range(-2, 3)}
        return [sum(weight[d] * x[i + d] for d in weight if 0 <= i + d < len(x)) / sum(weight[d] for d in weight if 0 <= i + d < len(x)) for i in range(len(x))]

    fused = []
    for i, (t, m) in enumerate(zip(smooth(text), smooth(mark))):
        own = by[blocks[i][0]]
        free = max(0.15, 1 - sum(x[3] for x in own) / sum(len(x[2]) for x in own)) ** 2
        fused.append((t * (1 + m)) ** 0.5 * free * (1 if inside is None or inside[i] else H.OTHER))
    return [np.mean([f for f, x in zip(fused, blocks) if x[0] == b[0]]) for b in blocks]


def plain_choice(blocks):
    weight = [s * len(b[2]) for s, b in zip(plain_scores(blocks), blocks)]
    best, depth = set(range(len(blocks))), 0
    while True:
        inner = {}
        for i in best:
            if len(blocks[i][1]) > depth:
                inner.setdefault(blocks[i][1][depth], set()).add(i)
        good = [own for own in inner.values() if len(own) > 1 and sum(weight[i] for i in own) >= 0.7 * sum(weight)]
        if not good:
            break
        best, depth = good[0], depth + 1
    score = plain_scores(blocks, [i in best for i in range(len(blocks))])
    self_weight = [s * len(b[2]) for s, b in zip(score, blocks)]
    level = sum(s * w for s, w in zip(score, self_weight)) / sum(self_weight)
    return [s >= H.PLAIN_SHARE * level for s in score]


@pytest.mark.parametrize("seed", range(40))
def test_pages_against_plain_path_ratios(seed):
    page, blocks = page_of(random.Random(seed))
    found = H.read(page)
    assert [b.text for b in found.blocks] == [b[2] for b in blocks]
    assert np.allclose(H.scores(found)[[b.path for b in found.blocks]], plain_scores(blocks))
    assert H.extract(page) == "\n".join(b[2] for b, ok in zip(blocks, plain_choice(blocks)) if ok)


def plain_named(blocks, bars):
    """Which of ``blocks`` (all in a named article) and ``bars`` (in menus outside it) stay, by loops over paths."""
    top = ("article",)
    every = [((*top, *b[0]), b[2], b[3]) for b in blocks] + [(b[0], b[2], b[3]) for b in bars]
    facts = {}
    for path, text, linked in every:
        facts.setdefault(path, []).append((len(text), sum(c in ".,;:!?" for c in text), linked))
    mean = lambda own: [sum(x[k] for x in own) / len(own) for k in (0, 1)]
    under = lambda path: [x for p, own in facts.items() if p[: len(path)] == path for x in own]

    def ratio(path):
        own = mean(facts.get(path) or under(path))
        if path == top:
            return mean(under(top))
        return [(a + b) / 2 for a, b in zip(own, ratio(path[:-1]))] if path[:1] == top else own

    order = [x for x in every if x[0][:1] != top] + [x for x in every if x[0][:1] == top]  # menus come first
    weight = {d: np.exp(-0.5 * d * d) for d in range(-2, 3)}
    smooth = lambda x, i: x[i] if len(x) < 5 else sum(weight[d] * x[i + d] for d in weight if 0 <= i + d < len(x)) / sum(weight[d] for d in weight if 0 <= i + d < len(x))
    text, marks = zip(*[ratio(x[0]) for x in order])
    fused = []
    for i, (path, _, _) in enumerate(order):
        own = facts[path]
        free = max(0.15, 1 - sum(x[2] for x in own) / sum(x[0] for x in own)) ** 2
        fused.append((smooth(text, i) * (1 + smooth(marks, i))) ** 0.5 * free * (1 if path[:1] == top else H.BAR))
    score = [np.mean([f for f, y in zip(fused, order) if y[0] == x[0]]) for x in order]
    mass = [s * len(x[1]) for s, x in zip(score, order)]
    level = sum(s * w for s, w in zip(score, mass)) / sum(mass)
    return [x[1] for s, x in zip(score, order) if s >= H.NAMED_SHARE * level]


@pytest.mark.parametrize("seed", range(60))
def test_pages_with_a_named_article(seed):
    r = random.Random(1000 + seed)
    page, blocks = page_of(r)
    menus, bars = "", []
    for k in range(r.randint(1, 4)):
        linked = r.random() < 0.7
        text = " ".join(r.choice(["home", "news,", "about", "all."]) for _ in range(r.choice([1, 1, 2, 3])))
        menus += f'<nav class="n{k % 2}">' + (f"<a href=x>{text}</a>" if linked else text) + "</nav>"
        bars.append(((f"nav.n{k % 2}",), (), text, len("".join(text.split())) if linked else 0))
    found = H.read(f"{menus}<article>{page}</article>")
    if 2 * sum(max(0, len(b[2]) - b[3]) for b in blocks) < sum(max(0, len(b[2]) - b[3]) for b in blocks) + H.OTHER * sum(max(0, len(b[2]) - b[3]) for b in bars):
        return  # nothing but links in it: the name does not count
    assert [b.text for b in found.blocks] == [b[2] for b in bars] + [b[2] for b in blocks]
    assert H.extract(f"{menus}<article>{page}</article>").split("\n") == plain_named(blocks, bars)


def test_ratios_decide(monkeypatch):
    """With the same ratios for every path the menus stay; with their own, what reads like the article stays whatever it is called."""
    page = f'<body><nav><a href=1>Home</a></nav><div class="breadcrumb"><a href=2>News</a></div><article>{TEXT}</article></body>'
    assert H.extract(page) == WANT
    prose = f'<body><div class="search"><p>Found here, it reads like all else.</p></div><article>{TEXT}</article></body>'
    assert H.extract(prose) == f"Found here, it reads like all else.\n{WANT}"
    same = lambda page, top=None: tuple(np.ones(len(page.path_parent)) for _ in range(3))
    monkeypatch.setattr(H, "path_ratios", same)
    assert H.extract(page) == f"Home\nNews\n{WANT}"


TEXT = "<p>A first paragraph, with some text.</p><p>A second one, and more.</p>"
WANT = "A first paragraph, with some text.\nA second one, and more."
NAV = "<nav><a href=1>x</a> <a href=2>y</a></nav>"


@pytest.mark.parametrize(
    "page",
    [
        f'<body>{NAV}<article class="post has-sidebar">{TEXT}</article></body>', f'<body><div id="page" class="site with-sidebar">{NAV}{TEXT}<div class="comments"><p>I agree, and more text, really.</p></div></div></body>',
        f'<body>{NAV}<div class="post share">{TEXT}</div></body>', f'<body>{NAV}<article class="research search-engine-news">{TEXT}</article></body>', f'<body>{NAV}<main><section class="health-related">{TEXT}</section></main></body>',
        f'<body><form action=x>{NAV}<div>{TEXT}<input value=z><label>Mail</label></div><div class="sidebar"><p>Elsewhere, other text.</p></div></form></body>',
        f"<body><article>{TEXT}<aside><p>{'A long aside, with punctuation. ' * 9}</p></aside></article><div><p>Unnamed, outside. With text, here.</p></div></body>",
    ],
)
def test_names_alone_delete_nothing(page):
    assert H.extract(page) == WANT


def test_inside_an_article():
    """Tables and lists of an article follow what is around them; formulas stay in their paragraph."""
    assert H.extract(f"<body><article>{TEXT}<ul><li>One</li></ul><table><tr><td>5</td><td>6</td></tr></table></article></body>") == f"{WANT}\nOne\n5\n6"
    assert H.extract("<article><p>Since <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds, done.</p></article>") == "Since x=2 holds, done."


def test_deep_nesting_is_quick():
    import time

    start = time.perf_counter()
    assert H.extract("".join(f"<div>text, {i} and more" for i in range(4000))).count("\n") > 2000
    assert time.perf_counter() - start < 3


# Toxicity: the vectorised network against a loop over windows, words and units.


def plain_logit(m, words, at):
    h, d = G.HIDDEN, len(m.p["W"][0])
    sig = lambda x: 1 / (1 + np.exp(-x))
    own, flat, sizes = m.known(words)
    x, start = [], 0
    for k, n in enumerate(sizes):
        x.append([*m.p["E"][own[k]], *(sum(m.p["C"][g] for g in flat[start : start + n]) / n**0.5)])
        start += n
    states = []
    for k in (0, 1):
        s = [0.0] * h
        for t in at if k == 0 else at[::-1]:
            g = [sum(x[t][i] * m.p["W"][k][i][c] for i in range(d)) + m.p["B"][k][c] for c in range(3 * h)]
            u = m.p["U"][k]
            z = [sig(g[c] + sum(s[i] * u[i][c] for i in range(h))) for c in range(h)]
            r = [sig(g[h + c] + sum(s[i] * u[i][h + c] for i in range(h))) for c in range(h)]
            new = [np.tanh(g[2 * h + c] + sum(r[i] * s[i] * u[i][2 * h + c] for i in range(h))) for c in range(h)]
            s = [s[c] + z[c] * (new[c] - s[c]) for c in range(h)]
            states.append((k, s, np.exp(sum(s[c] * m.p["a"][k][c] for c in range(h)))))
    total = sum(e for *_, e in states)
    return sum(e / total * sum(s[c] * m.p["o"][k][c] for c in range(h)) for k, s, e in states) + m.p["c"][0]


def test_scores_against_plain_loops():
    m = G.Model.new({"bad": 1, "fine": 2}, 3)
    r = random.Random(4)
    texts = [" ".join(r.choice(["bad", "fine!", "Ünder", "x", "word", "..."]) for _ in range(n)) for n in (1, 5, 32, 33, 49, 70)]
    got = G.score_texts(m, G.WordTable(m.projected, 6 * G.HIDDEN), texts)
    for text, score in zip(texts, got):
        words, odds = text.split(), 0.0
        for a in range(0, max(len(words) - G.WINDOW + G.STRIDE - 1, 0) // G.STRIDE * G.STRIDE + 1, G.STRIDE):
            odds += np.exp(plain_logit(m, words, list(range(a, min(a + G.WINDOW, len(words)))))) ** G.POWER
        odds **= 1 / G.POWER
        assert abs(score - odds / (1 + odds)) < 1e-4


def test_gradient_in_chunks():
    m = G.Model.new({"a": 1}, 1)
    seen, r = m.known(["a", "bc", "dEf", "x!"]), np.random.default_rng(0)
    at, owner = r.integers(0, 4, (9, 6)), np.array([0, 0, 0, 0, 0, 1, 1, 2, 2])
    mask = (np.arange(6)[None, :] < r.integers(1, 7, 9)[:, None]).astype(np.float32)
    one, many = (G.gradient(m, seen, at, mask, owner, np.array([1.0, 0.0, 1.0], np.float32), chunk) for chunk in (100, 2))
    assert abs(one[0] - many[0]) < 1e-5
    for k, g in one[1].items():
        assert np.allclose(*(x[1] if isinstance(x, tuple) else x for x in (g, many[1][k])), atol=1e-5)


# Languages: the chosen set against all sets.


def test_sets_of_languages_against_all_sets():
    r = np.random.default_rng(6)
    langs, rows, doc, truth = 6, [], [], []
    for d in range(60):
        own = r.choice(langs, r.integers(1, 6), replace=False)  # up to five languages in one document
        for k in own:
            p = r.uniform(0.001, 0.02, (int(r.integers(60, 90)), langs))
            p[:, k] = r.uniform(0.5, 1, len(p))
            rows.append(p)
            doc += [d] * len(p)
        truth.append(len(own))
    p, doc = np.concatenate(rows).astype(np.float32), np.array(doc)
    pred, share, size = L.identify(p, doc, 60)
    for d in range(60):
        own = p[doc == d]
        best = None
        for k in range(1, langs + 1):
            for some in itertools.combinations(range(langs), k):
                allowed = np.isin(np.arange(langs), some)[None, :]
                mix, like = L.mixtures(own, np.zeros(len(own), int), 1, allowed, 30)
                value = like[0] - L.PENALTY * (k - 1) * np.log(len(own))
                if best is None or value > best[0]:
                    best = (value, k, mix[0])
        assert size[d] == best[1] == truth[d] and best[2][pred[d]] > best[2].max() - 0.02 and abs(share[d] - best[2].max()) < 0.02
