"""Trains the block labeller on pages that are made up here: ``python -m millrace.llm.html_train [FILE]``.

The pages have no source but this file: random layouts, names of classes and words, with the blocks of the article known
by marks that are taken out before reading. The same seed gives the same weights.
"""

from __future__ import annotations

import random
import sys

import numpy as np

from .html_blocks import Block, blocks
from .html_labeller import STATE, WEIGHTS, Input, fresh, logits, lstm, sigmoid, vectors

#: Ends a text of the article while training.
MARK = "\ue000"

_SYLLABLES = "an be ca de en fi go ha is jo ke la me no or pa que re st ti un ver wh ou tion ment keit ción eau sch é ü ñ".split()
_MENU = "home about contact login news blog shop search archive privacy terms help sitemap startseite kontakt impressum accueil inicio".split()
_SAID = {
    "ad": "advertisement sponsored buy now offer sale discount free shipping anzeige publicité anuncio",
    "notice": "we use cookies accept privacy policy subscribe newsletter sign up consent javascript required",
    "comments": "reply comment says posted by user ago likes report",
    "footer": "© copyright all rights reserved powered by terms privacy 2024",
    "share": "share tweet email facebook print follow us",
    "related": "related popular more latest recommended read next",
}
_CLASSES = {
    "ad": "ad ads advert advertisement ad-banner sponsored promo banner google-ad adsbox ad-slot".split(),
    "notice": "cookie cookie-notice consent notice alert popup modal newsletter subscribe overlay gdpr message".split(),
    "comments": "comments comment-list comments-area disqus replies responses discussion comment user-comments".split(),
    "footer": "footer site-footer bottom copyright colophon legal foot".split(),
    "header": "header site-header masthead top topbar branding logo page-header".split(),
    "menu": "menu nav navbar navigation main-nav breadcrumbs breadcrumb tabs links toc-menu".split(),
    "sidebar": "sidebar side widget widget-area aside right-column rail secondary".split(),
    "share": "share social share-buttons sharing social-links".split(),
    "related": "related related-posts more-stories recommended popular see-also".split(),
    "form": "form search search-form login contact-form signup".split(),
    "main": "content main article post entry story post-content article-body entry-content body-text main-content text page prose".split(),
    "plain": "wrap container row col box section inner block grid wrapper layout".split(),
}


class Maker:
    """Makes one page after another."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 3)))

    def words(self, low: int, high: int, junk: bool = False) -> str:
        style = self.r.random() if junk else 1
        out = [self.word() for _ in range(self.r.randint(low, high))]
        if style < 0.15:
            out = [w.upper() + "!!" for w in out]
        elif style < 0.3:
            out = [w + self.r.choice(["***", "$$$", "###", "%%%", "&amp;&amp;&amp;"]) for w in out]
        elif self.r.random() < 0.8:
            out[0] = out[0].capitalize()
            for k in range(len(out) - 1):
                if self.r.random() < 0.12:
                    out[k] += self.r.choice(",,.;")
            out[-1] += self.r.choice("....!?") if self.r.random() < 0.9 else ""
        return " ".join(out)

    def link(self, text: str) -> str:
        return f'<a href="/{self.word()}">{text}</a>'

    def open(self, name: str, kind: str, chance: float = 0.8) -> str:
        if self.r.random() > chance:
            return f"<{name}>"
        return f'<{name} {self.r.choice(["class", "class", "class", "id"])}="{self.r.choice(_CLASSES[kind])}">'

    def main_block(self) -> str:
        r, pick = self.r, self.r.random()
        text = lambda low, high: self.words(low, high, True) + MARK
        if pick < 0.62:
            body = self.words(1, 70, True)
            if r.random() < 0.25:
                body = f"{body} {r.choice([self.link(self.word()), f'<b>{self.word()}</b>', f'<em>{self.word()}</em>'])} {self.words(1, 20)}"
            if r.random() < 0.12:
                return f"<p><b>{body}{MARK}<br>"  # never closed
            return f"<p>{body}{MARK}" + "</p>" * (r.random() < 0.95)
        if pick < 0.72:
            return f"<h{r.choice('1234')}>{text(1, 9)}</h2>" if r.random() < 0.1 else (lambda h: f"<h{h}>{text(1, 9)}</h{h}>")(r.choice("1234"))
        if pick < 0.79:
            tag = r.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{self.link(self.words(1, 3)) + ' ' if r.random() < 0.15 else ''}{text(2, 18)}</li>" for _ in range(r.randint(1, 5))) + f"</{tag}>"
        if pick < 0.84:
            return f"<blockquote><p>{text(4, 40)}</p></blockquote>" if r.random() < 0.5 else f"<blockquote>{text(4, 40)}</blockquote>"
        if pick < 0.87:
            return f"<pre><code>{text(3, 20)}</code></pre>" if r.random() < 0.5 else f"<pre>{text(3, 20)}</pre>"
        if pick < 0.91:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{text(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>"
        if pick < 0.94:
            return f'<figure><img src="{self.word()}.png"><figcaption>{text(2, 14)}</figcaption></figure>'
        return f"<div>{text(5, 60)}</div>"

    def said(self, kind: str, low: int, high: int) -> str:
        out = self.words(low, high).split()
        if self.r.random() < 0.5 and kind in _SAID:
            cues = _SAID[kind].split()
            for _ in range(self.r.randint(1, 4)):
                out.insert(self.r.randrange(len(out) + 1), self.r.choice(cues))
        return " ".join(out)

    def menu(self) -> str:
        items = [self.link((self.r.choice(_MENU).capitalize() if self.r.random() < 0.4 else self.words(1, 3))) for _ in range(self.r.randint(2, 9))]
        body = "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if self.r.random() < 0.75 else " | ".join(items)
        if self.r.random() < 0.5:
            return f"{self.open('nav', 'menu', 0.3)}{body}</nav>"
        return f"{self.open('div', 'menu', 0.95)}{body}</div>"

    def boilerplate(self, kind: str, inside: bool = False) -> str:
        r = self.r
        if kind == "menu":
            return self.menu()
        if kind == "form":
            fields = "".join(f"<label>{self.words(1, 2)}</label><input name=x>" for _ in range(r.randint(1, 3)))
            return f"{self.open('form', 'form', 0.4)}{fields}<select><option>{self.word()}</option></select><button>{self.words(1, 2)}</button>" + (f"<p>{self.words(3, 12)}</p>" if r.random() < 0.4 else "") + "</form>"
        if kind == "comments":
            body = "".join(f"<{t}>{self.said(kind, 2, 5)}</{t}><p>{self.words(4, 50, True)}</p>" for t in [r.choice(["h4", "div", "span", "cite"])] * r.randint(1, 5))
            if r.random() < 0.4:
                body = f"<h3>{self.said(kind, 1, 3)}</h3>{body}"
            tag = r.choice(["section", "div", "div", "ul", "ol", "aside"])
            if tag in ("ul", "ol"):
                body = "".join(f"<li>{self.open('div', 'comments', 0.5)}<p>{self.words(4, 50, True)}</p></div></li>" for _ in range(r.randint(1, 5)))
            return f"{self.open(tag, 'comments', 1)}{body}</{tag}>"
        if kind == "footer":
            body = f"&copy; {self.word()}.example.com &middot; {self.said(kind, 1, 14)}" if r.random() < 0.6 else f"<p>{self.said(kind, 3, 16)}</p>"
            if r.random() < 0.3:
                body += self.menu()
            return f"<footer>{body}</footer>" if r.random() < 0.65 else f"{self.open('div', 'footer', 1)}{body}</div>"
        if kind == "header":
            body = f"<{(t := r.choice(['h1', 'div', 'p', 'h2']))}>{self.link(self.words(1, 4)) if r.random() < 0.5 else self.words(1, 6)}</{t}>"
            if r.random() < 0.5:
                body += self.menu()
            return f"<header>{body}</header>" if r.random() < 0.6 else f"{self.open('div', 'header', 1)}{body}</div>"
        if kind == "sidebar":
            body = "".join(f"<h3>{self.words(1, 4)}</h3>" + r.choice([f"<p>{self.words(4, 40)}</p>", self.list_of_links()]) for _ in range(r.randint(1, 3)))
            return f"{self.open('aside', 'sidebar', 0.5)}{body}</aside>" if r.random() < 0.6 else f"{self.open('div', 'sidebar', 1)}{body}</div>"
        if kind in ("share", "related"):
            tag = r.choice(["div", "section", "aside", "div"])
            return f"{self.open(tag, kind, 1)}" + (f"<h3>{self.said(kind, 1, 3)}</h3>" if r.random() < 0.6 else "") + self.list_of_links() + f"</{tag}>"
        body = self.said(kind, 2, 40)  # adverts and notices
        tag = r.choice(["div", "div", "div", "section", "aside", "p"])
        inner = body if tag == "p" or r.random() < 0.5 else f"<p>{body}</p>" + (f"<p>{self.words(2, 20)}</p>" if r.random() < 0.3 else "")
        return f"{self.open(tag, kind, 1)}{inner}" + (self.link(self.words(1, 3)) if r.random() < 0.3 else "") + f"</{tag}>"

    def list_of_links(self) -> str:
        return "<ul>" + "".join(f"<li>{self.link(self.words(1, 8))}</li>" for _ in range(self.r.randint(2, 6))) + "</ul>"

    def page(self) -> str:
        r = self.r
        title = self.words(2, 8, True)
        body = [self.main_block() for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8, 13, 20]))]
        if body and r.random() < 0.9:
            body.insert(0, f"<h1>{title}{MARK}</h1>")
        for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
            body.insert(r.randint(1, len(body)) if body else 0, self.boilerplate(r.choice(["ad", "ad", "notice", "share", "related", "sidebar", "form", "menu"])))
        if r.random() < 0.25:
            body.append(self.boilerplate("comments"))
        kind = r.random()
        if kind < 0.55:
            main = f"{self.open('article', 'main', 0.2)}{''.join(body)}</article>"
        elif kind < 0.7:
            main = f"{self.open('main', 'main', 0.2)}{''.join(body)}</main>"
        elif kind < 0.92:
            main = f"{self.open(r.choice(['div', 'section']), 'main', 1)}{''.join(body)}</div>"
        else:
            main = f"<div>{''.join(body)}</div>"
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            main = f"{self.open('div', 'plain', 0.8)}{main}</div>"
        kinds = ["menu", "header", "ad", "notice", "form", "sidebar"]
        before = [self.boilerplate(r.choice(kinds)) for _ in range(r.choice([0, 1, 2, 2, 3]))]
        if r.random() < 0.4:
            before = [f"<nav>{'<ul>'}{''.join(f'<li>{self.link(self.word())}</li>' for _ in range(r.randint(2, 8)))}</ul></nav>", *before]
        after = [self.boilerplate(r.choice(["comments", "related", "sidebar", "share", "ad", "form", "notice"])) for _ in range(r.choice([0, 0, 1, 2]))]
        if r.random() < 0.8:
            after.append(self.boilerplate("footer"))
        head = f'<head><meta charset="utf-8"><title>{title}</title><style>p{{}}</style><script>var t="</p>";</script></head>' if r.random() < 0.9 else ""
        out = f"<!DOCTYPE html><html>{head}<body>{''.join(before)}{main}{''.join(after)}</body></html>"
        return out[: r.randint(len(out) // 2, len(out))] if r.random() < 0.1 else out


def labelled(page: str) -> tuple[list[Block], np.ndarray]:
    """The blocks of a marked page without the marks, and whether each had one."""
    found = blocks(page)
    marks = np.array([MARK in b.text for b in found], np.float32)
    for b in found:
        b.words = b.text.replace(MARK, " ").split()
        b.text = " ".join(b.words)
    keep = [k for k, b in enumerate(found) if b.words]
    return [found[k] for k in keep], marks[keep]


def gradients(w: dict[str, np.ndarray], x: Input, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss of the blocks and its gradient, back through both directions."""
    e = vectors(w, x)
    tapes: dict[str, list] = {"l": [], "r": []}
    states = {d: lstm(w, d, e, x.mask, tapes[d]) for d in "lr"}
    both = np.concatenate([states["l"], states["r"], e], axis=2)
    p = sigmoid((both @ w["out"] + w["out_bias"])[:, :, 0])
    n = x.mask.sum()
    loss = float(-(x.mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / n)
    dz = ((p - y) * x.mask / n)[:, :, None]
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g["out"], g["out_bias"] = np.tensordot(both, dz, ((0, 1), (0, 1))), dz.sum((0, 1))
    d_both = dz @ w["out"].T
    de = d_both[:, :, 2 * STATE :].copy()
    for k, d in enumerate("lr"):
        dh_in = d_both[:, :, k * STATE : (k + 1) * STATE]
        dh, dc = np.zeros_like(dh_in[0]), np.zeros_like(dh_in[0])
        for t, h, c, i, f, o, new, s, m in reversed(tapes[d]):
            dh = dh + dh_in[t]
            da, keep_h, keep_c = dh * m, dh * (1 - m), dc * (1 - m)
            dcc = (dc * m) + da * o * (1 - s * s)
            dgates = np.concatenate([dcc * new * i * (1 - i), dcc * c * f * (1 - f), da * s * o * (1 - o), dcc * i * (1 - new * new)], axis=1)
            g[f"{d}h"] += h.T @ dgates
            g[f"{d}x"] += e[t].T @ dgates
            g[f"{d}b"] += dgates.sum(0)
            de[t] += dgates @ w[f"{d}x"].T
            dh, dc = dgates @ w[f"{d}h"].T + keep_h, dcc * f + keep_c
    flat = (de * (1 - e * e) * x.mask[:, :, None]).reshape(-1, de.shape[2])
    g["numbers"], g["bias"] = x.numbers.reshape(len(flat), -1).T @ flat, flat.sum(0)
    for kind, (cells, tokens, shares) in x.tokens.items():
        np.add.at(g[kind], tokens, flat[cells] * shares[:, None])
    return loss, g


def train(pages: int = 12000, epochs: int = 6, seed: int = 7, batch: int = 64) -> dict[str, np.ndarray]:
    maker, rng = Maker(seed), np.random.default_rng(seed)
    data = [x for x in (labelled(maker.page()) for _ in range(pages)) if x[0]]
    held, data = data[:500], data[500:]
    w = fresh(seed)
    m, v, step = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}, 0
    for epoch in range(epochs):
        total = 0.0
        order = sorted(rng.permutation(len(data)), key=lambda k: len(data[k][0]) // 4)
        chunks = [order[k : k + batch] for k in range(0, len(order), batch)]
        for k in rng.permutation(len(chunks)):
            chosen = [data[j] for j in chunks[k]]
            x = Input([c[0] for c in chosen])
            y = np.zeros((x.steps, x.pages), np.float32)
            for j, (_, marks) in enumerate(chosen):
                y[: len(marks), j] = marks
            for kind in ("paths", "words"):  # some tokens are hidden, so that no name alone decides
                cells, tokens, shares = x.tokens[kind]
                shown = rng.random(len(cells)) > (0.08 if kind == "paths" else 0.3)
                x.tokens[kind] = cells[shown], tokens[shown], shares[shown]
            loss, g = gradients(w, x, y)
            total += loss
            step += 1
            rate = 0.01 * min(1, step / 50) * (1 - step / (epochs * len(chunks) + 1))
            norm = max(1.0, float(np.sqrt(sum((a * a).sum() for a in g.values()))))
            for name, a in g.items():
                a = a / norm
                m[name] = 0.9 * m[name] + 0.1 * a
                v[name] = 0.999 * v[name] + 0.001 * a * a
                w[name] = (w[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        wrong = whole = 0
        for b, marks in held:
            bad = int(((logits(w, Input([b]))[:, 0] > 0) != (marks > 0)).sum())
            wrong, whole = wrong + bad, whole + (bad == 0)
        print(f"epoch {epoch}: loss {total / len(chunks):.4f}; held out: {wrong} blocks wrong, {whole} of {len(held)} pages whole", flush=True)
    return w


if __name__ == "__main__":
    np.savez_compressed(sys.argv[1] if len(sys.argv) > 1 else WEIGHTS, **{k: a.astype(np.float16) for k, a in train().items()})
