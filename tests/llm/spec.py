"""Brute-force versions of operators, straight from their contracts."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import xxhash


def simhash(text: str | None, shingle: int = 3) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def linked_components(prints: list[tuple[int, int]], radius: int = 3) -> dict[int, int]:
    """From (id, fingerprint): the smallest id reachable."""
    parent = {i: i for i, _ in prints}

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, x) in enumerate(prints):
        for j, y in prints[:a]:
            if (x ^ y).bit_count() <= radius:
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return {i: root(i) for i in parent}


class Tree(HTMLParser):
    """Well-formed pages as nested [tag, children], children being elements and texts."""

    def __init__(self, source: str):
        super().__init__()
        self.root = ["", []]
        self.open = [self.root]
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, [], dict(attrs)]
        self.open[-1][1].append(node)
        self.open.append(node)

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        if data.strip():
            self.open[-1][1].append(" ".join(data.split()))


def site_pages(rng: random.Random) -> list[tuple[int, str, str]]:
    """Well-formed pages of hosts with 1 to 40 pages: menus, two sections' sidebars, notices, repeated paragraphs, and articles on some hosts."""
    out: list[tuple[int, str, str]] = []
    for h, n in enumerate((1, 2, 3, 5, 9, 16, 40)):
        article = h % 2 == 0
        body = lambda inner: f"<article>{inner}</article>" if article else f"<div>{inner}</div>"  # noqa: E731, B023
        for k in range(n):
            paragraphs = [f"host {h} page {k} line {j} {rng.random()}" for j in range(rng.randrange(1, 5))]
            if rng.random() < 0.7:
                paragraphs.insert(rng.randrange(len(paragraphs)), f"what host {h} says in all articles")
            if rng.random() < 0.2:
                paragraphs = [f"host {h} the same article"]
            side = f"<section><p>section {k % 2} of {h}</p><p>more</p></section>"
            menu = f"<div><ul><li>a {h}</li><li>b</li></ul></div>"
            notice = f"<p>notice {h}</p>" if rng.random() < 0.5 else ""
            foot = f"<footer><p>foot {h}</p><p>{rng.random()}</p></footer>"
            out.append((len(out), f"https://www.h{h}.example/{k}", f"<html><body>{menu}{side}{notice}{body(''.join(f'<p>{p}</p>' for p in paragraphs))}{foot}</body></html>"))
    return out


def main_texts(pages: list[tuple[str, str]]) -> list[str]:
    """Each page's text without footers and subtrees on many pages of different content of the host: of the article, and what is beside it if that is a third as long."""
    trees = [Tree(source).root for _, source in pages]

    def leaves(node, inside=False, out=False):
        """(text, path of subtrees' identities, in article, in footer) in order."""
        if isinstance(node, str):
            return [(node, [], inside, out)]
        inside, out = inside or node[0] == "article", out or node[0] == "footer"
        found = [x for child in node[1] for x in leaves(child, inside, out)]
        return [(t, [repr(node[:2]), *path], i, o) for t, path, i, o in found]

    read = [leaves(t) for t in trees]
    main = [[(i if any(x[2] for x in page) else True) and not o for _, _, i, o in page] for page in read]
    content = ["\n\n".join(x[0] for x, m in zip(page, own) if m) for page, own in zip(read, main)]
    hosts = [url.split("/")[2] for url, _ in pages]
    n_pages = Counter(h for h, _ in set(zip(hosts, content)))
    seen = defaultdict(set)
    for host, page, own, text in zip(hosts, read, main, content):
        holds = {tree for (_, path, i, _), m in zip(page, own) if m and i for tree in path}
        for _, path, _, _ in page:
            for tree in path:
                seen[host, tree, tree in holds].add(text)
    def many(host, tree, own):
        n, p = len(seen[host, tree, own]), n_pages[host]
        return n >= (max(10, 0.6 * p) if own else max(3, min(0.6 * p, 2 * p**0.5)))
    out = []
    for host, page, own in zip(hosts, read, main):
        holds = {tree for (_, path, i, _), m in zip(page, own) if m and i for tree in path}
        kept = [(t, i) for t, path, i, o in page if not o and not any(many(host, tree, tree in holds) for tree in path)]
        inside, beside = (sum(len(t) for t, i in kept if i == x) for x in (True, False))
        out.append("\n\n".join(t for t, i in kept if i or 3 * beside >= inside))
    return out


def near_labels(texts: list[str | None]) -> list[int]:
    """For each text the first one of its component at Jaccard >= 0.8 of five-word shingles."""
    sets = []
    for t in texts:
        words = (t or "").lower().split()
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))})
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def words_of(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def pipeline(docs: list[tuple[int, str | None, str | None]], items: list[str | None]) -> dict[int, int]:
    """What the corpus pipeline leaves of (id, text, source) where nothing is labelled: words taken by id."""
    groups = defaultdict(list)
    for d in docs:
        groups[re.sub(r"[\x20\x09-\x0D]", "", d[1] or "")].append(d)
    docs = sorted(min(g, key=lambda d: (-len(d[1] or ""), d[0])) for g in groups.values())
    docs = [d for k, (d, label) in enumerate(zip(docs, near_labels([d[1] for d in docs]))) if k == label]
    windows = set()
    for own in map(words_of, items):
        windows |= {tuple(own[k : k + 10]) for k in range(max(1, len(own) - 9))} if own else set()

    def hit(text):
        own = words_of(text)
        return any(tuple(own[k : k + n]) in windows for n in {len(w) for w in windows} for k in range(len(own) - n + 1))

    docs = [d for d in docs if not hit(d[1])]
    size = {d[0]: len(re.findall(r"[^\x20\x09-\x0D]+", d[1] or "")) for d in docs}
    sources = sorted({d[2] for d in docs}, key=lambda s: (s is None, s or ""))
    own = {s: sum(size[d[0]] for d in docs if d[2] == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    capped, total = set(), sum(own.values())
    while True:
        free = [s for s in sources if s not in capped]
        left = total - sum(3 * own[s] for s in capped)
        share = {s: weight[s] * left / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * own[s]}
        if not over:
            break
        capped |= over
    taken = {}
    for s in sources:
        budget = int(share[s]) if s not in capped else 3 * own[s]
        mine = sorted((d for d in docs if d[2] == s), key=lambda d: hashlib.md5(f"{d[0]}:mix-1".encode()).hexdigest()[:16])
        epochs, rest = divmod(budget, own[s]) if own[s] else (0, 0)
        for d in mine:
            cut = min(size[d[0]], rest)
            rest -= cut
            taken[d[0]] = size[d[0]] * epochs + cut
    return {k: n for k, n in taken.items() if n}
