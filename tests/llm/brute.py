"""Plain versions of the operators, to hold the distributed ones against."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def shingles(text, width=5):
    words = WORD.findall(fold(text))
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset()


def components(rows, width=5, percent=75):
    """rows (id, text) to {id: smallest id of its component}."""
    sets = {i: shingles(t, width) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}, {i: len(s) for i, s in sets.items()}


KINDS = [
    ("assign", re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def base_spans(text):
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(KINDS) for m in p.finditer(text or "") if ok(m)]
    return sorted(found)


def contamination(text, items):
    """(n_words, n_hit, items that occur) of a text; items: (id, text)."""
    patterns = defaultdict(set)
    for i, t in items:
        words = ITEM_WORD.findall(fold(t))
        n = min(13, len(words))
        for k in range(len(words) - n + 1 if words else 0):
            patterns[tuple(words[k : k + n])].add(str(i))
    words, hit, found = ITEM_WORD.findall(fold(text)), set(), set()
    for n in {len(p) for p in patterns}:
        for k in range(len(words) - n + 1):
            if (window := tuple(words[k : k + n])) in patterns:
                hit.update(range(k, k + n))
                found |= patterns[window]
    return len(words), len(hit), found


def quality(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    counts, covered = Counter(windows), set()
    for k, w in enumerate(windows):
        if counts[w] > 1:
            covered.update(range(k, k + 5))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def components_of_rows(rows):
    """rows (id, text), ids may repeat: component ids row by row; links are between texts."""
    texts = sorted({t for i, t in rows if i is not None and t is not None})
    roots, _ = components(list(enumerate(texts)))
    least = {}
    for i, t in rows:
        if i is not None and t is not None and shingles(t):
            r = roots[texts.index(t)]
            least[r] = min(i, least.get(r, i))
    return [None if i is None else least[roots[texts.index(t)]] if t and shingles(t) else i for i, t in rows]


def phrases(text: bytes, learned: bytes) -> int:
    """Greedy longest phrases of a text that occur in another; a byte that does not is one by itself."""
    at = n = 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in learned:
            end += 1
        n, at = n + 1, max(end - 1, at + 1)
    return n


class _Blocks(HTMLParser):
    """Lines of pages like those of the tables: nested elements are closed but for p and b."""

    BLOCK = "html head title body nav ul li div article h1 p footer aside form section main".split()
    APART = "head title style script nav footer aside form".split()

    def __init__(self):
        super().__init__()
        self.path, self.lines, self.text, self.tags = [], [], {0: "", 1: ""}, {0: 0, 1: 0}

    def apart(self):
        return int(any(t in self.APART for t, _ in self.path))

    def end(self):
        kind = "article" if any(t == "article" for t, _ in self.path) else "rest"
        boxes = [n for t, n in self.path if t in ("body", "ul", "div", "article", "main", "section")] or [0]
        for k in (1,) if self.apart() else (0, 1):
            text = " ".join(self.text[k].split())
            if text:
                self.lines.append([text, max(1, self.tags[k]), "apart" if k else kind, boxes])
                self.tags[k] = 0
            self.text[k] = ""

    def handle_starttag(self, tag, attrs):
        self.tags[self.apart()] += 1
        if tag in ("meta", "br"):
            self.text[self.apart()] += " " * (tag == "br")
            return
        if tag == "p" and any(t == "p" for t, _ in self.path):
            at = max(k for k, (t, _) in enumerate(self.path) if t == "p")
            if not any(t in self.BLOCK for t, _ in self.path[at + 1 :]):
                self.end_line_before(at)
        if tag in self.BLOCK:
            self.end()
        self.path.append((tag, self.getpos()))

    def end_line_before(self, at):
        # the line is ended by the new paragraph itself, in the place around it
        held = self.path[:at]
        self.path = held

    def handle_endtag(self, tag):
        self.tags[self.apart()] += 1
        if tag in self.BLOCK:
            self.end()
        places = [k for k, (t, _) in enumerate(self.path) if t == tag]
        if places:
            del self.path[places[-1] :]

    def handle_data(self, data):
        self.text[self.apart()] += data


def _two_clusters(values):
    low, high = min(values), max(values)
    while True:
        cut = (low + high) / 2
        below, above = [v for v in values if v < cut], [v for v in values if v >= cut]
        if not below:
            return low
        now = sum(below) / len(below), sum(above) / len(above)
        if now == (low, high):
            return cut
        low, high = now


def main_text(page):
    """Text of the regions whose mass of smoothed text-to-tag ratios is in the upper cluster."""
    parser = _Blocks()
    parser.feed(page)
    parser.close()
    held = Counter(str(boxes) for _, _, kind, boxes in parser.lines)
    runs, before = [], None
    for k, (_, _, kind, boxes) in enumerate(parser.lines):
        if kind == "rest" and held[str(boxes)] == 1:
            boxes = boxes[:-1]
        place = None if kind == "apart" else (kind, str(boxes) if kind == "rest" else "")
        if place and place[0] == "article":
            found = [r for r in runs if r[0] == "article"]
            (found or runs).append(["article", []]) if not found else None
            next(r for r in runs if r[0] == "article")[1].append(k)
        elif place:
            if place != before:
                runs.append(["rest", []])
            runs[-1][1].append(k)
        before = place
    mass, kinds, smoothed = [], Counter(), {}
    for kind, some in runs:
        total = 0.0
        for a in range(len(some)):
            weights = [math.exp(-((a - b) ** 2) / 2) if abs(a - b) <= 3 else 0.0 for b in range(len(some))]
            ratios = [len(parser.lines[k][0]) / parser.lines[k][1] for k in some]
            smoothed[some[a]] = sum(w * r for w, r in zip(weights, ratios)) / sum(weights)
            total += smoothed[some[a]]
        mass.append(total)
        kinds[kind] += total * (64 if kind == "article" else 1)
    if not kinds:
        return ""
    cut = _two_clusters([math.sqrt(x) for x in kinds.values()])
    rest = [m for (kind, _), m in zip(runs, mass) if kind == "rest"]
    region = _two_clusters([0.0, *map(math.sqrt, rest)])
    line = _two_clusters([0.0, *(math.sqrt(smoothed[k]) for kind, some in runs if kind == "rest" for k in some)])
    taken = []
    for (kind, some), m in zip(runs, mass):
        if math.sqrt(kinds[kind]) >= cut and (kind == "article" or math.sqrt(m) >= region):
            taken += [k for k in some if kind == "article" or math.sqrt(smoothed[k]) >= line]
    return "\n".join(parser.lines[k][0] for k in sorted(taken))


def runs(words, least=12):
    """(start, length, period) of all runs, period by period."""
    best = {}
    for q in range(1, len(words)):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                best.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((a, b - a, q) for (a, b), q in best.items()), key=lambda r: (r[0], r[2]))


def repeated_words(doc_id, text):
    """The words of the periodic-run query."""
    words, h = WORD.findall(text or ""), zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def hard_negatives(rows, anchors):
    """rows: (id, label, whole numbers), anchors: ids."""
    out = []
    dot = lambda x, y: sum(a * b for a, b in zip(x, y))
    for anchor, label, x in rows:
        if anchor in anchors:
            scored = sorted((-dot(x, y), i, l) for i, l, y in rows if i != anchor)
            for s, positive, _ in [r for r in scored if r[2] == label][:5]:
                fit = [r for r in scored if r[2] != label and 50 * -s <= 100 * -r[0] <= 95 * -s][:3]
                out += [(anchor, positive, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(fit)]
    return sorted(out)
