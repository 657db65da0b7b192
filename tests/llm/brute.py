"""Plain versions of what the operators compute."""

import re
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def shingles(text, n):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < n else set(zip(*[w[i:] for i in range(n)]))


def near_components(docs, n, percent):
    """{doc_id: (set size, smallest id reachable)}"""
    sets = {i: shingles(t, n) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def dedup_lines(docs, min_chars=10):
    """{doc_id: (lines, dropped, text)}"""
    blank = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(blank).translate(lower)
    owner = {}
    for i, t in sorted(docs):
        for line in (t or "").split("\n"):
            owner.setdefault(key(line), i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or owner[key(x)] == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def contained_items(docs, items, n=5, percent=80):
    """{(doc_id, item_id): shared shingles}"""
    sets = {i: shingles(t, n) for i, t in items}
    out = {}
    for d, t in docs:
        w = words(t)
        for i, s in sets.items():
            here = shingles(t, n) if not s or len(next(iter(s))) == n else set(zip(*[w[k:] for k in range(len(next(iter(s))))]))
            if s and 100 * len(s & here) >= percent * len(s):
                out[d, i] = len(s & here)
    return out


def span_dedup(docs, min_sentences=2, min_words=25):
    """{doc_id: (sentences, removed, text)}"""
    seen, cut = defaultdict(list), {}
    for d, t in sorted(docs):
        raw = (t or "").encode()
        found = list(WORD.finditer(raw))
        sentences, now = [], []
        for k, m in enumerate(found):
            now.append(m)
            last = k + 1 == len(found)
            if last or b"\n" in raw[m.end() : found[k + 1].start()] or re.search(rb"""[.!?]["')\]}*]*$""", m.group()):
                sentences.append(now)
                now = []
        cut[d] = (raw, sentences)
        runs = set()
        for i in range(len(sentences)):
            for step in (1, -1):
                total, j = 0, i
                while 0 <= j < len(sentences):
                    total += len(sentences[j])
                    if total >= min_words and abs(j - i) + 1 >= min_sentences:
                        runs.add((min(i, j), max(i, j) + 1))
                        break
                    j += step
        for i, j in runs:
            seen[tuple(m.group().lower() for s in sentences[i:j] for m in s)].append((d, i, j))
    gone = defaultdict(set)
    for places in seen.values():
        first, *later = sorted(places)
        for d, i, j in later:
            gone[d].update(range(max(i, first[2]) if d == first[0] else i, j))
    out = {}
    for d, (raw, sentences) in cut.items():
        text = raw
        if gone[d]:
            text = raw[: sentences[0][0].start()]
            for k, s in enumerate(sentences):
                if k not in gone[d]:
                    text += raw[s[0].start() : sentences[k + 1][0].start() if k + 1 < len(sentences) else len(raw)]
        out[d] = (len(sentences), len(gone[d]), text.decode())
    return out


def bigram_model(docs):
    ones, twos = Counter(), Counter()
    for _, t in docs:
        w = [*words(t), None]
        ones.update(w)
        twos.update(zip([None, *w[:-1]], w))
    return ones, twos
