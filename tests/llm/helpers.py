"""Plain versions of what the operators compute."""

import re

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TOKEN = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


def shingle_set(text, width=5):
    tokens = TOKEN.findall(lower(text))
    if not tokens:
        return set()
    return {tuple(tokens[i : i + width]) for i in range(max(1, len(tokens) - width + 1))}


def component_ids(texts, percent=80):
    """``{id: (set size, smallest linked id)}`` by comparing all pairs."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    label = {i: i for i in texts}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((root(a), root(b)))
                    label[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def hit_words(text, items, width=10):
    """Word places inside a benchmark window and ids of the items, by comparing all windows."""
    own, places, found = words(text), set(), set()
    for item, item_text in items:
        parts = words(item_text)
        size = min(width, len(parts))
        for j in range(len(parts) - size + 1 if parts else 0):
            for i in range(len(own) - size + 1):
                if own[i : i + size] == parts[j : j + size]:
                    places.update(range(i, i + size))
                    found.add(str(item))
    return places, found
